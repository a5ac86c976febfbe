"""Changes between the good syncs of knowledge sources: problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.instants import rfc3339_seconds
from anamnesis.operators.ordered import ordinal
from anamnesis.operators.snapshots import changes
from anamnesis.session import cut
from anamnesis.sources.tables import table

DAY = 86_400


def good_syncs(spark: SparkSession, folder: str) -> DataFrame:
    """The row of each sync_id that was delivered last, where it is a snapshot; its revisions only by their hash."""
    rows = table(spark, folder, "source_states")
    held = F.struct("delivered_at", "source_id", "enabled", "last_sync_at", "last_success_at", F.xxhash64("active_revisions").alias("revisions"))
    return (
        rows.where("sync_id is not null")
        .groupBy("sync_id")
        .agg(F.max(held).alias("r"))
        .select("sync_id", "r.*")
        .where("source_id is not null and enabled and last_success_at = last_sync_at")
    )


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """(revision_id, key, content): the content is named by its hash, as bytes, else by the hash of the text."""
    named = F.lower(F.nullif(F.trim("content_sha256"), F.lit("")))
    digest = F.coalesce(named, F.sha2(F.col("content"), 256))
    as_bytes = F.coalesce(F.when(F.length(digest) == 64, F.unhex(digest)), F.encode(digest, "UTF-8"))
    return (
        table(spark, folder, "knowledge_snapshots")
        .where("revision_id is not null and document_key is not null")
        .groupBy("revision_id")
        .agg(F.min(F.struct(F.col("document_key").alias("key"), as_bytes.alias("content"))).alias("r"))
        .select("revision_id", "r.*")
    )


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    good = good_syncs(spark, folder).withColumnRenamed("source_id", "source")
    day = F.floor(rfc3339_seconds(F.col("last_sync_at")) / DAY)
    # Three readers: written once, as it is slim. The ordinals run by last_sync_at.
    numbered = cut(ordinal(good, ["source"], day, ["last_sync_at", "sync_id"]).select("sync_id", "source", "ordinal", "delivered_at", "revisions"))
    # The lists are read where they lie: of a sync's rows the one that counts is found again by time and hash.
    lists = table(spark, folder, "source_states").select("sync_id", F.col("delivered_at").alias("at"), "active_revisions")
    same = F.col("at").eqNullSafe(F.col("delivered_at")) & (F.xxhash64("active_revisions") == F.col("revisions"))
    named = (
        lists.join(numbered, "sync_id")
        .where(same)
        .select("source", "ordinal", F.explode("active_revisions").alias("revision_id"))
        .join(revisions(spark, folder), "revision_id")
    )
    spans = numbered.groupBy("source").agg(F.max("ordinal").alias("last_ordinal"))
    return changes(named, spans).join(numbered.select("sync_id", "source", "ordinal"), ["source", "ordinal"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changed(spark, folder).select(
        F.col("source").alias("source_id"), "sync_id", F.col("key").alias("document_key"), F.col("change").alias("change_kind")
    )


def p1_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each kind per source, and in how many syncs they occurred."""
    return (
        _changed(spark, folder)
        .groupBy(F.col("source").alias("source_id"), F.col("change").alias("change_kind"))
        .agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("sync_id").alias("n_syncs"))
    )


_CHANGES = """
  g as (select sync_id, source_id, last_sync_at, active_revisions, row_number() over (partition by source_id order by last_sync_at, sync_id) o
    from (select *, row_number() over (partition by sync_id order by delivered_at desc) k from source_states)
    where k = 1 and enabled and last_success_at = last_sync_at),
  rev as (select distinct revision_id, document_key, coalesce(lower(content_sha256), sha256(content)) h from knowledge_snapshots),
  s as (select distinct source_id, o, document_key, h from (select source_id, o, unnest(active_revisions) revision_id from g) join rev using (revision_id)),
  p as (select source_id, o + 1 o, document_key, h from s),
  f as (select source_id, o, document_key, case when p.h is null then 'added' when s.h is null then 'removed' else 'changed' end change_kind
    from s full join p using (source_id, o, document_key) where s.h is distinct from p.h),
  c as (select source_id, sync_id, document_key, change_kind from f join g using (source_id, o) where o > 1)"""

QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts}
ORACLES = {
    "p1_found": f"with {_CHANGES} select * from c",
    "p1_change_counts": f"with {_CHANGES} select source_id, change_kind, count(*) n_changes, count(distinct sync_id) n_syncs from c group by 1, 2",
}
