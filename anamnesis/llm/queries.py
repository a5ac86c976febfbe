"""Registered queries of this subpackage, each with its SQL check where SQL can express it."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm import language, mixing, packing
from anamnesis.llm.pairs import flag_pairs
from anamnesis.llm.splitting import CHARACTER, split_oversized
from anamnesis.session import cut
from anamnesis.sources.tables import table


#: How near a reached share must be; a small source's few texts can't fit any better at small scales.
NEAR_SHARE = 0.005


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all oversized snapshots and clauses; repeated rows of an item are folded first."""
    limits = table(spark, folder, "size_limits").select("item_kind", "max_chars", "overlap_chars")
    of = lambda name, kind, key, text: (
        table(spark, folder, name).select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), F.col(text).alias("text"))
    )
    items = of("knowledge_snapshots", "snapshot", "revision_id", "content").unionByName(
        of("source_clauses", "clause", "clause_id", "text")
    )
    # Only texts over the limit are shuffled, to fold repeated rows.
    long = (
        items.where("item_id is not null")
        .join(limits.select("item_kind", "max_chars"), "item_kind")
        .where(F.char_length("text") > F.col("max_chars"))
        .groupBy("item_kind", "item_id")
        .agg(F.min("text").alias("text"))
    )
    return split_oversized(long, limits)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    forced = F.bool_or(F.col("cut") == CHARACTER)
    return (
        _pieces(spark, folder)
        .groupBy("item_kind", "item_id")
        .agg(F.when(forced, "forced").otherwise("clean").alias("boundary"))
    )


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece with its offsets, the characters it shares with the piece before, and how it ends."""
    return _pieces(spark, folder)


def p2_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every item's pieces: without their overlaps they are the whole text, and all keep within the limit."""
    limits = table(spark, folder, "size_limits").select("item_kind", "max_chars", "overlap_chars")
    p = _pieces(spark, folder).select("item_kind", "item_id", "piece_no", "start_char", "end_char", F.col("overlap_chars").alias("shared"), F.char_length("text").alias("n"))
    new = F.col("end_char") - F.col("start_char") - F.col("shared")
    return p.join(limits, "item_kind").groupBy("item_kind", "item_id").agg(
        F.sum(new).alias("n_chars"),
        F.min("start_char").alias("first_char"),
        F.max("end_char").alias("last_char"),
        F.bool_and(F.col("n") == F.col("end_char") - F.col("start_char")).alias("texts_fit"),
        F.bool_and((F.col("n") <= F.col("max_chars")) & (F.col("shared") <= F.col("overlap_chars"))).alias("within"),
        (F.max("piece_no") == F.count(F.lit(1)) - 1).alias("numbered"),
    )


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Defects of each turn's last saved state; pending and blocked turns are left out."""
    state = F.struct("updated_at", "status", "user_content", "assistant_content", "done_reason", "error")
    last = (
        table(spark, folder, "turns")
        .where("id is not null")
        .groupBy("id")
        .agg(F.max(state).alias("t"))
        .where("t.status is null or t.status not in ('pending', 'blocked')")
    )
    return flag_pairs(
        last.select(
            F.col("id").alias("turn_id"),
            F.col("t.user_content").alias("question"),
            F.col("t.assistant_content").alias("answer"),
            F.col("t.status").alias("status"),
            F.col("t.done_reason").alias("reason"),
            F.col("t.error").alias("error"),
        )
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).select("turn_id", F.col("defects")[0].alias("defect"))


def p4_all_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect that a turn shows, also those behind the first."""
    return _flagged(spark, folder).select("turn_id", F.posexplode("defects").alias("place", "defect"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").where("doc_id is not null")
    return language.segments(docs, language.fit(docs))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of a text that its label does not name. Only a text's few languages are shuffled."""
    named = language.label_language(F.col("lang"))
    found = _segments(spark, folder).groupBy("doc_id").agg(F.max("lang").alias("lang"), F.collect_set("lang_found").alias("found"))
    kind = (
        F.when(F.col("named").isNull(), "missing")
        .when(F.array_contains("found", F.col("named")), "mixed")
        .otherwise("wrong")
    )
    return (
        found.select("doc_id", named.alias("named"), "found")
        .select("doc_id", "named", kind.alias("case_kind"), F.explode("found").alias("lang"))
        .where("named is null or lang <> named")
        .select("doc_id", "lang", "case_kind")
    )


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of one language with its offsets and confidence."""
    return _segments(spark, folder).select("doc_id", "start_char", "end_char", F.col("lang_found").alias("lang"), F.round("confidence", 4).alias("confidence"))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's main language, by characters, and the share of the text's segments that it has."""
    by = (
        _segments(spark, folder)
        .withColumn("n", (F.col("end_char") - F.col("start_char")).cast("long"))
        .groupBy("doc_id", "lang_found")
        .agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("confidence"))
    )
    best = F.max_by(F.struct("lang_found", "n", "confidence"), F.struct("n", "lang_found")).alias("b")
    return by.groupBy("doc_id").agg(best, F.sum("n").alias("all")).select(
        "doc_id",
        F.col("b.lang_found").alias("lang"),
        F.round("b.confidence", 4).alias("confidence"),
        F.round(F.col("b.n") / F.col("all"), 4).alias("share"),
    )


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    kinds = [(r[0], int(r[1])) for r in table(spark, folder, "pack_sizes").where("capacity_tokens >= 1").orderBy("container_kind").collect()]
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text").where("doc_id is not null")
    return packing.pack(texts, kinds)


def p6_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or of every part of a text over the capacity."""
    return _packed(spark, folder).select(
        "container_kind", "container_id", F.col("item_id").alias("doc_id"), "part_no", "token_start", "n_tokens"
    )


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each kind, and the share of their space that is used."""
    return (
        _packed(spark, folder)
        .groupBy("container_kind", "capacity", "container_id")
        .agg(F.sum("n_tokens").alias("used"))
        .groupBy("container_kind", "capacity")
        .agg(
            F.count(F.lit(1)).alias("n_containers"),
            F.sum("used").alias("n_tokens"),
            F.max("used").alias("most_used"),
            F.round(F.sum("used") / (F.count(F.lit(1)) * F.first("capacity")), 5).alias("fill"),
        )
    )


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every kind of container: all texts are in, none is over capacity, and only texts over it are parted."""
    placed = _packed(spark, folder)
    by = placed.groupBy("container_kind", "capacity", "item_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"), F.countDistinct("part_no").alias("numbers"))
    odd = (F.col("parts") != F.ceil(F.col("n") / F.col("capacity"))) | (F.col("parts") != F.col("numbers"))
    texts = by.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(odd).alias("n_odd"))
    full = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.max("capacity").alias("most"))
    return texts.join(full.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("most")).alias("n_over")), "container_kind")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray, list[int]]:
    goals = table(spark, folder, "mix_targets").where("source is not null").orderBy("source").collect()  # a small table
    classes, shares, caps = [r["source"] for r in goals], np.array([float(r["target_share"]) for r in goals]), [int(r["max_repeats"]) for r in goals]
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text", "source").where("doc_id is not null")
    held = mixing.members(docs, classes, mixing.fit(docs, classes))
    # A text without a source may be repeated as often as its likeliest source allows.
    stored = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("source"))
    top = F.coalesce(stored, F.array_position("m", F.array_max("m"))).cast("int")
    cap = F.when(F.array_max("m") > 0, F.element_at(F.array(*[F.lit(c) for c in caps]), top)).otherwise(0)
    taken, target = mixing.mix(cut(held.withColumn("cap", cap)), shares)
    return taken, classes, shares, target, caps


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each text is taken; texts that are not taken are left out."""
    taken = _mixed(spark, folder)[0].where("copies > 0")
    return taken.select(F.col("item_id").alias("doc_id"), "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source: by expected membership, and by the stored source, else the likeliest one."""
    taken, classes, shares, _, caps = _mixed(spark, folder)
    name, size = F.array(*[F.lit(c) for c in classes]), F.col("copies") * F.col("n_tokens")
    stored = F.coalesce(F.array_position(name, F.col("source")), F.array_position("m", F.array_max("m"))) - 1
    by = (
        taken.where("copies > 0")
        .select("copies", stored.alias("stored"), size.alias("size"), F.posexplode("m").alias("i", "p"))
        .groupBy("i")
        .agg(
            F.sum(F.col("size") * F.col("p")).alias("tokens"),
            F.coalesce(F.sum(F.when(F.col("stored") == F.col("i"), F.col("size"))), F.lit(0)).alias("stored_tokens"),
            F.max(F.when(F.col("stored") == F.col("i"), F.col("copies"))).alias("most_copies"),
        )
    )
    all_of = by.agg(F.sum("tokens").alias("total"), F.sum("stored_tokens").alias("stored_total"))
    at = (F.col("i") + 1).cast("int")
    return by.join(all_of).select(
        F.element_at(name, at).alias("source"),
        F.element_at(F.array(*[F.lit(float(x)) for x in shares]), at).alias("target_share"),
        F.round(F.col("tokens") / F.col("total"), 6).alias("reached_share"),
        F.round(F.try_divide("stored_tokens", "stored_total"), 6).alias("stored_share"),
        F.round("tokens").cast("long").alias("n_tokens"),
        "most_copies",
        F.element_at(F.array(*[F.lit(c) for c in caps]), at).alias("max_repeats"),
    )


def p7_caps(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every target: its share is near, by membership and by stored source, and no text is taken too often."""
    x = p7_shares(spark, folder)
    near = lambda c: F.abs(F.col(c) - F.col("target_share")) <= NEAR_SHARE
    return x.select("source", "target_share", near("reached_share").alias("near"), near("stored_share").alias("stored_near"), (F.coalesce("most_copies", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_cover": p2_cover, "p4_found": p4_found, "p4_all_defects": p4_all_defects, "p6_assignments": p6_assignments, "p6_fill": p6_fill, "p6_cover": p6_cover, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_caps": p7_caps, "p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents}
ORACLES = {
    "p2_cover": """
  with i as (select 'snapshot' item_kind, revision_id item_id, content t from knowledge_snapshots union select 'clause', clause_id, text from source_clauses)
  select item_kind, item_id, length(t) n_chars, 0 first_char, length(t)::int last_char, true texts_fit, true as "within", true numbered
  from i join size_limits using (item_kind) where length(t) > max_chars and item_id is not null""",
    "p6_cover": "select container_kind, capacity_tokens::bigint capacity, (select count(*) from documents where text <> '' and doc_id is not null) n_texts, 0::bigint n_odd, 0::bigint n_over from pack_sizes",
    "p7_caps": "select source, target_share, true near, true stored_near, true within_cap from mix_targets",
    "p2_found": r"""
  with i as (select 'snapshot' item_kind, revision_id item_id, content t from knowledge_snapshots
      union select 'clause', clause_id, text from source_clauses)
  select item_kind, item_id,
    case when list_max(list_transform(string_split_regex(t, '[\s\x{0B}\x{85}\p{Z}.。!！?？;；，,、:：]'), lambda x: length(x))) > max_chars
      then 'forced' else 'clean' end boundary
  from i join size_limits using (item_kind) where length(t) > max_chars and item_id is not null""",
}
