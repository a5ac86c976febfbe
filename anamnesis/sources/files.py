"""Files the reference reads and writes: documents, sessions, evaluation sets, and append-only results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "created_at", "updated_at", "status", "user_content", "assistant_content", "thinking", "done_reason", "error")]
    + [T.StructField("usage", T.StructType([T.StructField(n, T.LongType()) for n in ("input_tokens", "output_tokens", "total_tokens")]))]
)
SESSION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "created_at", "updated_at", "status", "model")]
    + [T.StructField("active_context_start_index", T.IntegerType()), T.StructField("turns", T.ArrayType(TURN))]
)
LONG_MEMORY = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, "
    "haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)
#: Question classes of the conversation benchmark by category number.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "general", 4: "exact_fact", 5: "no_answer"}


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(document_key, content, content_sha256) of all .txt and .md files below a folder; the key is the relative path."""
    base = root.rstrip("/")
    raw = spark.read.text(base, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    kept = raw.where(F.lower("path").rlike(r"\.(txt|md)$"))
    decoded = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    key = F.substring_index(decoded, base + "/", -1)
    return kept.select(key.alias("document_key"), "content", F.sha2("content", 256).alias("content_sha256"))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Session files of a fixed schema; `named` tells whether the file's name is the session's id."""
    df = spark.read.schema(SESSION).json(root, multiLine=True, recursiveFileLookup=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return df.withColumn("named", F.coalesce(stem == F.col("id"), F.lit(False)))


def session_turns(loaded: DataFrame) -> DataFrame:
    """One row per turn, with its place in the session."""
    return loaded.select(F.col("id").alias("session_id"), F.posexplode("turns").alias("turn_no", "t")).select("session_id", "turn_no", "t.*")


def long_memory(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases with parallel arrays of sessions; a question id that ends in _abs has no answer."""
    df = spark.read.schema(LONG_MEMORY).json(path, multiLine=True)
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    sessions_ = F.transform(zipped, lambda x: F.struct(x["haystack_session_ids"].alias("external_id"), x["haystack_dates"].alias("occurred_at"), x["haystack_sessions"].alias("messages")))
    return df.select(
        F.col("question_id").alias("id"),
        "question",
        F.col("answer").alias("expected_answer"),
        F.when(F.col("question_id").endswith("_abs"), "no_answer").otherwise(F.col("question_type")).alias("question_class"),
        F.col("question_date").alias("reference_time"),
        sessions_.alias("sessions"),
        F.col("answer_session_ids").alias("gold_sessions"),
    )


def conversation_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, messages) of samples whose sessions are keys session_1, session_2, ... in numeric order.

    The keys are read as a map, so no schema is inferred and no key is named in code.
    """
    raw = spark.read.schema("sample_id string, conversation string, qa array<struct<question:string,answer:string,category:int,evidence:array<string>,adversarial_answer:string>>").json(path, multiLine=True)
    per = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    q = raw.select("sample_id", F.posexplode("qa").alias("no", "q")).select(
        "sample_id",
        "no",
        F.col("q.question").alias("question"),
        F.coalesce(F.nullif(F.trim("q.answer"), F.lit("")), F.nullif(F.trim("q.adversarial_answer"), F.lit(""))).alias("expected_answer"),
        F.try_element_at(per, F.col("q.category")).alias("question_class"),
        F.col("q.evidence").alias("gold_evidence"),
    )
    entry = raw.select("sample_id", F.explode(F.from_json("conversation", "map<string,string>")).alias("k", "v"))
    number = F.regexp_extract("k", r"^session_(\d+)$", 1)
    told = entry.where(number != "").select("sample_id", number.cast("int").alias("session_no"), F.from_json("v", "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>").alias("m"))
    dated = entry.where(F.col("k").rlike(r"^session_\d+_date_time$")).select("sample_id", F.regexp_extract("k", r"(\d+)", 1).cast("int").alias("session_no"), F.col("v").alias("occurred_at"))
    m = told.join(dated, ["sample_id", "session_no"], "left").select("sample_id", "session_no", "occurred_at", F.posexplode("m").alias("pos", "m"))
    text = F.concat_ws(" ", "m.text", F.when(F.col("m.blip_caption").isNotNull(), F.concat(F.lit("["), F.col("m.blip_caption"), F.lit("]"))))
    return q, m.select("sample_id", "session_no", "occurred_at", "pos", F.col("m.speaker").alias("speaker"), F.col("m.dia_id").alias("evidence"), text.alias("content"))


def write_new(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table does not hold yet; how many those were. Content-addressed rows are never rewritten."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates([key])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    from anamnesis.session import cut

    fresh = cut(fresh)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def append_results(rows: DataFrame, path: str, key: str) -> int:
    """Append results as JSON lines, leaving out keys that are there already; how many were written."""
    spark = rows.sparkSession
    if _exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).json(path).select(key), key, "left_anti")
    from anamnesis.session import cut

    rows = cut(rows)
    n = rows.count()
    if n:
        rows.write.mode("append").json(path)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
