"""Exact deduplication as a stateful stream.

Documents stream from their files. The keyed state, kept on disk by RocksDB and never expired, holds for each digest
(SHA-256 and byte length) the member count and the row that stays: the largest doc_id, of equal ids the last by
content locator (file and row). State rows are tens of bytes; texts never enter the state or its shuffle.

Digests of more than one row are hits. Their rows' full bytes are compared with those of the row that stays; rows that
differ (a collision of digests) are grouped by their full text instead. Only hits' texts are shuffled, by a join that
Spark can split, so one text with a third of all rows does not land in one task.

Defined cases: null counts as an empty text; a null doc_id is smaller than any other; of repeated rows exactly one
stays; other columns are ignored; an empty table gives an empty result. Everything runs on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import exists, materialize, scratch_path, small_side

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    # many small stores: files are not allocated ahead, megabytes for each store at once
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _rows(source: DataFrame, digest) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return source.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), at.alias("at"))


def _last(doc_id: str, at: str) -> Column:
    return F.max(F.struct(F.col(doc_id).alias("doc_id"), F.col(at).alias("at")))


def _pattern(path: str) -> str:
    """The path as a pattern that it alone fits: a stream reads a pattern's file, but no plain path to a file."""
    path = path.rstrip("/")
    at = max(i for i, c in enumerate(path) if c.isalnum())
    return f"{path[:at]}[{path[at]}]{path[at + 1 :]}"


def digest_state(spark: SparkSession, path: str, schema: StructType, digest, checkpoint: str, files: int) -> DataFrame:
    """(digest, bytes, n, keep{doc_id, at}) after all files that stand in path; a second call with the checkpoint goes on from there."""
    read = _rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(_pattern(path)), digest)
    state = read.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), _last("doc_id", "at").alias("keep"))
    out = f"{checkpoint}-updates"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a replayed batch takes its own place

    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not exists(spark, out):
        return spark.createDataFrame([], state.schema)  # no file, no batch
    updates = spark.read.schema(state.schema).parquet(out)
    return materialize(updates.groupBy("digest", "bytes").agg(F.max("n").alias("n"), F.max("keep").alias("keep")), "state")


def exact_duplicates(spark: SparkSession, path: str, digest=lambda text: F.sha2(text, 256), checkpoint: str | None = None, files: int = 10_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of the Parquet files in path."""
    docs = spark.read.parquet(path)
    state = digest_state(spark, path, docs.schema, digest, checkpoint or scratch_path(spark, "stream"), files)
    rows = _rows(docs, digest)
    hits = materialize(state.where("n > 1").select("digest", "bytes", F.col("keep.at").alias("kept_at")), "hits")
    texts = rows.join(small_side(hits, 256), ["digest", "bytes"])
    keepers = materialize(texts.where("at = kept_at").select("digest", "bytes", F.col("text").alias("kept_text")), "keepers")
    differ = materialize(texts.join(keepers, ["digest", "bytes"]).where("text != kept_text").select("digest", "bytes", "text", "doc_id", "at"), "differ")
    base = rows.select("doc_id", "digest", "bytes", "at", F.sha2(F.col("text"), 256).alias("text_sha256")).join(state, ["digest", "bytes"])
    keep_id, n, keep_at = F.col("keep.doc_id"), F.col("n"), F.col("keep.at")
    if not differ.isEmpty():  # collisions: the full text is the key
        own = differ.groupBy("digest", "bytes", "text").agg(F.count(F.lit(1)).alias("n2"), _last("doc_id", "at").alias("keep2"))
        moved = materialize(differ.join(own, ["digest", "bytes", "text"]).select("at", "n2", "keep2"), "moved")
        fewer = materialize(differ.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("less")), "fewer")
        base = base.join(moved, "at", "left").join(fewer, ["digest", "bytes"], "left")
        keep_id = F.when(F.col("n2").isNotNull(), F.col("keep2.doc_id")).otherwise(keep_id)
        keep_at = F.coalesce(F.col("keep2.at"), keep_at)
        n = F.coalesce(F.col("n2"), n - F.coalesce(F.col("less"), F.lit(0)))
    return base.select("doc_id", keep_id.alias("keep_id"), n.alias("group_size"), (F.col("at") == keep_at).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
