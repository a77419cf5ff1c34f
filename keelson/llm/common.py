"""What the corpus operators share: reading, scratch tables, words, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Separators of "code" words: every ASCII character that is no digit and no lower-case letter.
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: A side is broadcast only when its measured rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20

#: Bytes of an Arrow batch between an executor and its Python workers (the last row may go beyond). By Spark's own bounds,
#: 10,000 rows and 64 MB, a task holds several batches of tens of MB on both sides.
ARROW_BYTES = 4 << 20

_scratch: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a local master gets a temporary folder; a cluster is refused.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="keelson-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/keelson-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _scratch[app]


def release(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; results that still read them are lost."""
    try:
        app = spark.sparkContext.applicationId
        if app in _scratch:
            path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop(app))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already; its folder is the operator's to clean
        pass


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ARROW_BYTES; a smaller bound stays.

    The setting stays too: Spark reads it when a plan runs, which is after an operator has returned.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], base: str) -> str:
    """A column name that clashes with none of columns (case does not count)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart on every read, and that column's name.

    Rows that come straight from files are told by file and position; others are written with a number.
    """
    row = fresh(docs.columns, "_row")
    if "_metadata" not in (c.lower() for c in docs.columns):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
        try:
            return docs.select("*", place.alias(row)), row
        except AnalysisException:  # no plain scan of files
            pass
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Marks a materialized df for broadcast if its counted rows fit BROADCAST_BYTES; else leaves the join to shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def measured_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Marks a materialized df for broadcast if its rows' summed bytes fit BROADCAST_BYTES; else leaves the join to shuffle."""
    total = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def beside(rows: DataFrame, blobs: DataFrame, parts: int, load, each, schema) -> DataFrame:
    """each(load(blob), batch) for the rows (key, salts, r) of every key, beside the blob of their key (key, salts, blob).

    A key's rows are dealt over its salts, each of which gets a copy of the blob ahead of its rows, so neither a hot key
    nor the number of blobs is held by one task: a task holds one blob and one batch of rows (the struct r).
    """
    kind = dict(rows.dtypes)["r"]
    given = rows.select("key", F.pmod(F.xxhash64("r"), F.col("salts")).alias("salt"), F.lit(1).alias("o"), "r", F.lit(None).cast("binary").alias("blob"))
    ahead = blobs.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("o"), F.lit(None).cast(kind).alias("r"), "blob")

    def run(batches):
        now = None
        for batch in batches:
            starts = np.flatnonzero(batch.column("o").to_numpy(zero_copy_only=False) == 0).tolist()
            if (not starts or starts[0]) and batch.num_rows:
                yield from each(now, pa.RecordBatch.from_struct_array(batch.column("r").slice(0, starts[0] if starts else None)))
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=False):  # a batch within a key's rows starts none
                now = load(batch.column("blob")[i].as_py())
                if j > i + 1:
                    yield from each(now, pa.RecordBatch.from_struct_array(batch.column("r").slice(i + 1, j - i - 1)))

    return given.unionByName(ahead).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "o").mapInArrow(run, schema)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII texts take the fast lower()."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def code_words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
