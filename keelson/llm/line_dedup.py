"""Line deduplication through a sharded minimal perfect hash.

A line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of at least MIN_CHARS code points that
stand in at least MIN_DOCS documents are indexed: their 128-bit hashes are dealt into shards, and each shard is a
minimal perfect hash (a cascade of bit arrays with ranks) over three compact arrays: fingerprint, document count and
the largest doc_id. Documents probe the arrays in their own task; lines are never joined or shuffled as text.

An index of at most INDEX_BYTES travels to all tasks and one pass over the documents probes it. A larger index stays
where it is: the documents' line hashes (28 bytes each) are dealt to the shards, a frequent shard over several tasks,
every task holds one shard, and the numbers of the lines that go come back to their rows for one last pass. No pass
writes texts, and no worker holds more than a shard however many lines repeat.

Keys that share the first 64 bits of their hash cannot stand in one perfect hash: one does, the others are listed
beside it with their whole hash.

Defined cases: a null or empty text is one empty line, which is too short to be dropped; each row counts as one
document, repeated rows too; a null doc_id is smaller than any other, and rows whose doc_id equals the largest holder's
(all null included) keep the line; other columns pass through `drop_repeated_lines` and are ignored by the query;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, materialize, numbered, read_table, small_side

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of one shard that are aimed at, and bytes of shards that may travel to all tasks.
SHARD_KEYS, INDEX_BYTES = 50_000, 48 << 20
#: Line hashes that one task probes where the index does not travel.
TASK_LINES = 500_000
#: Bits for each key of a level.
GAMMA = 2.0
_BLANKS = b" \t\n\r\x0b\f"
_NULL = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANKS).lower()


def _long_enough(key: bytes, chars: int) -> bool:
    """At least so many code points in UTF-8 bytes."""
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars)


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    h = h + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct 64-bit keys 0..n-1. A key takes its bit in the first level where it is alone in it.

    Keys must differ; equal ones raise an error, as none of them is ever alone.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        self.ranks, below = [], 0
        for bits in levels:
            self.ranks.append(below + np.cumsum(bits) - bits)
            below += int(bits.sum())
        self.size = below

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        if len(np.unique(keys)) < len(keys):
            raise ValueError("equal keys cannot be numbered")
        while len(left):
            m = max(64, int(GAMMA * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 or any number for a key that is not among those built from."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, top: np.ndarray) -> bytes:
    """Levels as bits, then fingerprints, counts and largest ids in the hash's order; behind them the keys whose h1 is taken."""
    _, first = np.unique(h1, return_index=True)
    mph = PerfectHash.build(h1[first])
    at = mph.find(h1[first])
    rest = np.setdiff1d(np.arange(len(h1)), first)
    own = [np.empty(len(first), dtype=t) for t in ("<u8", "<u4", "<i8")]
    for a, v in zip(own, (h2, np.minimum(docs, 0xFFFFFFFF), top), strict=True):
        a[at] = v[first]
    more = [h1[rest].astype("<u8"), h2[rest].astype("<u8"), np.minimum(docs, 0xFFFFFFFF)[rest].astype("<u4"), top[rest].astype("<i8")]
    sizes = np.array([len(first), len(rest), len(mph.levels), *(len(x) for x in mph.levels)], dtype="<i8")
    return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in mph.levels) + b"".join(a.tobytes() for a in (*own, *more))


class Shard:
    def __init__(self, blob: bytes):
        n, more, k = (int(x) for x in np.frombuffer(blob, "<i8", 3))
        sizes, at, levels = np.frombuffer(blob, "<i8", k, 24), 24 + 8 * k, []
        for m in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (m + 7) // 8, at), count=m).astype(bool))
            at += (m + 7) // 8
        self.mph = PerfectHash(levels)
        self.prints, self.docs, self.top = np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<u4", n, at + 8 * n), np.frombuffer(blob, "<i8", n, at + 12 * n)
        at += 20 * n
        h1, h2 = np.frombuffer(blob, "<u8", more, at), np.frombuffer(blob, "<u8", more, at + 8 * more)
        self.listed = {key: n + i for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True))}
        self.docs = np.concatenate([self.docs, np.frombuffer(blob, "<u4", more, at + 16 * more)])
        self.top = np.concatenate([self.top, np.frombuffer(blob, "<i8", more, at + 20 * more)])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Positions in the arrays; -1 for keys that are not indexed."""
        at = self.mph.find(h1)
        at[(at >= 0) & (self.prints[at] != h2)] = -1
        if self.listed:
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = self.listed.get((int(h1[i]), int(h2[i])), -1)
        return at

    def drops(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """The places of the lines that go: keys in enough documents, outside the largest id that holds them."""
        at = self.probe(h1, h2)
        mine = np.flatnonzero(at >= 0)
        return mine[(self.docs[at[mine]] >= min_docs) & (self.top[at[mine]] != ids[mine])]


def _emit_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            hi, lo, ids = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                keys = {k for k in map(line_key, (text.as_py() or b"").split(b"\n")) if _long_enough(k, min_chars)}
                for k in keys:
                    a, b = _hash(k)
                    hi.append(a), lo.append(b)
                ids += [_NULL if doc_id is None else doc_id] * len(keys)
            yield pa.RecordBatch.from_pydict({"h1": pa.array(np.array(hi, dtype=np.uint64).view(np.int64)), "h2": pa.array(np.array(lo, dtype=np.uint64).view(np.int64)), "doc_id": pa.array(ids, pa.int64())})

    return run


def _build(table: pa.Table) -> pa.Table:
    col = lambda c: table.column(c).to_numpy().astype(np.int64)
    blob = pack_shard(col("h1").view(np.uint64), col("h2").view(np.uint64), col("docs"), col("top"))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})


def repeated_line_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The written shards (shard, blob) over keys that stand in min_docs documents or more, and how many there are."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    keys = given.mapInArrow(_emit_keys(min_chars), "h1 long, h2 long, doc_id long")
    often = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top")).where(F.col("docs") >= min_docs)
    often = materialize(often, "lines")
    n = max(1, -(-often.count() // shard_keys))
    dealt = often.withColumn("shard", F.pmod("h1", F.lit(n))).groupBy("shard").applyInArrow(_build, "shard long, blob binary")
    return materialize(dealt, "shards"), n


def _lines_of(texts, ids: np.ndarray, min_chars: int):
    """The lines of texts; and of the long ones h1, h2, their text's id, their text and their place in it."""
    split, hi, lo, doc, line = [(t or b"").split(b"\n") for t in texts], [], [], [], []
    for i, lines in enumerate(split):
        for j, key in enumerate(map(line_key, lines)):
            if _long_enough(key, min_chars):
                a, b = _hash(key)
                hi.append(a), lo.append(b), doc.append(i), line.append(j)
    doc = np.array(doc, dtype=np.int64)
    return split, np.array(hi, dtype=np.uint64), np.array(lo, dtype=np.uint64), ids[doc], doc, np.array(line, dtype=np.int64)


def _ids(batch) -> np.ndarray:
    return np.array([_NULL if x is None else x for x in batch.column("_id").to_pylist()], dtype=np.int64)


def _without(batch, names: list[str], texts, split, gone: list[set], digest: bool) -> pa.RecordBatch:
    """The batch with the text's lines dropped (or the digest of what stays), and how many lines there were and how many went."""
    kept = [t if not g else b"\n".join(x for j, x in enumerate(lines) if j not in g) for t, lines, g in zip(texts, split, gone, strict=True)]
    out = {c: batch.column(c) for c in names if c not in ("_text", "_lines", "_gone")}
    out["_text"] = pa.array([hashlib.sha256(t or b"").hexdigest().encode() for t in kept] if digest else kept, pa.binary())
    out["_lines"], out["_gone"] = pa.array([len(x) for x in split], pa.int64()), pa.array([len(g) for g in gone], pa.int64())
    return pa.RecordBatch.from_arrays([out[c] for c in names], names=names)


def _probe(shards, n: int, min_chars: int, min_docs: int, digest: bool, names: list[str]):
    """Rows as they came with the lines dropped that the index tells."""

    def run(batches):
        index = {s: Shard(b) for s, b in shards.value}
        for batch in batches:
            texts = [t.as_py() for t in batch.column("_text")]
            split, h1, h2, ids, doc, line = _lines_of(texts, _ids(batch), min_chars)
            shard, gone = np.mod(h1.view(np.int64), n), [set() for _ in split]
            for s in np.unique(shard):
                if s in index:
                    mine = np.nonzero(shard == s)[0]
                    for k in mine[index[s].drops(h1[mine], h2[mine], ids[mine], min_docs)].tolist():
                        gone[doc[k]].add(int(line[k]))
            yield _without(batch, names, texts, split, gone, digest)

    return run


def _dealt_lines(n: int, min_chars: int):
    """(key, r): the shard of every long line, and its row, place, hashes and id."""

    def run(batches):
        for batch in batches:
            _, h1, h2, ids, doc, line = _lines_of([t.as_py() for t in batch.column("_text")], _ids(batch), min_chars)
            r = pa.StructArray.from_arrays([batch.column("_row").take(pa.array(doc)), pa.array(line), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids)], ["row", "line", "h1", "h2", "id"])
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.mod(h1.view(np.int64), n)), "r": r})

    return run


def _drops(min_docs: int):
    def each(shard: Shard | None, rows: pa.RecordBatch):
        if shard is not None:
            h1, h2, ids = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "id"))
            gone = pa.array(shard.drops(h1.view(np.uint64), h2.view(np.uint64), ids, min_docs))
            yield pa.RecordBatch.from_pydict({"row": rows.column("row").take(gone), "line": rows.column("line").take(gone)})

    return each


def _drop_listed(names: list[str], digest: bool):
    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column("_text")]
            gone = [set(x or ()) for x in batch.column("_listed").to_pylist()]
            yield _without(batch, names, texts, [(t or b"").split(b"\n") for t in texts], gone, digest)

    return run


def _named(docs: DataFrame, rest: list[str], *more) -> DataFrame:
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"), F.lit(0).cast("long").alias("_lines"), F.lit(0).cast("long").alias("_gone"), *more)


def _dropped(docs: DataFrame, rest: list[str], digest: bool, min_chars: int, min_docs: int, index_bytes: int, shard_keys: int) -> DataFrame:
    """(c0.., _id, _text, _lines, _gone) for every row of docs."""
    index, n = repeated_line_index(docs, min_chars, min_docs, shard_keys)
    size = index.agg(F.coalesce(F.sum(F.octet_length("blob").cast("long")), F.lit(0))).first()[0]
    context = docs.sparkSession.sparkContext
    if size <= index_bytes:
        now = _named(docs, rest)
        shards = context.broadcast([(r["shard"], bytes(r["blob"])) for r in index.collect()])
        return now.mapInArrow(_probe(shards, n, min_chars, min_docs, digest, now.columns), now.schema)
    rows, row = numbered(docs)
    now = _named(rows, rest, F.col(row).alias("_row"))
    kind = dict(now.dtypes)["_row"]
    lines = now.select("_row", "_id", "_text").mapInArrow(_dealt_lines(n, min_chars), f"key long, r struct<row:{kind},line:long,h1:long,h2:long,id:long>")
    counts = materialize(lines.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(TASK_LINES))).alias("salts")), "shard_lines")
    blobs = index.select(F.col("shard").alias("key"), "blob").join(small_side(counts, 16), "key")
    given = lines.join(small_side(counts, 16), "key").select("key", "salts", "r")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.agg(F.sum("salts")).first()[0] or 1)
    gone = beside(given, blobs, parts, Shard, _drops(min_docs), f"row {kind}, line long")
    listed = materialize(gone.groupBy("row").agg(F.collect_list("line").alias("_listed")).withColumnRenamed("row", "_row"), "drops")
    last = now.join(small_side(listed, 256), "_row", "left")
    names = [c for c in now.columns if c != "_row"]
    return last.select(*names, "_listed").mapInArrow(_drop_listed(names, digest), now.drop("_row").schema)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for every row of docs."""
    done = _dropped(docs, [], True, min_chars, min_docs, index_bytes, shard_keys)
    return done.select(F.col("_id").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.col("_text").cast("string").alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with the repeated lines dropped from text; n_chars, where there is one, counts what stays of changed texts."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = _dropped(docs, rest, False, min_chars, min_docs, index_bytes, shard_keys)
    out = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("_id").cast(docs.schema["doc_id"].dataType), "text": F.col("_text").cast("string")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_gone") > 0, F.char_length(out["text"])).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[out[c].alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


_KEY = "translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
o AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.top AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
