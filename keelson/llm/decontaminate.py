"""Benchmark decontamination as a prefix-filtered set join.

A window is WINDOW consecutive words of an item (a shorter item is one window). Its set is its shingles; containment
must be whole, so of a window's shingles, ordered from the rarest by their counts over all documents, a prefix of one is
necessary: a document that holds the window holds its rarest shingle. Documents look for these prefix shingles alone
and give for each place found a slice of the words around it; the slices join the windows on the shingle, the length
and the position in the window bound where a match can start and end, and the words decide.

Texts are read twice and never shuffled: the joined rows are a shingle and at most 2 * WINDOW words. Up to IN_ROW
shingles are looked for as they are. More of them are put into a Bloom filter of at most BLOOM_BITS bits, a literal that
the same expressions ask; what it lets through wrongly is met by the join, so results do not depend on it.

A window is joined by its number; the items that hold it are fetched for matches alone. A side is broadcast only if its
measured bytes are few.

Defined cases: null and empty texts have no words, no hits and are clean; items without words are no windows, equal
items count each by its item_id, null item_ids are ignored; repeated rows are judged each; other columns pass through
`drop_contaminated` and are ignored by the query; an empty table or benchmark gives no hits.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_words, materialize, measured_side, numbered, read_table, small_side

WINDOW, SHINGLE = 10, 2
#: Up to so many shingles are listed in the row's expressions; more go into a filter of at least and at most so many bits.
IN_ROW = 100_000
BLOOM_LEAST, BLOOM_BITS, PROBES = 1 << 16, 1 << 23, 4


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(words, item_id) for every distinct window of every item."""
    words = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), code_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return words.select("item_id", "w", F.explode(starts).alias("i")).select(F.slice("w", F.col("i") + 1, window).alias("words"), "item_id").distinct()


def _shingle(words: Column, i: Column, size: int) -> Column:
    """The size words from i, joined by blanks: a string that holds no other shingle's bounds."""
    out = F.get(words, i)
    for k in range(1, size):
        out = F.concat(out, F.lit(" "), F.get(words, i + k))
    return out


def _places(words: Column, size: int) -> Column:
    """Every place where size words start."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))


def _slots(h: Column, bits: int) -> list[Column]:
    """The places of a 64-bit hash; its halves are combined, so that no sum leaves 64 bits."""
    low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32)
    return [F.pmod(low + high * F.lit(k), F.lit(bits)) for k in range(PROBES)]


class Tokens:
    """Which tokens may be among those of the written table (token, size): a list of each size if they are few, else a filter."""

    def __init__(self, table: DataFrame):
        self.listed: dict[int, list[str]] | None = None
        n = table.count()
        if n <= IN_ROW:
            self.listed = {}
            for r in table.collect():
                self.listed.setdefault(r["size"], []).append(r["token"])
            return
        self.bits = min(BLOOM_BITS, max(BLOOM_LEAST, 1 << (12 * n).bit_length()))
        slots = table.select(F.explode(F.array(*_slots(F.xxhash64("token"), self.bits))).alias("s"))
        words = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 31))")).alias("b"))
        filled = {r["w"]: r["b"] for r in words.collect()}  # at most BLOOM_BITS / 32 rows
        self.filter = json.dumps([filled.get(w, 0) for w in range(self.bits // 32)])

    def has(self, size: int) -> bool:
        return self.listed is None or size in self.listed

    def __call__(self, token: Column, size: int) -> Column:
        if self.listed is not None:
            return token.isin(self.listed.get(size, []))
        words = F.from_json(F.lit(self.filter), "array<long>")
        set_bit = lambda s: F.call_function("shiftright", F.get(words, F.shiftright(s, 5).cast("int")), s.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(Column.__and__, map(set_bit, _slots(F.xxhash64(token), self.bits)))


def _held(words: Column, size: int, tokens: Tokens) -> Column:
    """The shingles in the words that may be among the tokens, repeats included."""
    return F.filter(F.transform(_places(words, size), lambda i: _shingle(words, i, size)), lambda t: tokens(t, size))


def _spots(words: Column, size: int, tokens: Tokens, window: int) -> Column:
    """Every place of a shingle that may be among the tokens, with the words that a window over it can reach."""
    at = F.filter(_places(words, size), lambda i: tokens(_shingle(words, i, size), size))
    first = lambda i: F.greatest(i - (window - 1), F.lit(0))
    return F.transform(at, lambda i: F.struct(i.alias("at"), _shingle(words, i, size).alias("token"), first(i).alias("from"), F.slice(words, first(i) + 1, 2 * window - 1).alias("near")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two written tables: base (row, doc_id, n_words) for every row of docs, and hits (row, n_hit, items)."""
    owners = materialize(_windows(items, window), "owners")
    windows = materialize(owners.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words"), "windows")
    owners = materialize(owners.join(windows, "words").select("wid", "item_id"), "owners")
    long = F.size("words") >= shingle
    shingles = windows.select("wid", "words", F.explode(F.when(long, F.transform(_places(F.col("words"), shingle), lambda i: F.struct(i.alias("off"), _shingle(F.col("words"), i, shingle).alias("token")))).otherwise(F.array(F.struct(F.lit(0).alias("off"), F.concat_ws(" ", "words").alias("token"))))).alias("s"))
    shingles = shingles.select("wid", "words", "s.off", "s.token", F.when(long, shingle).otherwise(F.size("words")).alias("size"))
    tokens = materialize(shingles.select("token", "size").distinct(), "tokens")

    given = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").alias("doc_id"), code_words(F.col("text")).alias("w"))
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect())
    every = Tokens(tokens)

    # how often each shingle of a window stands in the documents
    found = [_held(F.col("w"), s, every) for s in sizes]
    if sizes:
        seen = given.select(F.explode(F.concat(*found)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        seen = materialize(seen if every.listed is not None else seen.join(tokens.select("token").distinct(), "token", "left_semi"), "counts")
        counted = shingles.join(measured_side(seen, F.octet_length("token") + 16), "token", "left").fillna(0, ["n"])
    else:
        counted = shingles.withColumn("n", F.lit(0).cast("long"))
    rarest = F.min(F.struct("n", "token", "off", "size")).alias("k")
    index = materialize(counted.groupBy("wid", "words").agg(rarest).select("wid", "words", "k.token", "k.off", "k.size"), "index")
    prefix = Tokens(materialize(index.select("token", "size").distinct(), "prefix"))

    places = [_spots(F.col("w"), s, prefix, window) for s in sizes if prefix.has(s)]
    none = F.array().cast("array<struct<at:int,token:string,from:int,near:array<string>>>")
    base = materialize(given.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), (F.concat(*places) if places else none).alias("places")), "places")
    spots = base.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    start, length = F.col("at") - F.col("off"), F.size("words")
    width = F.octet_length(F.concat_ws(" ", "words")) + F.octet_length("token") + 16 * F.size("words") + 64
    joined = spots.join(measured_side(index, width), "token").where((start >= 0) & (start + length <= F.col("n_words")))
    matched = joined.where(F.slice("near", start - F.col("from") + 1, length) == F.col("words")).select("row", start.alias("s"), (start + length).alias("e"), "wid")
    matched = materialize(matched, "matched")
    held = matched.select("row", "wid").distinct().join(measured_side(owners, F.octet_length("item_id") + 32), "wid").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    runs = matched.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("runs")).join(held, "row")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("runs", zero, lambda acc, r: F.struct((acc["n"] + F.greatest(r["e"] - F.greatest(r["s"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], r["e"]).alias("to")), lambda acc: acc["n"])
    hits = materialize(runs.select("row", covered.alias("n_hit"), "items"), "hits")
    return base.select("row", "doc_id", "n_words"), hits


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    base, hits = contamination(docs, items, window, shingle)
    ids = F.coalesce("items", F.array().cast("array<string>"))
    out = base.join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that hold no window."""
    rows, row = numbered(docs)
    _, hits = contamination(rows, items, window, shingle, row)
    return rows.join(small_side(hits.select(F.col("row").alias(row)), 32), row, "left_anti").drop(row)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_W} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
dg AS (SELECT doc_id, i, n, list_slice(w, i + 1, i + n) AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dg JOIN win ON dg.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
