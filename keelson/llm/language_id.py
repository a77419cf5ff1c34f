"""Language identification, words first, backing off to character n-grams.

A word that the training sample knows scores by its log frequency in each language. An unseen word is marked as
<word> and covered from the left by the longest known character n-grams (ORDERS from 5 down to 1); each gram scores by
its log frequency in each language, a character that no order knows by the floor of single characters. (A penalty for an
order given up would be the same for all languages, so there is none.) A text's language has the highest sum over its
words; the score is its share after a softmax.

The labelled rows that are learned from are bounded: the LANGUAGES languages with most rows (of equal counts the first by
name) give about PER_LANGUAGE documents each, chosen by a hash of their ids, and fewer if these hold more than SAMPLE_BYTES
together. The model keeps every gram of them, for each gram the languages alone that have it. Whole texts are read, in
training and prediction.

Defined cases: a null text or one without a letter is `und` with score 0; with nothing learned everything is `und`;
ties go to the language that comes first by name; null languages are not learned from; repeated rows are predicted
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, read_table, small_side

FOLDS, FOLD = 4, 2
#: Bounds of the labelled rows.
PER_LANGUAGE, LANGUAGES, SAMPLE_BYTES = 1000, 1000, 64 << 20
SMOOTHING = 0.1
ORDERS = (5, 4, 3, 2, 1)
#: Words that are scored at once.
BLOCK = 100_000
#: Words whose scores a worker remembers.
_CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(marked: str, order: int):
    return (marked[i : i + order] for i in range(len(marked) - order + 1))


def _count(batches):
    """(lang, order, gram, n) of each batch; order 0 are words."""
    for batch in batches:
        found: dict[str, list[Counter]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts = found.setdefault(lang, [Counter() for _ in range(len(ORDERS) + 1)])
            counts[0].update(words_of(text))
        for counts in found.values():
            for word, n in counts[0].items():
                for order in ORDERS:
                    for gram in _grams(f"<{word}>", order):
                        counts[order][gram] += n
        rows = [(lang, k, gram, n) for lang, counts in found.items() for k, c in enumerate(counts) for gram, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "k", "gram", "n"])


class BackoffModel:
    """Log frequencies by language of words (order 0) and character n-grams, from a table (k, gram, at, n): the languages that have the gram, and how often."""

    def __init__(self, langs: list[str], table: pa.Table):
        self.langs, self.table = langs, table
        order = table.column("k").to_numpy()
        at, n = (np.fromiter(chain.from_iterable(table.column(c).to_pylist()), dtype=t) for c, t in (("at", np.int64), ("n", np.float64)))
        sizes = np.fromiter(map(len, table.column("at").to_pylist()), dtype=np.int64, count=len(order))
        self.starts = np.concatenate([[0], np.cumsum(sizes), [sizes.sum()]]).astype(np.int64)  # the last row, an unknown character, has none
        self.at = at
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}  # of all orders: a gram's length tells its order
        for i, (k, gram) in enumerate(zip(order.tolist(), table.column("gram").to_pylist(), strict=True)):
            (self.grams if k else self.words)[gram] = i
        self.order = np.append(order, ORDERS[-1]).astype(np.int64)
        # a row adds its order's floor for all languages, and log((n + smoothing) / smoothing) for those that have the gram
        self.floors = np.zeros((max(ORDERS) + 1, len(langs)))
        of = np.repeat(order, sizes)
        for k in (0, *ORDERS):
            whole = np.bincount(at[of == k], weights=n[of == k], minlength=len(langs)) + SMOOTHING * ((order == k).sum() + 1)
            self.floors[k] = np.log(SMOOTHING / whole)
        self.gains = np.log((n + SMOOTHING) / SMOOTHING)
        self._seen: dict[str, tuple[int, ...]] = {}

    def score(self, rows: list[int]) -> np.ndarray:
        """The summed logs of the rows, by language."""
        rows = np.array(rows, dtype=np.int64)
        start, size = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        places = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        found = np.bincount(self.at[places], weights=self.gains[places], minlength=len(self.langs))
        return found + np.bincount(self.order[rows], minlength=len(self.floors)) @ self.floors

    def rows(self, word: str) -> tuple[int, ...]:
        """The rows of the table that a word scores by."""
        got = self._seen.get(word)
        if got is None:
            if len(self._seen) >= _CACHE_WORDS:
                self._seen.clear()
            at = self.words.get(word)
            got = self._seen[word] = self._back_off(f"<{word}>") if at is None else (at,)
        return got

    def _back_off(self, marked: str) -> tuple[int, ...]:
        out, at, grams = [], 0, self.grams
        while at < len(marked):
            for order in ORDERS:
                gram = marked[at : at + order]
                if gram in grams:
                    out.append(grams[gram])
                    at += len(gram)
                    break
            else:
                out.append(len(self.order) - 1)
                at += 1
        return tuple(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), BLOCK):
            total += self.score(list(chain.from_iterable(map(self.rows, words[i : i + BLOCK]))))
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(share[best] / share.sum())


def train(docs: DataFrame, skip=None, per_language: int = PER_LANGUAGE) -> BackoffModel:
    """Learns from docs (doc_id, text, lang), rows where skip holds left out."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    if skip is not None:
        rows = rows.where(~skip(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = materialize(sizes.orderBy(F.desc("rows"), "lang").limit(LANGUAGES), "languages")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("rows"))
    whole = sizes.agg(F.sum(share * F.col("bytes"))).first()[0] or 1.0
    share = share * F.lit(min(1.0, SAMPLE_BYTES / max(whole, 1.0)))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    given = rows.join(small_side(sizes.select("lang", share.alias("share")), 64), "lang").where(chosen)
    counts = given.select("lang", "text").mapInArrow(_count, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in sizes.collect())
    number = docs.sparkSession.createDataFrame(list(enumerate(langs)), "at int, lang string")
    grams = counts.join(F.broadcast(number), "lang").groupBy("k", "gram").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("by"))  # at most LANGUAGES of them
    return BackoffModel(langs, grams.orderBy("k", "gram").select("k", "gram", F.col("by.at").alias("at"), F.col("by.n").alias("n")).toArrow())


def _predict(model):
    def run(batches):
        langs, data = model.value
        m = BackoffModel(langs, pa.ipc.open_stream(data).read_all())
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})

    return run


def identify_language(docs: DataFrame, model: BackoffModel) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, model.table.schema) as out:
        out.write_table(model.table)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, sink.getvalue().to_pybytes()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    skip = lambda i: held_out(i, FOLDS, FOLD)
    found = identify_language(docs, train(docs, skip))
    return found.select("doc_id", skip(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
