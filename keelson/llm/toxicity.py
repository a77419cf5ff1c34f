"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Labels are learned from a sample of labelled documents outside the held-out fold: those that stand in the documents, the
smallest by a hash of their ids, at most SAMPLE of them and at most COORDINATES coordinates together (the texts are whole;
the first document beyond the bound ends the sample). Texts become coordinates where they are read; the coordinates alone
travel, to one task that learns and returns the weights that L1 leaves. These sparse weights (at most 2 ** BITS) are
broadcast, and every whole text is scored where it is read.

Defined cases: null and empty texts score by the bias; a document that is labelled twice counts as toxic if any label
says so; null labels and ids are not learned from; repeated rows are scored each; without any label every score is 0;
other columns pass through `reject_toxic` and are ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, held_out, materialize, read_table, small_side
from .hashed_text import BITS, Ftrl, Hasher, sigmoid

#: Labelled documents that are learned from, and their coordinates (4 bytes each) together.
SAMPLE, COORDINATES = 16_000, 1 << 25
FOLDS, FOLD = 5, 0
THRESHOLD = 0.5


def _coordinates(batches):
    hasher = Hasher()
    for batch in batches:
        at = [hasher(t.as_py()).astype("<u4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "y": batch.column("y"), "at": pa.array(at, pa.binary())})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, skip=None) -> DataFrame:
    """The written (_id, y, at) of at most rows labelled documents of docs, from all over the table."""
    y = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id IS NOT NULL AND y IS NOT NULL")
    if skip is not None:
        y = y.where(~skip(F.col("_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"))
    there = y.groupBy("_id").agg(F.max("y").alias("y")).join(texts.select("_id"), "_id", "left_semi")
    chosen = materialize(there.orderBy(F.xxhash64("_id"), "_id").limit(rows), "chosen")
    found = texts.join(small_side(chosen, 32), "_id").groupBy("_id").agg(F.first("y").alias("y"), F.max("text").alias("text"))
    return materialize(found.select("_id", "y", "text").mapInArrow(_coordinates, "_id long, y int, at binary"), "sample")


def _learn(classes: list[int], ftrl: Ftrl, most: int):
    """For each class a row (class, coordinate, weight), the bias at coordinate -1; rows come in the order of the sample."""

    def run(batches):
        rows, y, left = [], [], most
        for batch in batches:
            for at, label in zip(batch.column("at"), batch.column("y").to_pylist(), strict=True):
                own = np.frombuffer(at.as_py(), dtype="<u4")
                left -= len(own)
                if left >= 0:
                    rows.append(own)
                    y.append(label)
        if not rows:
            return
        y = np.array(y)
        for c in classes:
            at, w, bias = ftrl.fit(rows, (y == c).astype(float))
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at) + 1, c, dtype=np.int32)), "at": pa.array(np.append(at, -1)), "w": pa.array(np.append(w, bias))})

    return run


def train(sample: DataFrame, classes: list[int], ftrl: Ftrl | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Class -> coordinates, weights, bias; empty without a labelled row. One one-against-rest model for each class."""
    ordered = sample.coalesce(1).sortWithinPartitions(F.xxhash64("_id"), "_id")  # at most SAMPLE rows, whatever the input
    got = ordered.mapInArrow(_learn(classes, ftrl or Ftrl(), COORDINATES), "k int, at long, w double").toPandas()
    models = {}
    for k, part in got.groupby("k"):
        own = part[part["at"] >= 0]
        models[int(k)] = (own["at"].to_numpy(np.int64), own["w"].to_numpy(np.float64), float(part.loc[part["at"] < 0, "w"].iloc[0]))
    return models


def _score(model, names: list[str], out: str):
    """Appends the score of _text, and takes _text away."""

    def run(batches):
        weights, hasher = np.zeros(1 << BITS), Hasher()
        if model.value:
            at, w, bias = model.value
            weights[at] = w
        for batch in batches:
            scores = [float(sigmoid(weights[hasher(t.as_py())].sum() + bias)) if model.value else 0.0 for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(scores, pa.float64())], names=[*names, out])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, sample: int = SAMPLE, ftrl: Ftrl | None = None) -> DataFrame:
    """Every row of docs with `score` and `predicted`; the text stays if docs has one."""
    skip = lambda i: held_out(i, FOLDS, FOLD)
    models = train(labelled_sample(docs if learn_from is None else learn_from, labels, "toxic", sample, skip), [1], ftrl)
    model = docs.sparkSession.sparkContext.broadcast(models.get(1))
    score = fresh(docs.columns, "score")
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("binary").alias("_text"))
    names = given.columns[:-1]
    scored = given.mapInArrow(_score(model, names, "s"), given.drop("_text").schema.add("s", "double"))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("s").alias(score))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score below the threshold."""
    scored = toxicity_scores(docs, labels, sample=sample)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
