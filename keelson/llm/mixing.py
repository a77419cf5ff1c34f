"""Soft-membership mixing to target weights.

A classifier learned from a labelled table (one FTRL model for each domain, one against the rest, scaled to sum to 1)
gives every document a posterior over the domains. The rates r >= 0 of the documents minimise

    1/2 sum_d (s_d - t_d)^2 + ridge/2 sum_i (n_i / N) (r_i - 1)^2,   s_d = sum_i r_i n_i p_id / N

with n_i tokens of document i, N tokens in all and t_d = budget * weight_d: expected token totals of the domains match
the targets, and of all rates that match, those stay nearest to 1. Projected gradient with momentum does this: a step
needs only s, one small row of sums over a written table of (n, p); a document's rate follows from its own p and the
few numbers of the steps since they were last written, so rates are never shuffled or collected. Every CARRY steps the
table is written with its rates, so a step costs the same however many came before.

Descent ends when the projected gradient (in the norm weighted by tokens) is below TOLERANCE, which bounds the objective's
distance to its optimum by TOLERANCE ** 2 / (2 * ridge); momentum restarts when it points uphill. If STEPS do not suffice,
the operator raises an error and returns no rates.

A rate above or below a whole number is rounded by a hash of the document's id and position-free content length, so the
expected copies equal the rate and reruns agree.

Defined cases: null and empty texts have no tokens, take part with rate 1 and move no total; domains that no label
names, or that no document can fill, stay below target; weights are scaled to sum to 1; without labels all posteriors
are equal; repeated rows are rated each; a domain of one label value gets posterior 1; other columns pass through
`apply_mixture`; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read_table
from .hashed_text import BITS, Hasher, sigmoid
from .toxicity import labelled_sample, train

#: Domains (values of labels.quality) and the share of tokens that each shall have.
TARGETS = {0: 0.05, 1: 0.95}
BUDGET, RIDGE = 1.0, 1e-3
SAMPLE = 8_000
#: Steps after which descent is given up, its end, and the steps between two writings of the rates.
STEPS, TOLERANCE, CARRY = 500, 1e-4, 16


class Posteriors:
    """Tokens and domain posteriors of texts."""

    def __init__(self, models, domains: list[int]):
        self.tables, self.hasher = [], Hasher()
        for d in domains:
            w, bias = np.zeros(1 << BITS), -35.0
            if d in models:
                at, values, bias = models[d]
                w[at] = values
            self.tables.append((w, bias))

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        n, p = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), len(self.tables)))
        for i, text in enumerate(t.as_py() for t in texts):
            at = self.hasher(text)
            n[i] = self.hasher.n_words
            p[i] = [float(sigmoid(w[at].sum() + bias)) for w, bias in self.tables]
        return n, p / p.sum(axis=1, keepdims=True)


def _members(models, domains: list[int]):
    """(doc_id, n, p) of every text, and the rates to start from."""

    def run(batches):
        posteriors = Posteriors(models.value, domains)
        for batch in batches:
            n, p = posteriors(batch.column("text"))
            one = pa.array(np.ones(len(n)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n), "p": pa.array(p.tolist(), pa.list_(pa.float64())), "rate": one, "ahead": one})

    return run


class Descent:
    """The steps since the rates were last written: enough to go on from any document's rates with its posteriors."""

    def __init__(self, targets: np.ndarray, ridge: float):
        self.targets, self.ridge, self.step = targets, ridge, 1.0 / (1.0 + ridge)
        self.steps: list[tuple[np.ndarray, float]] = []  # s - t at the looked-ahead rates, and the momentum that follows

    def forward(self, p: np.ndarray, rate: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rates after the steps, the looked-ahead rates, and the last two differences of the rates and from the looked-ahead ones."""
        move = slope = np.zeros(len(p))
        for gap, momentum in self.steps:
            new = np.maximum(0.0, ahead - self.step * (p @ gap + self.ridge * (ahead - 1.0)))
            move, slope = new - rate, (ahead - new) / self.step
            rate, ahead = new, new + momentum * (new - rate)
        return rate, ahead, move, slope

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p, np.ones(len(p)), np.ones(len(p)))[0]


def _columns(batch, *names: str) -> list[np.ndarray]:
    get = lambda c: np.stack(batch.column(c).to_numpy(zero_copy_only=False)) if c == "p" else batch.column(c).to_numpy(zero_copy_only=False).astype(float)
    return [get(c) for c in names]


def _sums(descent: Descent):
    """Totals of the looked-ahead rates, the squared gradient and how far momentum points uphill, of each batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, p, rate, ahead = _columns(batch, "n", "p", "rate", "ahead")
                rate, ahead, move, slope = descent.forward(p, rate, ahead)
                yield pa.RecordBatch.from_pydict({"s": pa.array([((ahead * n) @ p).tolist()], pa.list_(pa.float64())), "g": pa.array([float(n @ slope**2)]), "up": pa.array([float(n @ (slope * move))]), "n": pa.array([n.sum()])})

    return run


def _carried(descent: Descent):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, rate, ahead = _columns(batch, "p", "rate", "ahead")
                rate, ahead, _, _ = descent.forward(p, rate, ahead)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("p"), pa.array(rate), pa.array(ahead)], names=["doc_id", "n", "p", "rate", "ahead"])

    return run


def fit_rates(members: DataFrame, targets: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> Descent:
    """Descends to the tolerance over the written table members (doc_id, n, p, rate, ahead); the whole way from rate 1."""
    descent, way, momentum = Descent(targets, ridge), Descent(targets, ridge), 0
    for _ in range(steps + 1):
        row = members.select("n", "p", "rate", "ahead").mapInArrow(_sums(descent), "s array<double>, g double, up double, n double").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(len(targets))], F.sum("g").alias("g"), F.sum("up").alias("up"), F.sum("n").alias("n")).first()
        n = row["n"] or 0.0
        if n == 0 or descent.steps and row["g"] / n < tolerance**2:
            return way
        momentum = 0 if row["up"] > 0 else momentum + 1
        step = (np.array([row[f"s{i}"] for i in range(len(targets))]) / n - targets, momentum / (momentum + 3))
        way.steps.append(step)
        descent.steps.append(step)
        if len(descent.steps) >= CARRY:
            members = materialize(members.mapInArrow(_carried(descent), members.schema), "rates")
            descent = Descent(targets, ridge)  # whose next sums see no last step and so no gradient yet
    raise RuntimeError(f"mixing rates did not converge in {steps} steps: squared gradient {row['g'] / n}")


def _final(descent: Descent, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rates after all steps; texts without tokens keep rate 1."""
    return np.where(n > 0, descent.rates(p), 1.0)


def _rated(shared):
    def run(batches):
        for batch in batches:
            p = np.stack(batch.column("p").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(shared.value.targets)))
            rate = _final(shared.value, batch.column("n").to_numpy(zero_copy_only=False), p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return run


def _rate_texts(models, domains: list[int], shared, names: list[str]):
    """Appends tokens and rate, and takes _text away."""

    def run(batches):
        posteriors = Posteriors(models.value, domains)
        for batch in batches:
            n, p = posteriors(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(n), pa.array(_final(shared.value, n, p))], names=[*names, "n", "rate"])

    return run


def _copies(doc_id: str, n: str, rate: str):
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col(doc_id).cast("long"), n), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("int")).cast("int")


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[int, float] | None = None, learn_from: DataFrame | None = None, budget: float = BUDGET, ridge: float = RIDGE, domain: str = "quality", sample: int = SAMPLE):
    """The broadcast classifier, the sorted domains, the written members (doc_id, n, p) and the broadcast descent."""
    targets = targets or TARGETS
    domains = sorted(targets)
    share = np.array([targets[d] for d in domains], dtype=float)
    learned = train(labelled_sample(docs if learn_from is None else learn_from, labels, domain, sample), domains)
    context = docs.sparkSession.sparkContext
    models = context.broadcast(learned)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    members = materialize(given.mapInArrow(_members(models, domains), "doc_id long, n long, p array<double>, rate double, ahead double"), "members")
    return models, domains, members, context.broadcast(fit_rates(members, budget * share / share.sum(), ridge))


def mixture_rates(docs: DataFrame, labels: DataFrame, targets: dict[int, float] | None = None, learn_from: DataFrame | None = None, **more) -> DataFrame:
    """doc_id, n (tokens), p (posteriors in the order of the sorted domains), rate and copies for every row of docs."""
    _, _, members, shared = fit_mixture(docs, labels, targets, learn_from, **more)
    rated = members.select("doc_id", "n", "p").mapInArrow(_rated(shared), "doc_id long, n long, p array<double>, rate double")
    return rated.withColumn("copies", _copies("doc_id", "n", "rate"))


def apply_mixture(docs: DataFrame, labels: DataFrame, targets: dict[int, float] | None = None, learn_from: DataFrame | None = None, **more) -> DataFrame:
    """The rows of docs that the mixture takes at least once, with rate and copies.

    The texts' posteriors are computed again where they are read, so no text is shuffled to meet its rate.
    """
    models, domains, _, shared = fit_mixture(docs, labels, targets, learn_from, **more)
    rate, copies = fresh(docs.columns, "rate"), fresh(docs.columns, "copies")
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("binary").alias("_text"))
    names = given.columns[:-1]
    rated = given.mapInArrow(_rate_texts(models, domains, shared, names), given.drop("_text").schema.add("n", "long").add("rate", "double"))
    key = f"c{docs.columns.index('doc_id')}"
    out = rated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("rate").alias(rate), _copies(key, "n", "rate").alias(copies))
    return out.where(F.col(copies) > 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rates = mixture_rates(docs, read_table(spark, sf_dir, "labels"))
    posteriors = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return rates.select("doc_id", F.col("n").alias("n_tokens"), *posteriors, "rate", "copies")
