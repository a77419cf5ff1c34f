"""SimHash fingerprints and their exact pairs by vantage-point trees.

Linking. Two fingerprints at R or fewer differing bits agree to within R // 2 bits in the left or the right half.
Each half has a vantage-point tree, built on the driver from a bounded sample of fingerprints: a node holds a vantage
fingerprint v and a radius mu, d(x, v) <= mu goes inside, and by the triangle inequality every partner of an outside
point within r = R // 2 has d(x, v) > mu - r, so points in that overlap go to both sides. Every close pair thus meets
in a leaf of one of the trees. A leaf is a shard.

A leaf that holds more than SHARD_ROWS distinct fingerprints gets a tree of its own, built by a task from a bounded
sample of its points, and its points are dealt again; this goes on, level by level, as long as trees make leaves
smaller, so leaves keep their size however many points there are. The points of a leaf that no tree splits are cut into
tiles, and each pair of tiles is a task of its own. A task compares its fingerprints exactly (all 64 bits) and returns
a spanning forest of the links, never the pairs; components come from the forests.

Equal fingerprints meet in one row before any of this, so thousands of copies are one point.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows share a fingerprint
and a component; a null doc_id takes the smallest other id of its component, null if there is none; other columns
are ignored; an empty table gives an empty result. Long texts are hashed in blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, materialize, read_table
from .components import connected_components

#: Shingles hashed at once.
BLOCK = 1 << 18
#: Fingerprints that a tree is built from.
SAMPLE = 20_000
#: Fingerprints of one leaf that the trees aim at, and the most in one tile.
LEAF_ROWS, SHARD_ROWS = 1024, 2048
#: Rows of shards that one partition takes.
TASK_ROWS = 200_000
#: Levels of trees below the first.
DEPTH = 8


def shingle_hashes(text: bytes | None, words: int):
    """Blocks of XXH64 (seed 42) hashes of the text's shingles; a text of fewer words is one shingle."""
    tokens = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not tokens:
        return
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    for i in range(0, n, BLOCK):
        s, e = starts[i : min(n, i + BLOCK)].tolist(), last[i : i + BLOCK].tolist()
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, s, e)), repeat(42)), dtype=np.uint64, count=len(s))


def fingerprint(blocks) -> int:
    """Bit k is set if over half the hashes have it."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        for i in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(shingle_hashes(text.as_py(), words)) for text in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(prints, dtype=np.uint64).view(np.int64))})

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs, over whole texts."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(_fingerprints(words), "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree over some bits of 64-bit fingerprints, as arrays."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: float, seed: int = 0):
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage, self.mu, self.inner, self.outer = [], [], [], []
        self._rng = np.random.default_rng(seed)
        self._build(sample & self.mask, leaf)
        self.vantage, self.mu = np.array(self.vantage, dtype=np.uint64), np.array(self.mu)

    def _build(self, points: np.ndarray, leaf: float) -> int:
        at = len(self.mu)
        self.vantage.append(0), self.mu.append(-1), self.inner.append(-1), self.outer.append(-1)
        best = None
        if len(points) > leaf:
            for v in self._rng.choice(points, size=min(8, len(points)), replace=False):
                counts = np.bincount(np.bitwise_count(points ^ v), minlength=65)
                inside = np.cumsum(counts)
                for mu in np.unique(np.searchsorted(inside, [0.35 * len(points), 0.5 * len(points), 0.65 * len(points)])):
                    a = inside[mu]
                    b = len(points) - (inside[mu - self.radius] if mu >= self.radius else 0)
                    if a < len(points) and b < len(points) and (best is None or a * a + b * b < best[0]):
                        best = (a * a + b * b, v, int(mu))
        if best and best[0] < 0.95 * len(points) ** 2:
            _, v, mu = best
            d = np.bitwise_count(points ^ v)
            self.vantage[at], self.mu[at] = int(v), mu
            self.inner[at] = self._build(points[d <= mu], leaf)
            self.outer[at] = self._build(points[d.astype(int) > mu - self.radius], leaf)
        return at

    def pack(self) -> bytes:
        parts = [np.array([self.mask, self.radius], dtype="<u8"), self.vantage.astype("<u8"), *(np.array(x, dtype="<i8") for x in (self.mu, self.inner, self.outer))]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, blob: bytes) -> VantageTree:
        tree, words = cls.__new__(cls), np.frombuffer(blob, dtype="<u8")
        tree.mask, tree.radius = words[0], int(words[1])
        tree.vantage, *rest = np.split(words[2:], 4)
        tree.mu, tree.inner, tree.outer = (x.view("<i8") for x in rest)
        return tree

    def route(self, points: np.ndarray):
        """Pairs of leaf number and the positions of the points that go there."""
        todo = [(0, np.arange(len(points)))]
        points = points & self.mask
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.mu[node] < 0:
                yield node, at
                continue
            d = np.bitwise_count(points[at] ^ self.vantage[node]).astype(int)
            todo += [(self.inner[node], at[d <= self.mu[node]]), (self.outer[node], at[d > self.mu[node] - self.radius])]


def link_forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the points (distinct, unsigned) at radius or fewer bits; every pair is compared."""
    n, edges = len(points), []
    step = max(1, (1 << 21) // max(1, n))
    close = np.zeros(n, dtype=bool)
    for i in range(0, n, step):
        close[i : i + step] = (np.bitwise_count(points[i : i + step, None] ^ points[None, :]) <= radius).sum(axis=1) > 1
    points = points[close]
    label = np.arange(len(points))
    for i in range(0, len(points), step):
        near = np.bitwise_count(points[i : i + step, None] ^ points[None, :]) <= radius
        for k in range(len(near)):
            at = np.nonzero(near[k])[0]
            labels, first = np.unique(label[at], return_index=True)
            if len(labels) > 1:
                edges += [(int(points[i + k]), int(points[at[j]])) for j, x in zip(first, labels, strict=True) if x != label[i + k]]
                label[np.isin(label, labels)] = labels[0]
    return edges


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forests(radius: int):
    """Edges of the forests of all tasks of a partition that is sorted by task; holds one task at a time."""

    def run(batches):
        tasks, points = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            tasks = np.concatenate([tasks, batch.column("task").to_numpy(zero_copy_only=False)])
            points = np.concatenate([points, batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            done = np.searchsorted(tasks, tasks[-1]) if len(tasks) else 0
            yield _edges(tasks[:done], points[:done], radius)
            tasks, points = tasks[done:], points[done:]
        yield _edges(tasks, points, radius)

    return run


def _edges(tasks: np.ndarray, points: np.ndarray, radius: int) -> pa.RecordBatch:
    edges = []
    for own in np.split(points, np.nonzero(np.diff(tasks))[0] + 1):
        edges += link_forest(np.unique(own), radius)
    return pa.RecordBatch.from_pydict({"a": pa.array([_signed(a) for a, _ in edges], pa.int64()), "b": pa.array([_signed(b) for _, b in edges], pa.int64())})


def shard_edges(shards: DataFrame, radius: int) -> DataFrame:
    """Spanning edges within each shard of the distinct rows (shard, fp). Shards above SHARD_ROWS go in pairs of tiles."""
    shards = materialize(shards.distinct(), "shards")
    sizes = materialize(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    tiles = F.ceil(F.col("n") / F.lit(float(SHARD_ROWS))).cast("long")
    rows = shards.join(sizes, "shard").select("shard", "fp", tiles.alias("tiles")).withColumn("t", F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.col("tiles")))
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("shard", "fp", "t", other.alias("o")).select("fp", F.xxhash64("shard", F.least("t", "o"), F.greatest("t", "o")).alias("task"))
    # a count of partitions of its own: the rows are few bytes and much work, and would be merged into few tasks
    parts = max(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards.count() // TASK_ROWS))
    return rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_forests(radius), "a long, b long")


def _leaf_ids(shard: int, node: int) -> int:
    """The number of a leaf of a shard's own tree; the lowest bit keeps telling the half of the bits."""
    mixed = xxhash.xxh64_intdigest(np.array([shard, node], dtype="<i8").tobytes())
    return _signed(mixed & ~1 | shard & 1)


def _own_tree(leaf_rows: int, masks: tuple[int, ...], radius: int):
    """The tree of a shard from a sample (shard, n, fp) of its points; no row if no split makes it smaller."""

    def build(rows: pa.Table) -> pa.Table:
        shard, n = rows.column("shard")[0].as_py(), rows.column("n")[0].as_py()
        sample = np.sort(rows.column("fp").to_numpy()).view(np.uint64)
        tree = VantageTree(sample, masks[shard & 1], radius, max(2.0, leaf_rows * len(sample) / n), shard & 0x7FFFFFFF)
        found = [(shard, tree.pack())] if len(tree.mu) > 1 else []
        return pa.table({"shard": pa.array([s for s, _ in found], pa.int64()), "blob": pa.array([b for _, b in found], pa.binary())})

    return build


def _route_own(tree: VantageTree, rows: pa.RecordBatch):
    signed, shard = rows.column("fp").to_numpy(zero_copy_only=False).astype(np.int64), rows.column("shard")[0].as_py()
    for node, at in tree.route(signed.view(np.uint64)):
        yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(at), _leaf_ids(shard, node), dtype=np.int64)), "fp": pa.array(signed[at])})


def vantage_shards(prints: DataFrame, radius: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(shard, fp): every pair of the distinct fingerprints within the radius shares a shard."""
    spark, n = prints.sparkSession, prints.count()
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    leaf = max(2.0, leaf_rows * len(sample) / max(1, n))
    masks = (0xFFFFFFFF, 0xFFFFFFFF00000000)
    trees = [VantageTree(sample, m, radius // len(masks), leaf, k) for k, m in enumerate(masks)]

    def route(batches):
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tree in enumerate(trees):
                for node, at in tree.route(signed.view(np.uint64)):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(at), 2 * node + k, dtype=np.int64)), "fp": pa.array(signed[at])})

    now, done = materialize(prints.select("fp").mapInArrow(route, "shard long, fp long"), "leaves"), []
    for _ in range(DEPTH):
        sizes = materialize(now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS), "oversize")
        if sizes.isEmpty():
            break
        chance = F.pmod(F.xxhash64(F.lit("tree"), "fp"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
        chosen = now.join(sizes, "shard").where(chance).select("shard", "n", "fp")
        own = materialize(chosen.groupBy("shard").applyInArrow(_own_tree(leaf_rows, masks, radius // len(masks)), "shard long, blob binary"), "trees")
        salts = F.ceil(F.col("n") / F.lit(float(TASK_ROWS))).cast("long").alias("salts")
        dealt = materialize(own.join(sizes, "shard").select(F.col("shard").alias("key"), "blob", salts, "n"), "dealt")
        rows = now.join(dealt.select(F.col("key").alias("shard"), "salts"), "shard").select(F.col("shard").alias("key"), "salts", F.struct("shard", "fp").alias("r"))
        done.append(now.join(dealt.select(F.col("key").alias("shard")), "shard", "left_anti"))
        total = dealt.agg(F.sum("n")).first()[0]
        if total is None:
            return _all(done)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
        now = materialize(beside(rows, dealt, parts, VantageTree.unpack, _route_own, "shard long, fp long"), "leaves")
    return _all([*done, now])


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def distinct_prints(prints: DataFrame) -> DataFrame:
    """(fp, low): the written fingerprints with the smallest doc_id of each."""
    return materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")


def components_of(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) for the table points (fp, low): the smallest doc_id reachable over the edges (a, b)."""
    roots = materialize(connected_components(edges).withColumnRenamed("node", "fp"), "roots")
    rooted = points.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    return materialize(rooted.select("fp", "root").join(lows, "root").select("fp", "root", "component_id"), "components")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    points = distinct_prints(prints)
    found = components_of(points, shard_edges(vantage_shards(points, radius), radius))
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), words=3, radius=3)
