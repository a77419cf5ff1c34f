"""Near duplicates by SimHash fingerprints, vantage-point trees and exact similarity of shingle sets.

Rows of equal shingle sets, told by a 128-bit hash of the sorted set, are one point, so thousands of copies are judged
once. Every point has the SimHash fingerprint of its set, the vantage-point trees of simhash.py link fingerprints at
RADIUS or fewer differing bits, and a component of links is a shard. Every pair of a shard is judged: parity bits of the
sets rule out pairs that cannot have the similarity, the rest are compared as exact shingle sets, and only pairs found
similar unite points.

At a similarity of 0.8 over 5-word shingles fingerprints differ in about ten bits, where no triangle bound prunes
anything in 64 dimensions. The pairs that lie beyond RADIUS get further shards, judged in the same way, from their
smallest shingle hashes under SKETCHES orders (a pair at 0.8 shares none with a chance of 0.2 ** SKETCHES, 4e-9).

Four phases, each of which leaves out pairs that are united already and no others:
 1. the shards of linked fingerprints, 2. those of the first FIRST orders, 3. those of the other orders, as far as they
    still hold points of several groups, each shard above TILE_ROWS cut into tiles of which every one is a task and
    holds LEADERS points of the whole shard;
 4. what tiles leave open: in a shard whose points are still of several groups, the points outside its largest group
    meet all others, in tasks of tile against tile within length classes (similar sets lie in neighbouring classes).
A hot shard of near copies is thus united through its leaders in linear work; only points that stay apart cost more.

Defined cases: texts without words are one group; of equal ids the first row written stays; a null doc_id goes last;
repeated rows are one group; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, small_side
from .components import connected_components
from .simhash import fingerprint, shard_edges, shingle_hashes, vantage_shards

#: Points and shingle hashes in one tile, points of a shard that all its tiles hold, and the most parity bits of a set.
TILE_ROWS, TILE_HASHES, LEADERS, PARITY_BITS = 256, 1 << 21, 8, 1 << 15
#: Differing bits at which fingerprints link.
RADIUS = 3
#: Min-wise orders of the search, and those of their first phase.
SKETCHES, FIRST = 12, 2
#: Rows of tasks that one partition takes.
TASK_ROWS = 20_000


def _multipliers(count: int) -> np.ndarray:
    """Odd multipliers of the min-wise orders."""
    return np.array([xxhash.xxh64_intdigest(b"order", k) | 1 for k in range(count)], dtype=np.uint64)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    blocks = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, dtype=np.uint64)


def parity_bits(own: np.ndarray) -> np.ndarray:
    """Bit k is set if an odd number of hashes have k as their low bits; two sets differ in at least as many hashes as bits."""
    size = min(PARITY_BITS, max(64, 1 << (2 * len(own)).bit_length()))
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _outlines(words: int, sketches: int):
    orders = _multipliers(sketches)

    def run(batches):
        for batch in batches:
            keys, sizes, prints, bits, mins = [], [], [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), words)
                keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                sizes.append(len(own)), prints.append(fingerprint([own])), bits.append(parity_bits(own).tobytes())
                mins.append([int((own * m).min().view(np.int64)) for m in orders] if len(own) else [0] * sketches)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.string()), "n": pa.array(sizes, pa.int64()), "fp": pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), "bits": pa.array(bits, pa.binary()), "mins": pa.array(mins, pa.list_(pa.int64()))})

    return run


def outlines(docs: DataFrame, row: str, words: int, sketches: int) -> DataFrame:
    """(row, doc_id, key, n, fp, bits, mins): the identity, size, fingerprint and parity bits of every row's shingle set and its smallest hashes."""
    given = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(_outlines(words, sketches), f"row {dict(given.dtypes)['row']}, doc_id long, key string, n long, fp long, bits binary, mins array<long>")


def maybe_similar(n: np.ndarray, bits: list[np.ndarray], similarity: float):
    """Blocks (at, others, matrix) that mark every pair which sizes and parity bits do not rule out; i meets i as well.

    Sets of the similarity differ in at most (n1 + n2) * (1 - s) / (1 + s) hashes, so no such pair is left out.
    """
    widths = np.array([len(b) for b in bits])
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        mine = np.stack([bits[i] for i in own])
        for v in np.unique(widths[widths >= w]):
            at = np.flatnonzero(widths == v)
            if similarity * n[at].min() > n[own].max():
                continue
            others = np.stack([bits[i] for i in at])
            while others.shape[1] > w:  # more low bits fold onto fewer
                others = others[:, : others.shape[1] // 2] ^ others[:, others.shape[1] // 2 :]
            step = max(1, (1 << 20) // (len(at) * int(w)))
            for i in range(0, len(own), step):
                k = own[i : i + step]
                differ = np.bitwise_count(mine[i : i + step, None] ^ others[None]).sum(axis=2, dtype=np.int32)
                small, large = np.minimum(n[k][:, None], n[at][None]), np.maximum(n[k][:, None], n[at][None])
                yield k, at, (differ <= (small + large) * ((1 - similarity) / (1 + similarity)) + 1e-6) & (small >= similarity * large - 1e-6)


def with_partners(n: np.ndarray, bits: list[np.ndarray], label: np.ndarray, similarity: float) -> np.ndarray:
    """The places of the points that may be similar to one of another label."""
    some = np.zeros(len(n), dtype=bool)
    for k, at, near in maybe_similar(n, bits, similarity):
        near &= label[k][:, None] != label[at][None]
        some[k] |= near.any(axis=1)
        some[at] |= near.any(axis=0)
    return np.flatnonzero(some)


def similar_forest(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that unite the labels as all pairs of sets at the similarity do; only a pair of one label is left uncompared."""
    n, label, edges = np.array([len(s) for s in sets]), label.copy(), []
    if not len(n):
        return edges
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(place, np.cumsum(n)[:-1])
    held = np.zeros(len(values), dtype=bool)
    for k, at, near in maybe_similar(n, [parity_bits(s) for s in sets], similarity):
        for i, others in zip(k, near, strict=True):
            others = at[others]
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            held[place[i]] = True
            for j in others:
                if label[i] != label[j]:
                    common = np.count_nonzero(held[place[j]])
                    if common >= similarity * (n[i] + n[j] - common):
                        edges.append((int(i), int(j)))
                        label[label == label[j]] = label[i]
            held[place[i]] = False
    return edges


def _by_task(columns: list[str], each):
    """each(task, frame) for all tasks of a partition that is sorted by task; holds one task at a time."""

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            tasks = kept.column("task").to_numpy()
            if len(tasks) and tasks[0] != tasks[-1]:
                starts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist()]
                for i, j in zip(starts, starts[1:], strict=False):
                    yield each(int(tasks[i]), kept.slice(i, j - i).select(columns).combine_chunks())
                kept = kept.slice(starts[-1])
        if kept is not None and len(kept):
            yield each(kept.column("task")[0].as_py(), kept.select(columns).combine_chunks())

    return run


def _arrays(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") if kind == "bits" else x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def _partners(similarity: float):
    def each(task: int, rows: pa.Table) -> pa.RecordBatch:
        pid, root = rows.column("pid").to_numpy(), rows.column("root").to_numpy()
        at = with_partners(rows.column("n").to_numpy(), _arrays(rows.column("bits"), "bits"), root, similarity)
        return pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(at), task), pa.int64()), "pid": pa.array(pid[at], pa.int64()), "root": pa.array(root[at], pa.int64())})

    return _by_task(["pid", "n", "bits", "root"], each)


def _similar(similarity: float):
    def each(task: int, rows: pa.Table) -> pa.RecordBatch:
        root = rows.column("root").to_numpy()
        edges = similar_forest(_arrays(rows.column("s"), "s"), root, similarity)
        return pa.RecordBatch.from_pydict({"a": pa.array([int(root[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(root[j]) for _, j in edges], pa.int64())})

    return _by_task(["root", "s"], each)


def _shingle_sets(words: int):
    def run(batches):
        for batch in batches:
            for pid, text in zip(batch.column("pid"), batch.column("text"), strict=True):
                yield pa.RecordBatch.from_pydict({"pid": pa.array([pid.as_py()], pa.int64()), "s": pa.array([shingle_set(text.as_py(), words).view(np.int64)], pa.list_(pa.int64()))})

    return run


def _tiles(rows: str, hashes: str):
    return F.greatest(F.ceil(F.col(rows) / F.lit(float(TILE_ROWS))), F.ceil(F.col(hashes) / F.lit(float(TILE_HASHES)))).cast("long")


def _tile(pid: str, tiles: str, name: str = "tile"):
    return F.pmod(F.xxhash64(F.lit(name), pid), F.col(tiles))


def star_tasks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, pid, root): all tiles of the shards of members (shard, pid, root, n) with several roots, and the shards cut into several."""
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    sizes = materialize(sizes.select("shard", _tiles("c", "h").alias("tiles")), "shards")
    hot = materialize(sizes.where("tiles > 1"), "hot")
    rows = members.join(sizes, "shard").select("shard", "pid", "root", _tile("pid", "tiles").alias("t"))
    if not hot.isEmpty():
        lead = members.join(small_side(hot, 16), "shard").groupBy("shard", "tiles", F.pmod(F.xxhash64(F.lit("leader"), "pid"), F.lit(LEADERS)).alias("k")).agg(F.min(F.struct("pid", "root")).alias("l"))
        lead = materialize(lead.select("shard", "tiles", "l.pid", "l.root"), "leaders")
        others = rows.join(small_side(lead.select("shard", "pid"), 16), ["shard", "pid"], "left_anti")
        rows = others.unionByName(lead.select("shard", "pid", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("t")))
    return rows.select(F.xxhash64("shard", "t").alias("task"), "pid", "root"), hot.select("shard")


def rest_tasks(members: DataFrame, similarity: float) -> DataFrame:
    """(task, pid, root): tiles of the points outside a shard's largest group against tiles of all its points, within length classes."""
    groups = members.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("h"))
    sizes = groups.groupBy("shard").agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.max(F.struct("c", "root", "h")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    sizes = materialize(sizes.select("shard", F.col("top.root").alias("top")), "open")
    kind = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-math.log(similarity))).cast("int")
    rows = materialize(members.join(sizes, "shard").select("shard", "pid", "root", "n", (F.col("root") != F.col("top")).alias("few"), kind.alias("kind")), "placed")
    own = rows.where("few").drop("few")
    near = rows.select("shard", "pid", "root", "n", F.explode(F.array(*[F.col("kind") + i for i in (-1, 0, 1)])).alias("kind"))
    # the tiles of each length class, so that they are as full as those of the whole shard
    count = lambda df, c: df.groupBy("shard", "kind").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("h")).select("shard", "kind", _tiles("c", "h").alias(c))
    tiles = materialize(count(own, "na").join(count(near, "nb"), ["shard", "kind"]), "tiles")
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = own.join(tiles, ["shard", "kind"]).select("shard", "pid", "root", "kind", _tile("pid", "na", "few").alias("a"), F.explode(to("nb")).alias("b"))
    near = near.join(tiles, ["shard", "kind"]).select("shard", "pid", "root", "kind", F.explode(to("na")).alias("a"), _tile("pid", "nb").alias("b"))
    return own.unionByName(near.select(*own.columns)).select(F.xxhash64("shard", "kind", "a", "b").alias("task"), "pid", "root").distinct()


def judged(docs: DataFrame, row: str, points: DataFrame, tasks: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) of roots: those of all similar pairs of points (pid, row, n, bits) of different roots in a task (task, pid, root).

    Parity bits first rule out pairs; the points that may have a partner are then compared by their sets.
    """
    tasks = materialize(tasks, "tasks")
    # a count of partitions of its own: the rows are few bytes and much work, and would be merged into few tasks
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tasks.count() // TASK_ROWS))
    rows = tasks.join(points.select("pid", "n", "bits"), "pid").select("task", "pid", "root", "n", "bits")
    some = rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_partners(similarity), "task long, pid long, root long")
    some = materialize(some.hint("rebalance"), "candidates")  # few rows of many tasks: files of a fair size, not one a task
    first = materialize(points.select("pid", F.col("row").alias(row)).join(some.select("pid").distinct(), "pid", "left_semi"), "first")
    texts = docs.select(F.col(row), F.col("text").cast("binary").alias("text")).join(small_side(first, 40), row)
    sets = texts.select("pid", "text").mapInArrow(_shingle_sets(words), "pid long, s array<long>")
    given = some.join(sets, "pid").select("task", "root", "s").repartition(parts, "task").sortWithinPartitions("task")
    return materialize(given.mapInArrow(_similar(similarity), "a long, b long").distinct(), "similar")


def _united(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (pid, root) after the edges of roots."""
    if edges.isEmpty():
        return labels
    found = materialize(connected_components(edges), "roots").select(F.col("node").alias("root"), F.col("root").alias("to"))
    return materialize(labels.join(found, "root", "left").select("pid", F.coalesce("to", "root").alias("root")), "labels")


def linked_shards(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(pid, n, shard) of the points (pid, n, fp): a shard is a component of fingerprints linked at radius or fewer bits."""
    prints = materialize(points.select("fp").distinct(), "prints")
    found = materialize(connected_components(shard_edges(vantage_shards(prints, radius), radius)), "linked")
    own = points.select("pid", "n", "fp").join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return materialize(own.select("pid", "n", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("shard")), "linked")


def similar_groups(docs: DataFrame, row: str, points: DataFrame, words: int, similarity: float, sketches: int = SKETCHES) -> DataFrame:
    """(pid, root) of the points (pid, row, n, fp, bits, mins): one root for each group of similar points."""
    labels, hot = points.select("pid", F.col("pid").alias("root")), []

    def ordered(orders) -> DataFrame:
        return points.select("pid", "n", F.explode(F.array(*[F.xxhash64(F.lit(k), F.get("mins", F.lit(k))) for k in orders])).alias("shard"))

    def members(shards: DataFrame) -> DataFrame:
        return materialize(shards.join(labels, "pid").select("shard", "pid", "root", "n"), "members")

    phases = [linked_shards(points), *(ordered(orders) for orders in (range(min(FIRST, sketches)), range(FIRST, sketches)) if len(orders))]
    for shards in phases:
        tasks, large = star_tasks(members(shards))
        hot.append(large)
        labels = _united(labels, judged(docs, row, points, tasks, words, similarity))
    large = materialize(reduce(DataFrame.union, hot).distinct(), "hot")
    if not large.isEmpty():
        rest = members(reduce(DataFrame.unionByName, phases).join(small_side(large, 16), "shard", "left_semi"))
        labels = _united(labels, judged(docs, row, points, rest_tasks(rest, similarity), words, similarity))
    return labels


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, sketches: int = SKETCHES) -> DataFrame:
    """docs with one row of each near-duplicate group: that with the smallest doc_id, of equal ids the first row written."""
    rows, row = numbered(docs)
    prints = materialize(outlines(rows, row, words, sketches), "outlines")
    first = prints.groupBy("key").agg(F.min(F.struct("row", "n", "fp", "bits", "mins")).alias("f"))
    points = materialize(first.select(F.monotonically_increasing_id().alias("pid"), "key", "f.*"), "points")
    found = similar_groups(rows, row, points, words, similarity, sketches)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("row").alias("r")))
    stay = prints.select("row", "doc_id", "key").join(points.select("key", "pid"), "key").join(found, "pid").groupBy("root").agg(best.alias("k"))
    gone = prints.select("row").join(materialize(stay.select(F.col("k.r").alias("row")), "stay"), "row", "left_anti")
    return rows.join(small_side(materialize(gone.select(F.col("row").alias(row)), "gone"), 32), row, "left_anti").drop(row)
