"""The operators that have one right answer, against plain versions, with the awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import components, decontaminate, exact_dedup, license_scan, line_dedup, near_sets, simhash, url_filter
from keelson.llm.common import ascii_lower, code_words, fresh, held_out

from . import brute

DOCS = "doc_id long, text string"
LINE, OTHER = "Every good boy deserves favour, they say", "ANOTHER line that stands in many documents é"
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, f"{LINE}\nown words one\n{OTHER}"), (5, f"  {LINE.upper()} \r\nÉtude É é\n"), (6, f"{LINE}\n{LINE}\nlast"), (7, "short\nshort\nshort"), (8, "short"), (9, "short"),
    (10, f"{OTHER}\n{OTHER}"), (11, OTHER.lower()), (11, OTHER.lower()), (None, LINE), (None, f"{LINE}\nx"), (12, "the long text " * 3000 + f"\n{LINE}"), (13, "日本語 テスト" * 30), (14, "a"), (15, "\n\n\n"), (16, "x" * 30), (17, "ß" * 10 + "é" * 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    rows = [(*r, "h", 1, 2, "w", 3, 0.5) for r in AWKWARD]
    return spark.createDataFrame(rows, DOCS + ", host string, row long, fp long, w string, _row long, score double").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_words(spark):
    texts = ["A b-C É_é 9z", None, "", "\x00\x7f", "ÀB日 x/y:Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(code_words(F.col("t"))).collect()] == [brute.code_words(t) for t in texts]
    assert [r[0] for r in df.where("t IS NOT NULL").select(ascii_lower(F.col("t"))).collect()] == [brute.lower(t) for t in texts if t is not None]
    assert fresh(["A", "a_"], "a") == "a__"


def test_folds(spark):
    ids = [0, 7, -3, 123456789, None]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    assert [r[0] for r in df.select(held_out(F.col("i"), 5, 0)).collect()] == [brute.fold(i, 5) == 0 for i in ids]


# op1

URLS = [
    (1, "http://Example.COM/en/a"), (2, "https://www.example.com/en/x?q=1"), (3, "http://a.b.example.com/de/#x"), (4, "http://x.net/es/1"), (5, "http://x.net/fr/"), (6, "http://x.net/fr"), (7, "http://net/es/"), (8, "http://xnet/es/"), (9, None), (10, ""),
    (11, "no scheme.com/en/"), (12, "://com/"), (13, "http://example.com"), (14, "http://my-casino.org/"), (15, "http://casinos.org/"), (16, "http://spam-farm.example.org/en/"), (17, "http://spam-farm.example.com/xx"), (18, "x://y://com/en/"), (19, "http://notexample.com/en/"), (20, "http:///en/"), (20, "http:///en/"), (None, "http://b.com/EN/\nx"),
]


def judge(url):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)", rest)[1], re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = brute.lower(host)
    fits = [r for r in url_filter.BASE_RULES if (h := r.name.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r.name[len(h) :])]
    best = max(fits, key=lambda r: len(r.name), default=None)
    own = any(re.search(r"(^|[^0-9a-z])" + r.name.replace(" ", "[-._]") + r"($|[^0-9a-z])", host) for r in url_filter.OWN_RULES)
    return host, path, best.name if best else None, best.verdict if best else "block" if own else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, host string")
    got = url_filter.judge_urls(df, [*url_filter.BASE_RULES, *url_filter.OWN_RULES]).drop("n_candidates")
    assert rows_of(got) == sorted(repr((i, *judge(u))) for i, u in URLS)
    assert url_filter.judge_urls(df.limit(0), list(url_filter.BASE_RULES)).count() == 0 and {r["verdict"] for r in url_filter.judge_urls(df, [], "block").collect()} == {"block"}


def test_rarest_token_index():
    rules = [url_filter.prefix_rule("shop.example.com", "/en/", "block"), url_filter.prefix_rule("com", "/", "allow"), url_filter.UrlRule("any", "block", "x+y", ())]
    assert rules[0].tokens == ("shop", "example", "com", "en") and url_filter.prefix_rule("a.b", "/en", "block").tokens == ("a", "b")
    assert url_filter.rarest_token_index(rules, {"shop": 1, "example": 9, "com": 99, "en": 50}) == {"shop": [0], "com": [1], "": [2]}


def test_candidates_are_few(spark):
    rules = [url_filter.prefix_rule(f"site{i}.org", "/", "block") for i in range(500)]
    df = spark.createDataFrame([(i, f"http://www.site{i}.org/a") for i in range(20)], "page_id long, url string")
    got = url_filter.judge_urls(df, rules).collect()
    assert {r["verdict"] for r in got} == {"block"} and max(r["n_candidates"] for r in got) <= 2


@pytest.mark.parametrize("size", [10, 700])
@pytest.mark.parametrize("in_row", [100_000, 0])
def test_rules_beyond_the_literal(spark, monkeypatch, size, in_row):
    """Rules that do not fit the literal are joined: all of them, or all but those of the most frequent tokens."""
    rules = [*url_filter.BASE_RULES, *url_filter.OWN_RULES, url_filter.UrlRule("any", "block", "^q[.]", (), 1)]
    urls = [*URLS, (30, "http://q.com/en"), (31, "http://q.org"), (31, "http://q.org")]
    df = spark.createDataFrame([(i, u, "x", 7) for i, u in urls], "page_id long, url string, host string, _row int")
    want = rows_of(url_filter.judge_urls(df, rules))
    monkeypatch.setattr(url_filter, "INDEX_BYTES", size)
    monkeypatch.setattr(decontaminate, "IN_ROW", in_row)
    assert rows_of(url_filter.judge_urls(df, rules)) == want
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


# op2


def variants(n=60):
    rng, base, out = np.random.default_rng(3), [f"w{i}" for i in range(120)], []
    for i in range(n):
        words = list(base) if i % 3 else [f"v{rng.integers(1000)}" for _ in range(40)]
        for k in rng.integers(0, 120, i % 7):
            words[k % len(words)] = f"z{rng.integers(50)}"
        out.append((100 + i, " ".join(words)))
    return out


def simhash_rows(rows, radius, k=3):
    fps = [brute.simhash(t, k) for _, t in rows]
    roots = brute.components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    low = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(repr((i, f"{fp:016x}", low.get(r))) for (i, _), fp, r in zip(rows, fps, roots, strict=True))


@pytest.mark.parametrize("radius", [3, 8])
def test_simhash(spark, docs, radius):
    assert rows_of(simhash.simhash_components(docs, 3, radius)) == simhash_rows(AWKWARD, radius)
    rows = variants()
    assert rows_of(simhash.simhash_components(spark.createDataFrame(rows, DOCS), 3, radius)) == simhash_rows(rows, radius)


def test_simhash_tiles_and_empty(spark, none, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 5)
    rows = variants()
    assert rows_of(simhash.simhash_components(spark.createDataFrame(rows, DOCS), 3, 6)) == simhash_rows(rows, 6)
    assert simhash.simhash_components(none).count() == 0


def test_hash_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3)) == brute.simhash(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_vantage_tree_keeps_close_pairs_together(radius):
    rng = np.random.default_rng(radius)
    points = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, radius, replace=False).astype(np.uint64)) if radius else np.uint64(0) for _ in points]
    both = np.concatenate([points, points ^ np.array(flips, dtype=np.uint64)])
    tree = simhash.VantageTree(points, 0xFFFFFFFFFFFFFFFF, radius, 20)
    leaves = [set(at.tolist()) for _, at in tree.route(both)]
    assert (len(leaves) > 1 or radius > 3) and all(any({i, i + 400} <= leaf for leaf in leaves) for i in range(400))


def test_own_trees_of_large_leaves(spark, monkeypatch):
    """With few sampled points the first trees leave large leaves; their own trees bound them, and no close pair is lost."""
    monkeypatch.setattr(simhash, "SAMPLE", 300)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 100)
    rng, dealt = np.random.default_rng(8), {}
    for n in (4000, 16000):
        points = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        near = points[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
        given = spark.createDataFrame([(int(p),) for p in np.unique(np.concatenate([points, near])).view(np.int64)], "fp long")
        shards = simhash.vantage_shards(given, 3, leaf_rows=60).distinct().toPandas()
        sizes = shards.groupby("shard").size()
        dealt[n] = len(shards) / given.count()
        assert sizes.max() < 0.1 * n and sizes.mean() < 100
        meets = shards.groupby("fp")["shard"].agg(set)
        assert all(meets[a] & meets[b] for a, b in zip(points[:500].view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True) if a != b)
    assert dealt[16000] < 4 * dealt[4000]  # four times the points, and far from four times the rows for each
    points = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = spark.createDataFrame([(int(p), int(p)) for p in points.view(np.int64)], "fp long, low long")
    edges = {frozenset(r) for r in simhash.shard_edges(simhash.vantage_shards(rows, 12, leaf_rows=60), 12).collect()}
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    linked = {(at[a], at[b]) for e in edges for a, b in (tuple(e), tuple(e)[::-1])}
    want = brute.components(len(points), lambda i, j: (int(points[i]) ^ int(points[j])).bit_count() <= 12)
    assert want == brute.components(len(points), lambda i, j: (i, j) in linked)


def test_own_trees_over_several_batches(spark, monkeypatch):
    """The rows beside one tree fill several Arrow batches, of which only the first holds the tree."""
    monkeypatch.setattr(simhash, "SAMPLE", 20)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    rng = np.random.default_rng(9)
    points = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    near = points[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))
    points = np.unique(np.concatenate([points, near]))
    given = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        edges = [tuple(r) for r in simhash.shard_edges(simhash.vantage_shards(given, 3, leaf_rows=40), 3).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    linked = {(at[a], at[b]) for e in edges for a, b in (e, e[::-1])}
    want = brute.components(len(points), lambda i, j: (int(points[i]) ^ int(points[j])).bit_count() <= 3)
    assert len(set(want)) < len(points) and want == brute.components(len(points), lambda i, j: (i, j) in linked)


def test_packed_tree():
    points = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    tree = simhash.VantageTree(points, 0xFFFFFFFF, 1, 20)
    again = simhash.VantageTree.unpack(tree.pack())
    same = lambda t: [(n, at.tolist()) for n, at in t.route(points)]
    assert len(tree.mu) > 1 and same(tree) == same(again)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))] + [(7, 7), (300, 300), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    pairs = {(a, b) for e in edges if None not in e for a, b in (e, e[::-1])}
    roots = brute.components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in pairs)
    assert got == {n: nodes[r] for n, r in zip(nodes, roots, strict=True)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs, none):
    base = [f"w{i}" for i in range(300)]
    near, far = list(base), list(base)
    near[150] = "changed"
    for i in range(0, 300, 3):
        far[i] = f"f{i}"
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (1, " ".join(far)), (20, ""), (21, None), (None, " ".join(near)), (30, "one two"), (31, "one two"), (31, "one two")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS + ", _row string, row long")
    kept = near_sets.near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 20, 30]
    assert near_sets.near_duplicates(none).count() == 0
    assert near_sets.near_duplicates(docs).columns == docs.columns


def kept_by_pairs(rows, k=5, similarity=0.8):
    sets = [set(brute.shingles(t, k)) for _, t in rows]
    roots = brute.components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]))
    low = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        low[r] = min(low.get(r, i), i)
    return sorted(low.values())


def test_near_duplicates_of_edited_copies(spark):
    """Groups whose pairs lie around the similarity, where a nearest link that is cut must not hide a similar pair."""
    rng, rows = np.random.default_rng(11), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(200)]
        for k in range(40):
            words = list(base)
            for at in rng.choice(200, rng.integers(2, 5), replace=False):
                words[at] = f"e{g}x{k}y{at}"
            rows.append((1000 * g + k, " ".join(words)))
    got = sorted(r["doc_id"] for r in near_sets.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == kept_by_pairs(rows)


def test_same_fingerprint_is_not_the_same_text(spark):
    """One shingle makes up over half of all, so both texts get its hash as fingerprint."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["x"] * 304 + [f"d{i}n{k}" for k in rng.integers(0, 10**6, 100)])) for i in (1, 2)]
    one, two = (simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows)
    assert one == two and sorted(r["doc_id"] for r in near_sets.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == [1, 2]


def test_same_set_is_the_same_text(spark):
    """Repeats move the fingerprint and leave the set: these texts are near duplicates, however far their fingerprints are."""
    a, b = "p q r s t u v w", "a b c d e f g h"
    rows = [(1, " ".join([a] * 50 + [b] * 3)), (2, " ".join([a] * 3 + [b] * 50)), (3, "p q r s t " * 100), (4, "p q r s t " * 100 + " ".join(f"x{i}" for i in range(30)))]
    one, two = (simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows[:2])
    assert (one ^ two).bit_count() > 3 and kept_by_pairs(rows) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in near_sets.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == [1, 3, 4]


def test_hot_shard_in_small_tiles(spark, monkeypatch):
    """One shard holds nearly all points, in many tiles: near copies, and texts that share half of their words with them."""
    monkeypatch.setattr(near_sets, "TILE_ROWS", 10)
    monkeypatch.setattr(near_sets, "LEADERS", 2)
    rng, rows = np.random.default_rng(12), []
    base = [f"w{i}" for i in range(100)]
    for k in range(160):
        words = list(base[: 100 if k % 2 else 60 + k % 30]) + ([] if k % 2 else [f"o{k % 40}x{i}" for i in range(12)])
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            words[at] = f"e{k}y{at}"
        rows.append((k, " ".join(words)))
    got = sorted(r["doc_id"] for r in near_sets.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == kept_by_pairs(rows)


def test_linked_fingerprints_find_near_copies_alone(spark):
    """Without min-wise orders the vantage-point trees bring near copies together, and exact sets judge what they link."""
    rng, rows = np.random.default_rng(13), []
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(900)]
        for k in range(12):
            words = list(base)
            for at in rng.choice(900, k % 4, replace=False):
                words[at] = f"e{g}x{k}y{at}"
            rows.append((100 * g + k, " ".join(words)))
    sets = [set(brute.shingles(t, 5)) for _, t in rows]
    prints = [simhash.fingerprint([near_sets.shingle_set(t.encode(), 5)]) for _, t in rows]
    link = brute.components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    roots = brute.components(len(rows), lambda i, j: link[i] == link[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    want = sorted({rows[r][0] for r in roots})
    assert len(want) < 30 and kept_by_pairs(rows) == [0, 100, 200, 300, 400]
    given = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in near_sets.near_duplicates(given, sketches=0).collect()) == want
    assert sorted(r["doc_id"] for r in near_sets.near_duplicates(given).collect()) == [0, 100, 200, 300, 400]


def test_near_duplicates_write_few_files(spark, monkeypatch):
    """What many tasks find is few rows; it is not a file for each task, as every file costs an executor a process of its own."""
    rows, files = [], {}
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [(10 * g + k, " ".join(base[: 60 - k])) for k in range(4)]
    write = near_sets.materialize

    def counted(df, label):
        out = write(df, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_sets, "materialize", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = sorted(r["doc_id"] for r in near_sets.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == kept_by_pairs(rows) and max(files[label] for label in ("candidates", "similar")) <= 2


def test_near_duplicates_of_the_given_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(r["doc_id"] for r in near_sets.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect())
    assert got == kept_by_pairs(rows)


def test_parity_bits_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 9, 30, 63, 64, 65, 500)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], rng.integers(0, 1 << 63, len(s) // 12, dtype=np.uint64)])) for s in sets]
    near = np.zeros((len(sets), len(sets)), dtype=bool)
    for k, at, block in near_sets.maybe_similar(np.array([len(s) for s in sets]), [near_sets.parity_bits(s) for s in sets], 0.8):
        near[np.ix_(k, at)] |= block
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            assert near[i, j] or near[j, i] or common < 0.8 * (len(a) + len(b) - common)


# op3


@pytest.mark.parametrize("index_bytes", [1 << 20, 1])
def test_lines(docs, none, index_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "TASK_LINES", 3)
    want = sorted(repr((i, n, d, brute.sha(t))) for (i, _), (n, d, t) in zip(AWKWARD, brute.lines(AWKWARD), strict=True))
    assert rows_of(line_dedup.line_report(docs, index_bytes=index_bytes, shard_keys=1)) == want
    assert line_dedup.line_report(none).count() == 0


def test_drop_lines(spark, docs):
    rich = docs.withColumn("n_chars", F.char_length("text").cast("int"))
    got = line_dedup.drop_repeated_lines(rich)
    assert rows_of(got) == rows_of(line_dedup.drop_repeated_lines(rich, index_bytes=0))
    assert got.schema == rich.schema or got.dtypes == rich.dtypes
    want = sorted(repr((i, t if d else text)) for (i, text), (_, d, t) in zip(AWKWARD, brute.lines(AWKWARD), strict=True))
    assert rows_of(got.select("doc_id", "text")) == want
    assert got.where("n_chars != char_length(text)").count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert sorted(line_dedup.PerfectHash.build(keys).find(keys).tolist()) == list(range(len(keys)))
    other = rng.integers(0, 1 << 63, len(keys), dtype=np.uint64)
    shard = line_dedup.Shard(line_dedup.pack_shard(keys, other, np.full(len(keys), 3), np.arange(len(keys))))
    at = shard.probe(keys, other)
    assert (shard.top[at] == np.arange(len(keys))).all() and (shard.docs == 3).all() and (shard.probe(keys, other + np.uint64(1)) == -1).all() and (shard.probe(keys + np.uint64(1), other) == -1).all()


def test_keys_that_share_a_half(spark):
    """Forged hashes: the perfect hash takes one key of those that share h1, the others are told by their whole hash."""
    h1 = np.array([5, 5, 7, 5, 9], dtype=np.uint64)
    h2, docs, top = np.arange(5, dtype=np.uint64), np.array([3, 4, 5, 6, 7]), np.array([30, 40, 50, 60, 70])
    shard = line_dedup.Shard(line_dedup.pack_shard(h1, h2, docs, top))
    at = shard.probe(h1, h2)
    assert shard.docs[at].tolist() == docs.tolist() and shard.top[at].tolist() == top.tolist()
    assert (shard.probe(h1, h2 + np.uint64(10)) == -1).all() and shard.drops(h1, h2, np.array([30, 1, 50, 1, 1]), 4).tolist() == [1, 3, 4]
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(h1)


def test_large_index_writes_no_text(spark, docs, monkeypatch):
    written, plain = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: written.append((label, df.columns)) or plain(df, label))
    line_dedup.line_report(docs.select("doc_id", "text"), index_bytes=1).count()
    assert {label for label, _ in written} == {"lines", "shards", "shard_lines", "drops"} and not any({"text", "_text"} & set(c) for _, c in written)


# op4


def test_licenses(spark, docs, none):
    texts = [
        "MIT License mit license", "the Apache License, Version 2.0", "Licensed under the Apache License\nversion 2.0", "x\nThis WORK is licensed under GNU General Public License, version 3!\ny", "cc-by 4.0 cc by", None, "", "mit licenses", "gnu general public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of software", "permission granted", "licença mit license", "all rights reserved no part of this publication may be reproduced in whole " * 50,
    ]
    rows = list(enumerate(texts)) + [(3, texts[3])] + AWKWARD
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS))
    assert rows_of(got) == sorted(repr((i, *plain_license(t))) for i, t in rows)
    assert license_scan.scan_licenses(none).count() == 0 and license_scan.scan_licenses(docs).count() == len(AWKWARD)
    same = license_scan.scan_licenses(docs)
    assert same.columns == got.columns and rows_of(same) == sorted(repr((i, *plain_license(t))) for i, t in AWKWARD)


def plain_license(text):
    words, starts, base = brute.code_words(text), [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    found, best = set(base), 0.0
    for label, must, template in license_scan.TEMPLATES:
        tokens, n = set(license_scan.template_tokens(template)), len(license_scan.template_words(template))
        for i in range(len(words)):
            have = tokens & set(words[i : i + n])
            if len(have) >= license_scan.THRESHOLD * len(tokens) - 1e-9 and set(must.split()) <= have:
                found.add(label)
                best = max(best, len(have) / len(tokens))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if base else best


def test_overlapping_phrases(spark):
    df = spark.createDataFrame([(1, "a b a b a")], DOCS)
    r = license_scan.scan_licenses(df, phrases=(("a b a", "x"),)).first()
    assert (r["n_base"], r["first_word"], r["last_word"]) == (2, 0, 2)


def test_wrapped_notices(spark):
    notice = {label: text for label, _, text in reversed(license_scan.TEMPLATES)}

    def wrapped(text, width, lead):
        import textwrap

        return "intro\n" + "\n".join(lead + line for line in textwrap.wrap(text, width)) + "\nend"

    texts = [wrapped(notice[x], 40, lead) for x, lead in (("mit", ""), ("apache", " * "), ("lgpl", "# "), ("agpl", "// "), ("bsd", "; "))]
    texts += ["Licensed under CC BY-NC 4.0.", "Text under CC BY-NC-SA 4.0", "Licensed under CC BY 4.0", "(c) 1999 X. All\nrights reserved.", "all the rights are, by the way, not reserved at all", notice["bsd"][:60] + " other words" * 20 + notice["bsd"][60:], None]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(df).collect()}
    for i in range(len(texts)):
        assert got[i] == plain_license(texts[i])[5:], i
    assert "mit" in got[0][0] and "apache" in got[1][0] and "lgpl" in got[2][0] and "agpl" in got[3][0] and got[4][0] == "bsd"
    assert [got[i][0] for i in range(5, 12)] == ["cc-by,cc-by-nc", "cc-by,cc-by-nc,cc-by-sa", "cc-by", "all-rights-reserved", "", "", ""]
    whole = [r for r in license_scan.license_blocks(df).collect() if r["doc_id"] == 0 and r["containment"] == 1.0]
    assert " ".join(license_scan.template_words(notice["mit"])) in {r["block"] for r in whole} and {r["label"] for r in whole} == {"mit"}


# op5


def plain_dups(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((-(2**63) if i is None else i, k))
    return sorted(repr((i, max(g)[0] if max(g)[0] > -(2**63) else None, len(g), brute.sha(t or ""))) for i, t in rows for g in [groups[t or ""]])


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, docs, tmp_path, weak):
    path = str(tmp_path / "d.parquet") + "/" * weak
    docs.write.parquet(path)
    digest = (lambda t: F.length(t).cast("string")) if weak else (lambda t: F.sha2(t, 256))
    got = exact_dedup.exact_duplicates(spark, path, digest, files=1).cache()
    assert rows_of(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == plain_dups(AWKWARD)
    kept = got.where("kept")
    assert kept.count() == len({t or "" for _, t in AWKWARD}) and kept.where("NOT doc_id <=> keep_id").count() == 0


def test_exact_path_patterns():
    assert [exact_dedup._pattern(p) for p in ("/a/b.parquet", "/a/b/", "/a/b_-/")] == ["/a/b.parque[t]", "/a/[b]", "/a/[b]_-"]


def test_exact_goes_on(spark, tmp_path):
    path, cp = str(tmp_path / "d.parquet"), str(tmp_path / "cp")
    df = lambda *r: spark.createDataFrame(list(r), DOCS)
    df((1, "a"), (2, "b")).write.parquet(path)
    exact_dedup.exact_duplicates(spark, path, checkpoint=cp).collect()
    df((9, "a"), (3, "c")).write.mode("append").parquet(path)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(spark, path, checkpoint=cp).collect()}
    assert got == {1: (9, 2, False), 9: (9, 2, True), 2: (2, 1, True), 3: (3, 1, True)}


def test_exact_one_file_and_empty(spark, none, small, tmp_path):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert exact_dedup.op5_exact_dedup(spark, small).count() == n
    none.write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup.exact_duplicates(spark, str(tmp_path / "e.parquet")).count() == 0


# op6

ITEMS = [("i1", "one two three four five six seven eight nine ten eleven"), ("i2", "Solo"), ("i3", "just three words"), ("i4", None), ("i5", "..."), (None, "one two"), ("i6", "the the the the the the the the the the the"), ("i7", "just three words")]


def contaminated_rows(rows, items, window=10):
    out = []
    for i, t in rows:
        n, hit, found = brute.contamination(t, items, window)
        out.append(repr((i, n, hit, len(found), brute.sha(",".join(found)), hit > 0)))
    return sorted(out)


@pytest.mark.parametrize("in_row", [100_000, 0])
@pytest.mark.parametrize("shingle", [1, 2, 3])
def test_contamination(spark, docs, none, monkeypatch, in_row, shingle):
    monkeypatch.setattr(decontaminate, "IN_ROW", in_row)
    texts = [
        "zero one TWO three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine", "solo solo, solo!", "a just three words b just three words", "the " * 25, None, "", "just three", "éone two three four five six seven eight nine ten",
        "two three four five six seven eight nine ten eleven two three four five six seven eight nine ten eleven",
    ]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(decontaminate.contamination_report(df, items, shingle=shingle)) == contaminated_rows(rows, ITEMS)
    if shingle == 2 and in_row:
        assert rows_of(decontaminate.contamination_report(docs, items)) == contaminated_rows(AWKWARD, ITEMS)
        assert decontaminate.contamination_report(none, items).count() == 0
        assert decontaminate.contamination_report(df, items.limit(0)).where("contaminated").count() == 0
        clean = decontaminate.drop_contaminated(docs, items)
        want = [r for r in AWKWARD if not brute.contamination(r[1], ITEMS)[1]]
        assert clean.columns == docs.columns and rows_of(clean.select("doc_id", "text")) == sorted(map(repr, want))


def test_filter_places_of_extreme_hashes(spark):
    """Sums of a hash's parts stay within 64 bits, where Spark would raise an error."""
    hashes = [(1 << 63) - 1, -(1 << 63), -1, 0, 1 << 62]
    got = spark.createDataFrame([(h,) for h in hashes], "h long").select(F.array(*decontaminate._slots(F.col("h"), 1 << 16))).collect()
    parts = [(h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF) for h in hashes]
    assert [r[0] for r in got] == [[(low + k * high) % (1 << 16) for k in range(decontaminate.PROBES)] for low, high in parts]


def test_many_windows_cost_few_places(spark, small, monkeypatch):
    """Beyond IN_ROW a filter keeps places that are no window's from being written with their words."""
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    listed = rows_of(decontaminate.contamination_report(docs, items))
    monkeypatch.setattr(decontaminate, "IN_ROW", 0)
    places, plain = [], decontaminate.materialize

    def count(df, label):
        out = plain(df, label)
        if label == "places":
            places.append(out.agg(F.sum(F.size("places")), F.sum("n_words")).first())
        return out

    monkeypatch.setattr(decontaminate, "materialize", count)
    assert rows_of(decontaminate.contamination_report(docs, items)) == listed
    spots, words = places[0]
    assert 0 < spots < 0.05 * words
