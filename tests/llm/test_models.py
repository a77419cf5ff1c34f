"""The learned operators: held-out accuracy, exact token counts, totals that meet their targets."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import hashed_text, language_id, mixing, token_count, toxicity

from . import brute

DOCS = "doc_id long, text string"
COMMON = [f"word{i}" for i in range(200)]
BAD = ["vile", "nasty", "foul"]


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = rng.choices(COMMON, k=rng.randint(20, 60)), i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.1, "l") for i, t, _ in rows], DOCS + ", score double, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None), (99999, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def plain_grams(text):
    """Coordinates of words, pairs and pairs that skip a word."""
    mix = lambda h: plain_mix(plain_mix(h))
    h = [xxhash.xxh64_intdigest(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
    grams = [mix(a) for a in h] + [mix(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(h, h[1:])] + [mix(a * 0xC2B2AE3D27D4EB4F + b + 1) for a, b in zip(h, h[2:])]
    return {g >> 44 for g in grams}


def plain_mix(h):
    h &= (1 << 64) - 1
    return (h ^ h >> 32) * 0xD6E8FEB86659FD93 & (1 << 64) - 1


def plain_ftrl(rows, label, alpha=1.0, beta=1.0, l1=8.0, epochs=5):
    """FTRL-proximal as published, a coordinate at a time, over (doc_id, text, y); the order of rows is the operator's."""
    order = sorted(range(len(rows)), key=lambda k: (spark_hash(rows[k][0]), rows[k][0]))
    rows = [(sorted(plain_grams(rows[k][1])), float(rows[k][2] == label)) for k in order]
    z, n = {}, {}
    bz = bn = bias = 0.0

    def weight(c):
        zc = z.get(c, 0.0)
        return 0.0 if abs(zc) <= l1 else -(zc - math.copysign(l1, zc)) / ((beta + math.sqrt(n[c])) / alpha)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, y = rows[k]
            w = {c: weight(c) for c in at}
            bias = -bz / ((beta + math.sqrt(bn)) / alpha) if bn else 0.0
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + bias)))) - y
            for c in at:
                old = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[c]
                n[c] = old + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
    return {c: w for c in z if (w := weight(c))}, bias


def spark_hash(i):
    """Spark's xxhash64 of a long: XXH64 of its eight bytes, seed 42, as a signed number."""
    h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
    return h - (1 << 64) if h >> 63 else h


def test_toxicity_against_plain(spark, labelled):
    """Texts and labels that repeat, conflict, tie or are null; the sample's bound; clashing columns."""
    docs, labels = labelled
    truth = {i: y for i, _, y in corpus()}
    texts = [(i, t, truth[i]) for i, t, _ in corpus() if brute.fold(i, 5) != 0]
    odd = [(1, None), (2, ""), (3, "vile vile nasty"), (3, "vile vile nasty"), (None, "word7 foul"), (4, "word1 word2 " * 4000), (5, "ÉTÉ é vile")]
    given = spark.createDataFrame([(i, t, 1, 2, 0.5) for i, t in odd], DOCS + ", y int, _id long, score double")
    for bound in (16_000, 100):
        some = sorted(texts, key=lambda r: (spark_hash(r[0]), r[0]))[:bound]
        w, bias = plain_ftrl(some, 1)
        got = toxicity.toxicity_scores(given, labels, learn_from=docs, sample=bound)
        assert got.columns == ["doc_id", "text", "y", "_id", "score", "score_"]
        want = sorted((i or -1, 1 / (1 + math.exp(-(sum(w.get(c, 0.0) for c in plain_grams(t)) + bias)))) for i, t in odd)
        assert np.allclose(sorted((r["doc_id"] or -1, r["score_"]) for r in got.collect()), want, atol=1e-9)


def test_toxicity_sample_is_bounded(labelled, monkeypatch):
    """Coordinates count too: the sample ends with them, and labels without a document take no place."""
    docs, labels = labelled
    more = labels.union(docs.sparkSession.range(10_000, 20_000).selectExpr("id", "1", "1"))
    sample = toxicity.labelled_sample(docs, more, "toxic", 50)
    assert sample.count() == 50
    monkeypatch.setattr(toxicity, "COORDINATES", 0)
    assert toxicity.train(sample, [1]) == {}


def test_toxicity_held_out_ranking(spark):
    """The chance that a held-out toxic document of the given table scores above a clean one."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    got = toxicity.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    bad, good = got.loc[got["y"] == 1, "score"].to_numpy(), got.loc[got["y"] == 0, "score"].to_numpy()
    auc = ((bad[:, None] > good[None]) + 0.5 * (bad[:, None] == good[None])).mean()
    assert len(bad) > 3 and len(good) > 50 and auc > 0.9


def test_toxicity(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r["score_"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    wrong = [i for i, _, y in corpus() if (got[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 12 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_awkward(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "vile nasty foul vile nasty", "x"), (None, "vile nasty foul vile nasty", "x"), (3, "word1 " * 50_000, "x")], DOCS + ", c0 string")
    got = toxicity.toxicity_scores(odd, labels, learn_from=docs)
    assert got.columns == ["doc_id", "text", "c0", "score"]
    s = [r["score"] for r in got.collect()]
    assert s[0] == s[1] and s[2] == s[3] > 0.5 and s[4] < 0.5
    assert toxicity.toxicity_scores(odd.limit(0), labels, learn_from=docs).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 460 <= kept.count() <= 500


def test_toxicity_is_not_told(spark, labelled):
    """Held-out labels change nothing."""
    docs, labels = labelled
    skip = toxicity.held_out(F.col("doc_id"), 5, 0)
    flipped = labels.withColumn("toxic", F.when(skip, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda y: {r["doc_id"]: r["score_"] for r in toxicity.toxicity_scores(docs, y).collect()}
    assert score(labels) == score(flipped)


def test_hasher_and_ftrl():
    h = hashed_text.Hasher()
    assert len(h(None)) == len(h(b"")) == len(h(b"!?")) == 0 and len(h(b"a b c")) == 6 and (h(b"A, b! C") == h(b"a b c")).all()
    assert set(h(b"a b").tolist()) < set(h(b"a b c").tolist())
    rows = [h(f"{'bad' if i % 2 else 'good'} x{i}".encode()) for i in range(200)]
    at, w, _ = hashed_text.Ftrl().fit(rows, np.arange(200) % 2 == 1)
    assert 0 < len(at) < 60  # L1 leaves few


LANGS = {"aa": ["kalo", "miru", "tesa", "ropi"], "bb": ["strak", "blonk", "wirst", "glumpf"], "cc": ["éau", "çant", "ûlu", "àrec"]}


def speech(n=300):
    rng = random.Random(4)
    return [(i, " ".join(rng.choices(LANGS[lang], k=12)) + ".", lang) for i, lang in ((i, sorted(LANGS)[i % 3]) for i in range(n))]


def test_language(spark):
    rows = speech()
    df = spark.createDataFrame(rows + [(1000, "kalo", None)], DOCS + ", lang string")
    model = language_id.train(df, lambda i: language_id.held_out(i, 4, 2))
    odd = [(500, None), (501, ""), (502, "123 !?"), (503, "kalomiru tesaropi"), (504, "STRAKWIRST"), (504, "STRAKWIRST"), (None, "éauçant"), (505, "kalo " * 30_000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(spark.createDataFrame(odd + [(i, t) for i, t, _ in rows], DOCS), model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] == "aa" and got[504][0] == "bb" and got[None][0] == "cc" and got[505][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify_language(df, empty).collect()} == {"und"}


def test_language_backs_off():
    rows = [(0, "ab", [9, 0]), (1, "q", [2, 1]), (3, "<qq", [1, 5]), (3, "zzz", [4, 0])]
    some = [[i for i, n in enumerate(r[2]) if n] for r in rows]
    m = language_id.BackoffModel(["x", "y"], pa.table({"k": [r[0] for r in rows], "gram": [r[1] for r in rows], "at": some, "n": [[r[2][i] for i in at] for r, at in zip(rows, some, strict=True)]}))
    assert m.predict("ab")[0] == "x"
    log = lambda c, total, grams: np.log((np.array(c) + 0.1) / (np.array(total) + 0.1 * (grams + 1)))
    # <qq is known two orders down, > at no order
    assert np.allclose(m.score(list(m.rows("qq"))), log([1, 5], [5, 5], 2) + log([0, 0], [2, 1], 1))
    assert np.allclose(m.score(list(m.rows("ab"))), log([9, 0], [9, 0], 1))


def plain_language(learned, text):
    """Words first, then the longest known n-gram of each place, from plain counts."""
    words = re.compile(r"[^\W\d_]+")
    counts = {}  # (order, gram) -> lang -> n
    for _, t, lang in learned:
        for w in words.findall(t.lower()):
            for k, gram in [(0, w)] + [(k, f"<{w}>"[i : i + k]) for k in (5, 4, 3, 2, 1) for i in range(len(w) + 3 - k)]:
                counts.setdefault((k, gram), {}).setdefault(lang, 0)
                counts[k, gram][lang] += 1
    langs = sorted({lang for _, _, lang in learned})
    grams = {k: sum(1 for o, _ in counts if o == k) for k in range(6)}
    whole = {(k, lang): sum(c.get(lang, 0) for (o, _), c in counts.items() if o == k) for k in range(6) for lang in langs}
    log = lambda k, gram, lang: math.log((counts.get((k, gram), {}).get(lang, 0) + 0.1) / (whole[k, lang] + 0.1 * (grams[k] + 1)))
    found = words.findall((text or "").lower())
    if not langs or not any(c.isalpha() for w in found for c in w):
        return "und", 0.0
    total = dict.fromkeys(langs, 0.0)
    for w in found:
        steps, at, marked = [], 0, f"<{w}>"
        if (0, w) in counts:
            steps = [(0, w)]
        while at < len(marked) and not (0, w) in counts:
            k, gram = next(((k, marked[at : at + k]) for k in (5, 4, 3, 2, 1) if (k, marked[at : at + k]) in counts), (1, marked[at]))
            steps.append((k, gram))
            at += len(gram)
        for lang in langs:
            total[lang] += sum(log(k, gram, lang) for k, gram in steps)
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)


def test_language_against_plain(spark):
    """Ties, unseen words and characters, repeats, many dirty languages, clashing columns and an empty table."""
    rows = speech(60) + [(100 + i, f"x{'abcdefghij'[i]} same", f"dirty{i}") for i in range(10)] + [(200, "same", "aa"), (201, "same", "bb"), (202, None, "aa"), (203, "x", None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string").repartition(3)
    model = language_id.train(df)
    odd = [(1, "same"), (1, "same"), (2, "kalo glumpf unseenword"), (3, None), (4, "日本 çantkalo"), (5, "zzzz qqqq"), (None, "miruxx"), (6, "strak " * 3000), (7, "99 _ !")]
    given = spark.createDataFrame([(i, t, "l", 1, 0.5) for i, t in odd], DOCS + ", lang_pred string, k int, score double")
    got = language_id.identify_language(given, model)
    learned = [r for r in rows if None not in r]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(((i, *plain_language(learned, t)) for i, t in odd), key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9
    assert language_id.identify_language(given.limit(0), model).count() == 0


def test_language_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    df = spark.createDataFrame([(i, f"w{'ab'[i % 2]} v", f"l{min(i // 10, 2)}") for i in range(25)], DOCS + ", lang string")
    assert language_id.train(df).langs == ["l0", "l1"]
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 0)
    assert language_id.train(df).table.num_rows == 0


def test_language_held_out_accuracy(spark):
    got = language_id.op9_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert r[0] >= 0.98 and r[1] > 100


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer, models, pre_tokenizers

    def make(pieces, unknown, byte_pieces):
        t = Tokenizer(models.Unigram(pieces, unknown, byte_pieces))
        t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        return t

    return make


def test_token_counts_match_the_public_tokenizer(spark, tokenizers, small):
    pieces, unknown, byte_pieces = token_count.read_pieces()
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  b ", "日本語 テスト😀😀 \x01", "é" * 40, "\n\n a\tb", "<unk> <s> <0x41>", "▁▁x ▁"] + ["".join(rng.choice("ab ▁ é😀\ntheing") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    plain = [(p, s) for i, (p, s) in enumerate(pieces) if not 3 <= i < 259]
    ties = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("▁ab", -4.0)]
    for model in ((pieces, unknown, byte_pieces), (plain, 0, False), (ties, 0, False)):
        mine, public = token_count.Counter(*model), tokenizers(*model)
        assert [mine.count(t) for t in texts] == [len(public.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


def test_token_counts_frame(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5), (None, "x" * 200_000, 5)], DOCS + ", n_tokens int")
    got = [tuple(r) for r in token_count.token_counts(df).collect()]
    assert [x[:2] for x in got] == [(1, 0), (2, 0), (3, 11), (3, 11), (None, 200_000)] and got[0][2] == got[1][2] == 0 and got[2][2] == got[3][2] > 1 and got[4][2] > 1000
    assert token_count.token_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("carry", [1000, 3])
def test_descent_ends_at_the_optimum(spark, monkeypatch, carry):
    """Against a plain projected gradient that runs much longer; rates written on the way change nothing."""
    monkeypatch.setattr(mixing, "CARRY", carry)
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(0, 50, 400)
    t = np.array([0.5, 0.3, 0.2])
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist(), 1.0, 1.0) for i in range(400)], "doc_id long, n long, p array<double>, rate double, ahead double").coalesce(2)
    d = mixing.fit_rates(members, t, 0.05)
    rate = d.rates(p)
    r = np.ones(400)
    for _ in range(20_000):
        r = np.maximum(0, r - d.step * (p @ ((r * n) @ p / n.sum() - t) + 0.05 * (r - 1)))
    assert (rate >= 0).all() and np.abs(r - rate).max() < 5e-3 and np.abs((rate - r) * n @ p / n.sum()).max() < 1e-3
    if carry == 3:
        with pytest.raises(RuntimeError):
            mixing.fit_rates(members, t, 0.05, steps=2)


def plain_mixture(rows, labelled, targets, domains):
    """Words, coordinates, one-against-rest FTRL, posteriors, descent and copies, one text after the other."""
    models = [plain_ftrl(labelled, d) for d in domains]
    out = []
    for i, text in rows:
        at = sorted(plain_grams(text))
        p = [1 / (1 + math.exp(-max(-35, min(35, sum(w.get(c, 0.0) for c in at) + bias)))) for w, bias in models]
        out.append([i, len(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())), [x / sum(p) for x in p]])
    n, p, t = np.array([x[1] for x in out], dtype=float), np.array([x[2] for x in out]), np.array(targets)
    r = np.ones(len(out))
    for _ in range(30_000):
        r = np.maximum(0, r - (p @ ((r * n) @ p / n.sum() - t) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE))
    return [(i, k, post, 1.0 if k == 0 else x) for (i, k, post), x in zip(out, r.tolist(), strict=True)]


def test_mixing_against_plain(spark, labelled):
    docs, labels = labelled
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(700, None), (701, ""), (1, corpus()[1][1]), (None, "vile word1"), (702, "word3 " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], DOCS + ", n int, p string, rate double").repartition(3)
    got = mixing.mixture_rates(df, labels, {0: 0.6, 1: 0.4}, domain="toxic").collect()
    known = {r["doc_id"] for r in df.collect()}
    want = plain_mixture(rows, [(i, t, max(y, 0)) for i, t, y in corpus() if i in known], [0.6, 0.4], [0, 1])
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    got = sorted(((r["doc_id"], r["n"], r["p"], r["rate"], r["copies"]) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2], b[2], atol=1e-9) and abs(a[3] - b[3]) < 0.02 and int(a[3]) <= a[4] <= int(a[3]) + 1


def test_mixing(spark, labelled):
    docs, labels = labelled
    rates = mixing.mixture_rates(docs, labels, {0: 0.5, 1: 0.5}, domain="toxic").toPandas()
    total = rates["n"].sum()
    for k in (0, 1):
        assert abs((rates["n"] * rates["rate"] * rates["p"].str[k]).sum() / total - 0.5) < 0.01
    assert (rates["rate"] >= 0).all() and (rates["copies"] >= 0).all() and abs(rates["copies"].sum() - rates["rate"].sum()) < 60
    assert ((rates["copies"] - rates["rate"]).abs() < 1).all()


def test_mixing_awkward(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(1, None, 1.5), (2, "", 1.5), (None, "word1", 1.5), (3, "word2 vile", 1.5), (3, "word2 vile", 1.5)], DOCS + ", rate double")
    got = mixing.mixture_rates(odd, labels, learn_from=docs).toPandas()
    assert len(got) == 5 and (got.loc[got["n"] == 0, "rate"] == 1.0).all()
    out = mixing.apply_mixture(odd, labels, learn_from=docs)
    assert out.columns == ["doc_id", "text", "rate", "rate_", "copies"]
    assert mixing.mixture_rates(odd.limit(0), labels, learn_from=docs).count() == 0
    even = mixing.mixture_rates(odd, labels.limit(0), learn_from=docs).toPandas()
    assert all(np.allclose(p, 0.5) for p in even["p"])
