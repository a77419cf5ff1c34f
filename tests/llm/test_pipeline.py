"""Queries over the small tables and the pipeline from end to end."""

import os

import duckdb
import pytest

import corpus_pipeline
from keelson.llm import queries

from ..conftest import SMALL
from ..test_catalog import canon
from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert len(got) == duck.execute(f"SELECT count(*) FROM {'pages' if name.startswith('op1_') else 'documents'}").fetchone()[0]
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        for c in ("first_word", "last_word"):
            for f in (got, want):
                if c in f:
                    f[c] = f[c].astype(float)
        assert canon(got) == canon(want)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns[:5] == COLUMNS
        if name == "line_dedup":
            rows = sorted(before.items())
            assert after == {i: t for (i, _), (_, _, t) in zip(rows, brute.lines(rows), strict=True)}
        else:
            assert all(before[i] == t for i, t in after.items())
        if name == "near_dedup":
            assert len({" ".join(brute.blank_words(t)) for t in after.values()}) == len(after)
            ids, sets = sorted(before), {i: set(brute.shingles(t, 5)) for i, t in before.items()}
            same = lambda i, j: len(sets[ids[i]] & sets[ids[j]]) >= 0.8 * len(sets[ids[i]] | sets[ids[j]])
            assert set(after) == {ids[r] for r in brute.components(len(ids), same)}
        if name == "decontaminate":
            assert set(after) == {i for i, t in before.items() if not brute.contamination(t, items)[1]}
    assert docs.columns == [*COLUMNS, "rate", "copies"] and docs.where("copies < 1").count() == 0


def test_stages_meet_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties and repeated rows, an empty table, columns that clash."""
    rows = [(1, None, None, None, None), (2, "", "aa", "s", 0), (None, "words of no id " * 9, None, "s", 1), (3, "the same text " * 20, "aa", None, 280), (3, "the same text " * 20, "aa", None, 280), (4, "long " * 60_000, "bb", "s", 300_000), (5, "\n\n \t", "aa", "s", 4)]
    more = ", _row int, row string, pid long, rate double, copies int, score double, y int"
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + more
    start = spark.createDataFrame([(*r, 1, "r", 2, 0.5, 3, 0.1, 1) for r in rows], kinds)
    start.write.parquet(str(tmp_path / "start"))
    for docs in (spark.read.parquet(str(tmp_path / "start")), start, start.limit(0)):
        empty = docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns + (["rate_", "copies_"] if name == "mixing" else [])
            got = [(r["doc_id"], r["text"]) for r in out.collect()]
            if empty:
                assert got == []
            elif name == "near_dedup":
                assert sorted(got, key=str) == sorted([(1, None), (None, rows[2][1]), (3, rows[3][1]), (4, rows[5][1])], key=str)
            elif name != "mixing":
                assert sorted(got, key=str) == sorted([(r[0], r[1]) for r in rows], key=str)


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "mixing"])
def test_stages_bound_arrow_batches(spark, tmp_path, name):
    """Texts of 30 MB in one partition reach Python in batches of a few MB; a smaller bound of the caller's stays."""
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches)
    kept = spark.conf.get(key)
    try:
        for bound, most in ((kept, 8 << 20), (1 << 20, 2 << 20)):
            spark.conf.set(key, bound)
            spark.range(3).selectExpr("id AS doc_id", "'a few words' AS text", "'aa' AS lang", "'s' AS source", "11L AS n_chars").write.parquet(path := str(tmp_path / str(most)))
            dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(path), SMALL)
            texts = spark.range(0, 300, 1, 1).selectExpr("repeat(cast(id % 10 as string), 100000) AS text")
            got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 30_000_000 and max(got) <= most
    finally:
        spark.conf.set(key, kept)


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SMALL).count() < spark.read.parquet(f"{SMALL}/documents.parquet").count()
