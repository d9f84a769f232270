"""Searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from marketlake.llm import norm_buckets, prefix_forest, vectors

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def given(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    m = centres[r.integers(0, 40, 3000)] * 0.6 + r.normal(size=(3000, 16))
    m *= r.lognormal(size=3000)[:, None]
    m[700:1400] = m[700]  # a hot vector
    rows = [(int(i) * 5, [float(x) for x in v], 1) for i, v in enumerate(m)]
    rows[10], rows[20], rows[30], rows[40] = (50, None, 1), (100, [0.0] * 16, 1), (150, [NAN] * 16, 1), (200, [1.0] * 15 + [INF], 1)
    rows[50], rows[60] = (250, [None] * 16, 1), (300, [], 1)
    rows += [(None, [1.0] * 16, 1), (100000, [1.0, 2.0], 1), (100001, [2.0, 1.0], 1), (100003, [1.0, 0.0], 1)]
    return rows


@pytest.fixture(scope="module")
def table(spark, given):
    return spark.createDataFrame([(*r[:2], 1, 2) for r in given], "vec_id long, embedding array<double>, rank int, v int").repartition(4)


def usable(given):
    return {i: np.array(v) for i, v, _ in given if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}


def test_forest_reaches_the_recall(table, given):
    rows = {i: v for i, v in usable(given).items() if v.any()}
    got = {}
    for r in prefix_forest.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in rows if i % 50 == 0]
    assert set(got) == set(queries)
    hits = total = 0
    for q in queries:
        scores = {i: float(v @ rows[q] / np.sqrt((v @ v) * (rows[q] @ rows[q]))) for i, v in rows.items() if i != q and len(v) == len(rows[q])}
        least = sorted(scores.values(), reverse=True)[:5][-1]
        assert [x[0] for x in got[q]] == list(range(1, min(5, len(scores)) + 1)) and q not in [x[1] for x in got[q]]
        for _, i, s in got[q]:
            assert abs(s - scores[i]) < 1e-12
            hits += s >= least - 1e-12
        assert [(x[2], x[1]) for x in got[q]] == sorted([(x[2], x[1]) for x in got[q]], key=lambda x: (-x[0], x[1]))
        total += min(5, len(scores))
    assert hits / total >= 0.95


def test_forest_recall_on_the_embeddings(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = prefix_forest.search(df).collect()
    hits = 0
    for q in {r["query_id"] for r in got}:
        scores = sorted(((-float(v @ rows[q] / np.sqrt((v @ v) * (rows[q] @ rows[q]))), i) for i, v in rows.items() if i != q))[:5]
        hits += len({i for _, i in scores} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * len(got) and len(got) == 5 * len({r["query_id"] for r in got})


def test_forest_misses_fall_with_more_trees():
    assert prefix_forest.needed_cosine(8, 10, 0.06) > prefix_forest.needed_cosine(4, 10, 0.06) > prefix_forest.needed_cosine(2, 10, 0.06)
    assert prefix_forest.needed_cosine(8, 10, 0.06) > prefix_forest.needed_cosine(8, 40, 0.06)


def brute_products(rows, every, top):
    out = []
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows.items()}
    for q in (i for i in whole if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(v, whole[q], strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:top])]
    return sorted(out)


def test_products_are_exact(table, given):
    got = sorted(map(tuple, norm_buckets.search(table, top=10).collect()))
    assert got == brute_products(usable(given), 100, 10)


def test_products_beyond_doubles_and_empty(spark):
    rows = [(100, [2.0**20, 3.0]), (1, [2.0**21 + 1, -7.5]), (2, [-(2.0**20), 1.0]), (3, [0.0, 0.0]), (4, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_products({i: np.array(v) for i, v in rows}, 100, 10)
    assert sorted(map(tuple, norm_buckets.search(df).collect())) == want
    assert norm_buckets.search(df.limit(0)).collect() == [] == prefix_forest.search(df.limit(0)).collect()


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in prefix_forest.search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert [tuple(r) for r in norm_buckets.search(df).orderBy("rank").collect()] == [(0, 1, 1, 1048576), (0, 2, 2, 0)]


def test_an_id_with_different_vectors_is_a_candidate_with_each(spark):
    import duckdb
    from marketlake.llm.queries import SQL

    rows = [(0, [3.0, 1.0]), (0, [2.0, 5.0]), (1, [1.0, 1.0]), (1, [-1.0, 2.0]), (1, [1.0, 1.0]), (100, [4.0, 4.0]), (2, [1.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in norm_buckets.search(df).collect())
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert got == sorted(con.execute(SQL["op7_norm_buckets"]).fetchall())
    assert [g[2:] for g in got if g[0] == 0] == [(2, 37 << 20), (100, 28 << 20), (1, 8 << 20), (1, 7 << 20)]  # asks with (2, 5)
    near = sorted(tuple(r)[:3] for r in prefix_forest.search(df).collect())
    assert sorted(x[2] for x in near if x[0] == 0) == [1, 1, 2, 100]


def test_blocks_do_not_change_results(table, monkeypatch):
    whole = sorted(map(tuple, norm_buckets.search(table).collect()))
    monkeypatch.setattr(vectors, "DATA_BLOCK", 400)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    assert sorted(map(tuple, norm_buckets.search(table).collect())) == whole
