"""The stored index against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import retrieval as G
from evalloom.operators import vector_index as X

COLUMNS = "vec_id long, embedding array<double>, label int, list int, id string"


def clustered(spark, n=600, groups=12, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, 8)) * 4
    data = [(k, (centers[k % groups] + rng.normal(size=8)).tolist(), k % 3, 0, "x") for k in range(n)]
    data += [(n + k, [1.0] * 8, k % 3, 0, "x") for k in range(copies)]
    return spark.createDataFrame(data + [(None, [0.0] * 8, 0, 0, ""), (n + copies, None, 0, 0, "")], COLUMNS), data


def scanned(data, asked, k, same=lambda a, b: True):
    out = []
    for q in asked:
        near = sorted((-round(float(np.dot(q[1], r[1])), 9), r[0]) for r in data if same(q, r))[:k]
        out += [(q[0], i, n + 1) for n, (_, i) in enumerate(near)]
    return sorted(out)


def answers(df):
    return sorted((r.question, r.id, r["rank"]) for r in df.collect())


def test_an_exact_search_is_a_full_scan_and_probing_finds_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    monkeypatch.setattr(X, "DEALT", 300)
    rows, data = clustered(spark, copies=200)
    asked = rows.where("vec_id % 20 = 0")
    want = scanned(data, [r for r in data if r[0] % 20 == 0], 7)
    index = X.build(rows, str(tmp_path / "index"), "vec_id", "embedding")
    assert index.sizes.sum() == len(data) and len(index.lists) <= round(len(data) ** 0.5)
    assert {len(r.ids) for r in index.blocks(spark).collect()} <= set(range(1, 17))
    for probes in (1, 3):
        assert answers(X.search_exactly(index, asked, "vec_id", "embedding", 7, probes)) == want
    probes = X.calibrated(index, rows, "vec_id", "embedding", 7, 0.95)
    found = set(answers(X.search(index, asked, "vec_id", "embedding", 7, probes)))
    assert len({x[:2] for x in found} & {x[:2] for x in want}) >= 0.9 * len(want)
    assert X.rows_read(index, asked, "vec_id", "embedding", probes).agg(F.max("rows")).first()[0] < len(data) / 2
    assert answers(X.search(X.opened(spark, index.path), asked, "vec_id", "embedding", 7, len(index.lists))) == want


def test_building_again_replaces_the_index(spark, tmp_path):
    rows, _ = clustered(spark, 50)
    path = str(tmp_path / "index")
    X.build(rows, path, "vec_id", "embedding", 5)
    index = X.build(rows.where("vec_id < 10"), path, "vec_id", "embedding", 2)
    assert index.sizes.sum() == 10 and {i for r in index.blocks(spark).collect() for i in r.ids} == set(range(10))


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_nearest_within_columns(spark, k, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    rows, data = clustered(spark, 90, copies=30)
    rows = rows.where("vec_id is not null")
    q = rows.where("vec_id % 7 = 0").select("label", F.col("vec_id").alias("question"), F.col("embedding").alias("q_vector"), F.lit("asked").alias("note"))
    p = rows.select("label", F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("p_vector"), F.concat(F.lit("t"), "vec_id").alias("text"))
    found = G.nearest(q, p, ["label"], "question", k)
    assert sorted((r.question, r.chunk_id, r["rank"]) for r in found.collect()) == scanned(data, [r for r in data if r[0] % 7 == 0], k, lambda a, b: a[2] == b[2])
    assert found.where("text <> concat('t', chunk_id) or note <> 'asked'").count() == 0 and {"q_vector", "p_vector"}.isdisjoint(found.columns)


def test_empty_tables_and_fewer_rows_than_ranks(spark, tmp_path):
    rows, data = clustered(spark, 5)
    none = X.build(rows.limit(0), str(tmp_path / "none"), "vec_id", "embedding")
    assert X.search(none, rows, "vec_id", "embedding", 3, 2).count() == 0 and X.search_exactly(none, rows, "vec_id", "embedding", 3).count() == 0
    assert X.calibrated(none, rows, "vec_id", "embedding", 3, 0.9) == 1
    index = X.build(rows, str(tmp_path / "few"), "vec_id", "embedding")
    assert answers(X.search_exactly(index, rows, "vec_id", "embedding", 9)) == scanned(data, data, 9)
    assert X.search(index, rows.limit(0), "vec_id", "embedding", 3, 1).count() == 0


def test_rows_of_one_key_are_dealt_to_parts(spark, monkeypatch):
    from evalloom.operators import vector_index as index

    rows = spark.range(1200).selectExpr("id", "0 AS all", "array(cast(id * 37 % 101 as double), cast(id % 13 as double)) AS v")
    asked = rows.where("id % 100 = 0")
    find = lambda: sorted(map(tuple, index.nearest(asked, rows, ["all"], 5, ("id", "id"), ("v", "v")).collect()))
    whole = find()
    monkeypatch.setattr(index, "PART", 100)
    assert find() == whole and len(whole) == 60
