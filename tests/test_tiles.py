"""Tiled products against attention and top keys by their definitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evalloom.operators import attention as A
from evalloom.operators import chunked_attention as K
from evalloom.operators import retention, tiles

SIZE = 8


def drawn(spark, seed=0, gaps=True):
    rng = np.random.default_rng(seed)
    heads = {(0, 0): 70, (0, 1): 9, (1, 0): 33}
    q, kv = [], []
    for (layer, head), n in heads.items():
        places = sorted(rng.choice(2 * n, n, replace=False).tolist()) if gaps else range(n)
        for p in places:
            kv.append((layer, head, p, np.round(rng.normal(size=SIZE), 1).tolist(), rng.normal(size=SIZE).tolist(), n))
        for p in rng.choice(2 * n, n // 2, replace=False).tolist():
            q.append((layer, head, p, np.round(rng.normal(size=SIZE), 1).tolist()))
    queries = spark.createDataFrame(q, "layer int, head int, qpos int, query array<double>")
    return queries, spark.createDataFrame(kv, "layer int, head int, pos int, key array<double>, value array<double>, k_len long"), q, kv


def visible(row, kv, offset):
    return [k for k in kv if k[:2] == row[:2] and (offset is None or k[2] <= row[2] + offset)]


@pytest.mark.parametrize("tile,band,offset", [(256, 16, 0), (4, 2, 0), (4, 1, 5), (8, 3, None), (1, 1, -2)])
def test_attention_by_its_definition(spark, monkeypatch, tile, band, offset):
    monkeypatch.setattr(tiles, "BAND", band)
    queries, kv, q, keys = drawn(spark)
    found = {(r.layer, r.head, r.qpos): r for r in tiles.attention(queries.withColumn("value", F.lit(1)), kv, SIZE, 0.7, offset, tile=tile).collect()}
    want = {}
    for row in q:
        seen = visible(row, keys, offset)
        if seen:
            logit = np.array([0.7 * np.dot(row[3], k[3]) for k in seen])
            e = np.exp(logit - logit.max())
            want[row[:3]] = (e @ np.array([k[4] for k in seen]) / e.sum(), logit.max() + np.log(e.sum()))
    assert found.keys() == want.keys()
    for key, (out, lse) in want.items():
        assert np.allclose(found[key].out, out) and found[key].lse == pytest.approx(lse)


@pytest.mark.parametrize("tile,block,latest", [(256, None, False), (4, None, True), (8, 4, False), (8, 4, True)])
def test_top_keys_by_their_definition(spark, tile, block, latest):
    queries, kv, q, keys = drawn(spark, 3)
    # Equal keys make ties.
    kv = kv.withColumn("key", F.when(F.col("pos") % 3 == 0, F.array(*[F.lit(0.5)] * SIZE)).otherwise(F.col("key")))
    keys = [(*k[:3], [0.5] * SIZE if k[2] % 3 == 0 else k[3], *k[4:]) for k in keys]
    found = sorted((r.layer, r.head, r.qpos, r["rank"], r.pos, round(r.logit, 9)) for r in tiles.top_keys(queries, kv, SIZE, 3, 1.0, 0, block, latest, tile).collect())
    want = []
    for row in q:
        scored = [(-round(float(np.dot(row[3], k[3])), 9), -k[2] if latest else k[2], k[2]) for k in visible(row, keys, 0)]
        if block:
            scored = [min(s for s in scored if s[2] // block == b) for b in {s[2] // block for s in scored}]
        want += [(*row[:3], n + 1, s[2], -s[0]) for n, s in enumerate(sorted(scored)[:3])]
    assert found == sorted(want)
    with pytest.raises(ValueError, match="whole blocks"):
        tiles.top_keys(queries, kv, SIZE, 3, block=3, tile=8)


def test_shared_key_heads_and_empty_relations(spark):
    queries, kv, *_ = drawn(spark, gaps=False)
    four = queries.where("head = 0").withColumn("head", F.explode(F.array(*map(F.lit, range(4)))))
    shared = tiles.attention(A.spread_heads(four, 2), kv, SIZE).collect()
    alone = {(r.layer, r.head, r.qpos): r.lse for r in tiles.attention(four.withColumn("head", F.floor(F.col("head") / 2).cast("int")).distinct(), kv, SIZE).collect()}
    assert len(shared) > len(alone) and all(r.lse == pytest.approx(alone[r.layer, r.q_head // 2, r.qpos]) for r in shared)
    none = queries.withColumn("qpos", F.lit(None).cast("int"))
    for a, b in ((queries.limit(0), kv), (queries, kv.limit(0)), (none, kv)):
        assert tiles.attention(a, b, SIZE).count() == 0 and tiles.top_keys(a, b, SIZE, 2).count() == 0


def test_no_row_per_pair_is_made(spark):
    """The join has a row for each two tiles."""
    queries, kv, *_ = drawn(spark, gaps=False)
    every = kv.selectExpr("layer", "head", "pos AS qpos", "key AS query")
    assert tiles.tile_pairs(every, kv, 0, 10).groupBy("layer", "head").count().sort("layer", "head").collect()[0][2] == 28
    assert tiles.tile_pairs(every, kv, None, 10).where("layer = 0 and head = 0").count() == 49


def test_decoding_steps_agree_with_the_prompt_pass(spark):
    _, kv, *_ = drawn(spark, 5, gaps=False)
    every = kv.selectExpr("layer", "head", "pos AS qpos", "key AS query")
    whole = {(r.layer, r.head, r.qpos): r for r in K.dual_chunk(every, kv, SIZE, 12, 4).collect()}
    last = every.join(kv.select("layer", "head", "k_len").distinct(), ["layer", "head"]).where("qpos = k_len - 1").drop("k_len")
    for r in K.dual_chunk_decode(last, kv, SIZE, 12, 4).collect():
        same = whole[r.layer, r.head, r.qpos]
        assert np.allclose(r.out, same.out) and r.lse == pytest.approx(same.lse)


def test_received_attention_makes_no_row_per_pair(spark):
    rng = np.random.default_rng(3)
    x = {h: rng.normal(size=(n, 4)) for h, n in ((0, 11), (1, 7))}
    kv = spark.createDataFrame([(0, h, p, v.tolist(), v.tolist()) for h, m in x.items() for p, v in enumerate(m)], "layer int, head int, pos long, key array<double>, value array<double>")
    found = {(r["head"], r["pos"]): r.mass for r in tiles.received(kv.selectExpr("layer", "head", "pos AS qpos", "key AS query"), kv, 4, 0.5, tile=3).collect()}
    for h, m in x.items():
        w = np.tril(np.exp(m @ m.T * 0.5))
        w /= w.sum(axis=1, keepdims=True)
        assert all(abs(found[h, p] - w[:, p].sum()) < 1e-12 for p in range(len(m)))
    plan = retention.attention_mass(kv, kv.selectExpr("layer", "head", "pos AS qpos", "key AS query"), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "exp(" not in plan.lower()


def test_last_queries_of_a_block_make_no_row_per_pair(spark):
    """Survivors of earlier blocks leave gaps, so many positions lie behind the number of positions less the window."""
    rng = np.random.default_rng(6)
    at = {0: [0, 3, 4, 7, 8, 9, 11, 14], 1: [1, 2, 5, 6, 12]}
    x = {h: rng.normal(size=(len(p), 4)) for h, p in at.items()}
    kv = spark.createDataFrame([(0, h, p, v.tolist(), v.tolist(), len(at[h])) for h in at for p, v in zip(at[h], x[h], strict=True)], "layer int, head int, pos long, key array<double>, value array<double>, k_len long")
    scored = retention.snapkv(kv, kv.where("pos >= k_len - 2").selectExpr("layer", "head", "pos AS qpos", "key AS query"), 2, 0.5, 3)
    assert scored.columns == [*kv.columns, "score"]
    want = {}
    for h, p in at.items():
        p, early = np.array(p), np.array(p) < len(p) - 2
        e = np.exp(x[h] @ x[h].T * 0.5) * (p[None, :] <= p[:, None])
        mass = (e / e.sum(axis=1, keepdims=True))[~early].sum(axis=0)[early] / 2
        want |= {(h, int(q)): s for q, s in zip(p[early], np.convolve(mass, np.ones(3))[1:-1] / 3, strict=True)}
    top = max(want.values())
    assert all(abs(r.score - want.get((r["head"], r.pos), top)) < 1e-12 for r in scored.collect())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "exp(" not in plan.lower()


def test_batches_of_dual_chunk_attention_are_bounded_by_bytes(spark):
    _, kv, *_ = drawn(spark, gaps=False)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 30)
    K.dual_chunk(kv.selectExpr("layer", "head", "pos AS qpos", "key AS query"), kv, SIZE, 12, 4)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == tiles.BATCH_BYTES
    tile = 8 * 3 * 64 * tiles.SIZE
    rows = spark.range(0, 60, 1, 1).select(F.array_repeat(F.col("id").cast("double"), tile // 8).alias("query"))
    sizes = [r.n for r in tiles.bounded(rows, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), StructType([StructField("n", LongType())])).collect()]
    assert sum(sizes) >= 60 * tile and max(sizes) <= tiles.BATCH_BYTES + 2 * tile


def test_dual_chunk_attention_gets_a_few_tiles_at_a_time(spark, monkeypatch):
    """One head of 20 tiles makes 210 pairs of tiles, 17 MB, in two bands."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    n, row, running = 20 * tiles.SIZE, 8 * tiles.SIZE * (5 * SIZE + 2), tiles._running
    most = tiles.BATCH_BYTES + 2 * row

    def watched(*how):
        run = running(*how)

        def narrow(batches):
            for b in batches:
                if b.nbytes > most:
                    raise ValueError(f"a batch of {b.nbytes} bytes")
                yield b

        return lambda batches: run(narrow(batches))

    monkeypatch.setattr(tiles, "_running", watched)
    vector = F.transform(F.sequence(F.lit(1), F.lit(SIZE)), lambda i: F.sin(F.col("id") * i))
    kv = spark.range(n).select(F.lit(0).alias("layer"), F.lit(0).alias("head"), F.col("id").alias("pos"), vector.alias("key"), vector.alias("value"))
    out = K.dual_chunk(kv.selectExpr("layer", "head", "pos AS qpos", "key AS query"), kv, SIZE, 12, 4)
    assert sorted(r.qpos for r in out.select("qpos").collect()) == list(range(n))
