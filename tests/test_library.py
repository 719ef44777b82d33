"""Laws of the operators, streams against batches, and the artefacts of a run."""

import json
import os
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalloom.catalog.base import keys
from evalloom.config import RunConfig, load_file, target_ratio
from evalloom.operators import attention as A
from evalloom.operators import chunked_attention as K
from evalloom.operators import plumbing as P
from evalloom.operators import relations, rollup
from evalloom.operators import retention as R
from evalloom.operators import vectors as V
from evalloom.plans import evaluation, methods
from evalloom.registry import Registry, benchmarks, compressors
from evalloom.sources import sinks, tables
from evalloom.streaming import retention as S

SF = "/root/testdata/sf0.001"
C = F.col


@pytest.fixture(scope="module")
def kv(spark):
    return keys(spark, SF).cache()


def ids(df):
    return sorted(map(tuple, df.select("layer", "head", "pos").collect()))


def test_ratio_zero_keeps_all_and_counts_are_floors(kv):
    scored = R.knorm(kv)
    assert ids(R.retain(scored, 0.0)) == ids(kv)
    for ratio in (0.3, 0.9):
        for r in R.retain(scored, ratio).groupBy("head").agg(F.count("*").alias("n"), F.max("k_len").alias("k")).collect():
            assert r.n == int(r.k * (1 - ratio))


def test_float_budget(spark):
    ten = relations.with_length(spark.range(10).selectExpr("0 AS layer", "0 AS head", "id AS pos", "cast(id as double) AS score"))
    assert R.retain(ten, 0.9).count() == int(10 * (1 - 0.9)) == 0


def test_wrappers(kv):
    scored = R.knorm(kv)
    plain = ids(R.retain(scored, 0.5))
    assert ids(R.in_chunks(scored, 0.5, 10_000)) == plain
    assert ids(R.per_layer(scored, {0: 0.5})) == plain
    assert ids(R.composed(lambda x: R.retain(R.knorm(x), 0.5))(kv)) == plain
    assert R.composed_ratio([0.5, 0.5]) == 0.75
    top = ids(R.retain(R.snapkv(kv, relations.last_queries(kv, 4), 4, 0.125), 0.5))
    assert all((r.layer, r.head, r.pos) in set(top) for r in kv.where("pos >= k_len - 4").collect())


def test_ties_go_to_the_smaller_position(spark):
    same = relations.with_length(spark.range(6).selectExpr("0 AS layer", "0 AS head", "id AS pos", "1.0D AS score"))
    assert [p for *_, p in ids(R.retain(same, 0.5))] == [0, 1, 2]


@pytest.mark.parametrize("ratio", [0.0, 0.0005, 0.37, 1.0])
def test_lowest_is_exact(spark, ratio):
    df = spark.range(5000).selectExpr("cast(id % 3 as int) AS layer", "0 AS head", "id AS pos", "cast(id * 7919 % 60 as double) AS score")
    want = sorted((r.score, r.layer, r.head, r.pos) for r in df.collect())[: int(5000 * ratio)]
    assert sorted((r.score, r.layer, r.head, r.pos) for r in R.lowest(df, ratio).collect()) == want


def test_merged_partials_equal_direct_attention(kv):
    q = relations.last_queries(kv, 3)
    rows = A.logits(q, kv, 0.125)
    direct = {(r.head, r.qpos): r for r in A.attend(rows, 64).collect()}
    for r in A.merge_partials(A.attend(rows.withColumn("part", C("pos") % 4), 64, (*A.ROW, "part")), 64).collect():
        assert r.lse == pytest.approx(direct[r.head, r.qpos].lse, abs=1e-9)
        assert r.out == pytest.approx(direct[r.head, r.qpos].out, abs=1e-9)


def test_one_chunk_is_plain_rotary_attention(kv):
    q, fr = relations.last_queries(kv, 2), A.inverse_frequencies(10000.0, 64)
    turned = kv.withColumn("key", A.rotated(C("key"), C("pos").cast("double"), fr))
    plain = A.attention(q.withColumn("query", A.rotated(C("query"), C("qpos").cast("double"), fr)), turned, 64)
    want = {(r.head, r.qpos): r.out for r in plain.collect()}
    for r in K.dual_chunk(q, kv, 64, 2000, 100).collect():
        assert r.out == pytest.approx(want[r.head, r.qpos], abs=1e-9)


def test_rotation_is_undone_and_base_recovered(kv):
    fr = A.inverse_frequencies(10000.0, 64)
    p = C("pos").cast("double")
    gap = kv.select(F.max(V.l2(F.zip_with("key", A.rotated(A.rotated(C("key"), p, fr), p, fr, undo=True), lambda a, b: a - b))).alias("g")).first().g
    assert gap < 1e-9
    assert A.recovered_base(fr) == (pytest.approx(10000.0), 64)


def test_quantization_is_close(kv):
    x = kv.withColumn("x", V.quantize(C("key")))
    far = x.select(F.max(F.array_max(F.zip_with("key", V.dequantize(C("x")), lambda a, b: F.abs(a - b))) / C("x.scale")).alias("g")).first().g
    assert far <= 0.5 + 1e-9


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id % 2 as int) AS layer", "cast(id % 3 as int) AS head", "id AS pos", "cast(id * 37 % 101 as double) AS score")
    for k in range(4):
        rows.where(f"pos >= {100 * k} and pos < {100 * k + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.chunks(spark, str(tmp_path / "in"), S.ROW)
    # Files of one second arrive in any order of names: take them as one batch for a fixed order.
    found = S.run_to_end(S.delayed_eviction(S.chunks(spark, str(tmp_path / "in"), S.ROW, 100), 10, 50.0), "evicted")
    assert stream.isStreaming
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, S.delayed_eviction_batch(rows, 10, 50.0).collect()))
    kept = S.run_to_end(S.bounded_cache(S.chunks(spark, str(tmp_path / "in"), S.ROW, 100), 5, 20), "kept")
    assert kept.groupBy("layer", "head", "step").count().agg(F.max("count"), F.min("count")).first()[:] == (5, 5)


def test_samples_and_caps(spark):
    df = spark.range(1000).selectExpr("id AS ord", "if(id % 10 = 0, null, concat('t', id % 3)) AS task")
    assert P.sample_fraction(df, 0.123, 1).count() == 123
    assert P.sample_fraction(df, 1.0, 1).count() == 1000
    assert P.cap_per_task(df, 0).count() == 0
    assert {r.task: r["count"] for r in P.cap_per_task(df, 5, {"t1": 7, "t2": 0}).groupBy("task").count().collect()} == {"t0": 5, "t1": 7}
    assert P.cap_per_task(df, None, {"t1": 2}).where("task = 't0'").count() == df.where("task = 't0'").count()
    with pytest.raises(ValueError, match="required"):
        P.require(df)


def test_prompt_parts_add_up(spark):
    body = "ctx one. What is x? maybe ctx two. What is x? It is"
    r = spark.range(1).select(P.split_prompt(F.lit(body), F.lit("What is")).alias("p")).first().p
    assert r.context + r.question + r.answer_prefix == body
    assert r.question == "What is x? "
    assert spark.range(1).select(P.split_prompt(F.lit(body), F.lit("nowhere")).alias("p")).first().p is None


def test_config(tmp_path):
    for bad in ({"fraction": 0.0}, {"top_p": 0.0}, {"temperature": -1.0}, {"backend": "x"}, {"max_requests_per_subset": {"a": -1}}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    c = RunConfig.merged({"model": "a/b", "unknown": 1}, {"fraction": 0.5, "output_dir": str(tmp_path), "subsets": "x, y"})
    assert c.tag() == "ruler32k__a--b__vllm__t0__p1__subsets_x-y__fraction0.500"
    first, second, third = c.run_dir(), c.run_dir(), c.run_dir()
    assert (second, third) == (first / "1", first / "2")
    (first / "3").write_text("in the way")
    assert c.run_dir() == first / "4"
    assert RunConfig(max_requests_per_subset={" a ": "3", " ": -1}).max_requests_per_subset == {"a": 3}
    c.save(tmp_path / "c.yaml")
    assert load_file(tmp_path / "c.yaml")["fraction"] == 0.5
    with pytest.raises(FileNotFoundError):
        load_file(tmp_path / "none.yaml")
    assert all(int(n * (1 - target_ratio(n, t))) == min(n, t) for n in range(1, 300, 7) for t in range(1, 320, 3))


def test_registries():
    r = Registry("thing")
    r.register("A", ["b"])(1)
    assert r.get("a") == r.get("B") == 1 and r.names() == ["a"]
    with pytest.raises(KeyError, match="known are a"):
        r.get("c")
    with pytest.raises(ValueError):
        r.register("b")(2)
    assert len(benchmarks.names()) == 19 and benchmarks.get("LOFT_RAG") is benchmarks.get("loft")
    assert "knorm" in compressors.names() and methods.positional_methods.get("pi")(10000.0, 8, 2.0)[1] == 2.0


def test_run_writes_its_artefacts(spark, tmp_path):
    tables.values(spark).write.parquet(str(tmp_path / "rows"))
    config = RunConfig(benchmark="mock_benchmark", output_dir=str(tmp_path / "out"))
    answer = lambda df: df.withColumn("prediction", F.lit("Paris"))
    out = evaluation.run(spark, config, str(tmp_path / "rows"), answer)
    assert out["metrics"]["overall"]["score"] == 50.0
    assert json.loads((tmp_path / "out" / config.tag() / "metrics.json").read_text())["total_samples"]["count"] == 2
    back = spark.read.option("header", "true").csv(f"{out['folder']}/predictions.csv")
    assert "context" not in back.columns and back.count() == 2


@pytest.mark.parametrize("name", [n for n in benchmarks.names() if n != "mock_benchmark"])
def test_every_benchmark_scores(spark, name):
    rows = spark.createDataFrame([(0, "c", "q", "qa_1", ["12", "b"], "12", 5000, 16), (1, "c", "q", "hotpotqa_e", [], None, 100, 16)], "ord int, context string, question string, task string, answer array<string>, prediction string, length int, context_length int")
    bench = benchmarks.get(name)
    metrics = sinks.metrics_document(bench.rollup(bench.score(rows)))
    assert metrics["total_samples"]["count"] == 2
    assert 0 <= metrics["overall"]["score"] <= 100
    assert sinks.metrics_document(bench.rollup(bench.score(rows.limit(0))))["total_samples"]["count"] == 0


def test_files(spark, tmp_path):
    (tmp_path / "m" / "a").mkdir(parents=True)
    (tmp_path / "m" / "a" / "metrics.json").write_text(json.dumps({"task_scores": {"qa": 5.0}}))
    (tmp_path / "m" / "b").mkdir()
    (tmp_path / "m" / "b" / "metrics.json").write_text("{broken")
    found = tables.metrics_files(spark, str(tmp_path / "m" / "*"))
    assert [(r.task, r.score) for r in found.collect()] == [("qa", 5.0)]
    assert tables.newest_files(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "p.tsv").write_text("0.5\t2\n-1\t1\n")
    assert sorted(tuple(r) for r in tables.pattern_matrix(spark, str(tmp_path / "p.tsv")).collect()) == [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 1.0)]
    (tmp_path / "x.jsonl").write_text('{"input": "a", "outputs": ["b"]}\n')
    got = P.rename_legacy(tables.lines_or_table(spark, str(tmp_path / "x.jsonl"), "input string, outputs array<string>"), {"input": "context", "outputs": "answer"})
    assert got.columns == ["context", "answer", "context_length"]
    with pytest.raises(FileNotFoundError):
        tables.json_lines(spark, str(tmp_path / "none.jsonl"), "a string")


def test_composition_rules(kv):
    from evalloom.plans import compose

    with pytest.raises(ValueError, match="takes no compressor"):
        compose.pipeline("dca", lambda x: x, "knorm")
    half = lambda x: R.retain(R.knorm(x), 0.5)
    q = relations.last_queries(kv, 2)
    assert ids(compose.pipeline(None, half)(q, kv)) == ids(half(kv))
    assert compose.pipeline(None, half, phase="decode")(q, kv).count() == kv.count()
    both = compose.pipeline("reattention", half)(q, kv, sinks=2, recent=2, k=1, span=1)
    assert 0 < both.count() < kv.count()
    assert compose.active("both", True) and not compose.active("prefill", True)
    assert compose.positions("yarn", 10000.0, 64, 4.0)[2] > 1


def test_schedule_of_a_chunked_prompt(spark, tmp_path):
    rows = spark.range(60).selectExpr("0 AS layer", "0 AS head", "id AS pos", "cast(id % 7 as double) AS score", "cast(case when id < 40 then 0 when id < 60 then 1 end as int) AS final")
    for k in range(3):
        rows.where(f"pos >= {20 * k} and pos < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for schedule, want in (({"streaming"}, 3), ({"post_prefill"}, 1), (set(), 0)):
        calls, kept = [], []

        def compress(batch, calls=calls):
            calls.append(batch.count())
            return batch.where("score > 3")

        step = S.scheduled(schedule, compress, lambda df, epoch, kept=kept: kept.append((epoch, df.count())))
        stream = S.chunks(spark, str(tmp_path / "in"), "layer int, head int, pos long, score double, final int")
        stream.writeStream.foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
        assert len(kept) == 3 and len(calls) == want
    with pytest.raises(ValueError, match="unknown"):
        S.scheduled({"other"}, None, None)


def test_rounding_is_that_of_plain_conversions(spark):
    values = [66.665, 12.345, 0.125, 0.375, 2.675, 1.005, 99.995, 0.0, 100.0, -1.005, -0.125, 1e13 / 3, *(k / 32 * 100 for k in range(33)), *(k / 7 * 100 for k in range(8)), *(k / 200 for k in range(1, 400, 2))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    found = {r.k: r.r for r in df.select("k", rollup.rounded(F.col("v")).alias("r")).collect()}
    assert [found[k] for k, v in enumerate(values) if abs(v) < 1e12] == [round(v, 2) for v in values if abs(v) < 1e12]


class Recorder:
    """An answerer that writes down what is asked of it."""

    def __init__(self, path):
        self.path = path

    def note(self, line):
        with open(f"{self.path}/{os.getpid()}", "a") as f:
            f.write(line + "\n")

    def setup(self, context):
        self.context = context
        self.note(f"setup {context}")

    def predict(self, row):
        if row["question"] == "fail":
            raise RuntimeError("no answer")
        return f"{self.context}/{row['question']}"

    def teardown(self):
        self.note(f"teardown {self.context}")


def test_a_context_is_set_up_once_for_its_rows(spark, tmp_path):
    from evalloom.plans import contexts

    path = str(tmp_path)
    rows = spark.createDataFrame([(k, None if k % 10 == 9 else f"c{k % 4}", f"q{k}", "old") for k in range(40)], "ord int, context string, question string, prediction string")
    found = {r.ord: r.prediction for r in contexts.answer_by_context(rows, lambda: Recorder(path)).collect()}
    assert found == {k: None if k % 10 == 9 else f"c{k % 4}/q{k}" for k in range(40)}
    notes = "".join(p.read_text() for p in tmp_path.iterdir()).split("\n")
    assert sorted(x for x in notes if x) == sorted(f"{w} c{k}" for k in range(4) for w in ("setup", "teardown"))
    # A large group is dealt into parts, each with its own set-up, and loses no row.
    parts = contexts.answer_by_context(rows.withColumn("context", F.lit("one")), contexts.Counted, most=8)
    assert {r.ord: r.prediction for r in parts.collect()} == {k: f"1:q{k}" for k in range(40)}
    assert contexts.answer_by_context(rows.limit(0), contexts.Counted).count() == 0


def test_a_failing_answerer_is_torn_down(spark, tmp_path):
    from evalloom.plans import contexts

    path = str(tmp_path)
    rows = spark.createDataFrame([(0, "c", "fail")], "ord int, context string, question string")
    with pytest.raises(Exception, match="no answer"):
        contexts.answer_by_context(rows, lambda: Recorder(path)).collect()
    notes = [line for p in tmp_path.iterdir() for line in p.read_text().split("\n") if line]
    assert notes.count("setup c") == notes.count("teardown c") > 0


def test_one_pass_retrieval_refines_with_what_does_not_fit():
    from evalloom.plans.contexts import OnePass, sentence_chunks

    prompts = []
    one = OnePass(generate=lambda p: prompts.append(p) or f"a{len(prompts)}", size=6, overlap=2, top=3, room=40)
    one.setup("Alpha beta gamma. Delta epsilon zeta eta. Theta iota. Kappa lambda mu nu xi. Omicron pi.")
    assert one.predict({"question": "kappa lambda"}) == f"a{len(prompts)}"
    assert "Kappa lambda" not in prompts[0] and "Kappa lambda" in prompts[-1] and "Existing answer: a1" in prompts[1]
    prompts.clear()
    one.room = 1000
    one.predict({"question": "kappa lambda"})
    passages = prompts[0].split("---------------------\n")[1].strip().split("\n\n")
    assert len(prompts) == 1 and len(passages) == 3 and "Kappa lambda" in passages[-1]
    one.teardown()
    one.setup("")
    assert one.predict({"question": "x"}).startswith("a")
    chunks = sentence_chunks("A b c. D e. F g h i j k l m. N.", 5, 2)
    assert chunks == ["A b c. D e.", "F g h i j", "k l m. N."]


def test_configuration_of_a_cell():
    from evalloom.config import cell_config

    base = RunConfig(model="m", temperature=0.7, max_new_tokens=9, llm_kwargs={"dtype": "x", "research_config": {"prefill_chunk_size": 5}})
    cell = cell_config(base, {"cell_id": "Compactor__r0.6", "method": "compactor", "ratio": 0.6}, ["a", "b"], "/out")
    assert (cell.benchmark, cell.backend, cell.subsets, cell.max_new_tokens, cell.temperature, cell.output_dir) == ("longbench", "research", "a,b", None, 0.0, "/out/Compactor__r0.6")
    assert cell.llm_kwargs == {"dtype": "x", "research_config": {"attention_method": "none", "kv_compressor": "compactor", "compression_ratio": 0.6, "kv_compressor_kwargs": {"seed": 42}}}
    assert cell_config(base, {"cell_id": "Full", "method": None, "ratio": None}, [], "/out").llm_kwargs["research_config"] == {"attention_method": "none", "kv_compressor": "none", "compression_ratio": 0.0}


def test_eviction_after_each_chunk(spark, tmp_path):
    rows = spark.range(60).selectExpr("0 AS layer", "cast(id % 2 as int) AS head", "id div 2 AS pos", "cast(id * 37 % 101 as double) AS score", "id div 20 AS chunk")
    for k in range(3):
        rows.where(f"chunk = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.chunks(spark, str(tmp_path / "in"), f"{S.ROW}, chunk long", 100)
    found = {(r["head"], r.chunk, r.pos) for r in S.run_to_end(S.chunk_eviction(stream, 0.4), "evicted_chunks").collect()}
    want = set()
    for head in range(2):
        kept = []
        for chunk in range(3):
            kept += [(p, float((2 * p + head) * 37 % 101)) for p in range(10 * chunk, 10 * chunk + 10)]
            kept = sorted(kept, key=lambda x: (-x[1], x[0]))[: int(len(kept) * 0.6)]
            want |= {(head, chunk, p) for p, _ in kept}
    assert found == want


def test_decoding_compressors(kv):
    half = compressors.get("decoding")(R.knorm, 20)
    out = half(kv)
    assert out.groupBy("layer", "head").count().agg(F.min("count"), F.max("count")).first()[:] == (20, 20)
    both = compressors.get("prefill_decoding")(None, half)
    assert both(kv).count() == kv.count() and both(kv, True).count() == out.count()


def test_a_sample_is_exact_where_ids_repeat(spark):
    df = spark.range(100).selectExpr("id % 7 AS ord", "id AS x")
    for fraction in (0.13, 0.5, 0.77):
        assert P.sample_fraction(df, fraction, 3).count() == round(fraction * 100)


def test_a_sweep_resumes(spark, tmp_path):
    tables.values(spark).withColumn("answers", F.col("answer")).write.parquet(str(tmp_path / "rows"))
    calls = []
    answer = lambda df: calls.append(1) or df.withColumn("prediction", F.lit("Paris"))
    cells = [{"cell_id": f"Knorm__r{r}", "method": "knorm", "ratio": r} for r in (0.6, 0.9)]
    first = evaluation.sweep(spark, RunConfig(), cells[:1], str(tmp_path / "rows"), str(tmp_path / "out"), answer)
    again = evaluation.sweep(spark, RunConfig(), cells, str(tmp_path / "rows"), str(tmp_path / "out"), answer)
    assert [r.resumed for r in first.collect()] == [False] and {r.cell_id: r.resumed for r in again.collect()} == {"Knorm__r0.6": True, "Knorm__r0.9": False}
    assert len(calls) == 2
    document = json.loads((tmp_path / "out/manifest/manifest.json").read_text())
    assert [(c["cell_id"], c["ratio"], c["label"]) for c in document["cells"]] == [("Knorm__r0.6", 0.6, "Knorm"), ("Knorm__r0.9", 0.9, "Knorm")]
    assert sorted(p.name for p in (tmp_path / "out/manifest").iterdir() if not p.name.endswith(".crc")) == ["cells", "manifest.json"]
    # A cell whose file is torn is run again, and its row replaced.
    Path(document["cells"][0]["metrics"]).write_text("{ torn")
    third = evaluation.sweep(spark, RunConfig(), cells, str(tmp_path / "rows"), str(tmp_path / "out"), answer)
    assert {r.cell_id: r.resumed for r in third.collect()} == {"Knorm__r0.6": False, "Knorm__r0.9": True}
    assert len(json.loads((tmp_path / "out/manifest/manifest.json").read_text())["cells"]) == 2 and len(calls) == 3


@pytest.mark.parametrize("band", [10**6, 3])
def test_lowest_with_ties(spark, band, monkeypatch):
    monkeypatch.setattr(R, "BAND", band)
    for scores in ([1.0] * 40, [float(k % 2) for k in range(40)], [float(k % 3) for k in range(40)], [float(k * 7 % 40) for k in range(40)]):
        df = spark.createDataFrame([(0, k % 4, k // 4, s) for k, s in enumerate(scores)], "layer int, head int, pos int, score double")
        for ratio in (0.1, 0.45, 0.4999, 0.8):
            want = sorted((s, 0, k % 4, k // 4) for k, s in enumerate(scores))[: int(40 * ratio)]
            assert sorted((r.score, r.layer, r["head"], r.pos) for r in R.lowest(df, ratio).collect()) == want


def test_tied_scores_are_never_ranked_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(R, "BAND", 50)
    df = spark.range(4000).selectExpr("0 AS layer", "CAST(id % 8 AS INT) AS head", "CAST(id div 8 AS INT) AS pos", "CAST(id % 2 AS DOUBLE) AS score")
    out = R.lowest(df, 0.4999)
    assert out.count() == 1999 and out.agg(F.max("score")).first()[0] == 0.0
    # Only windows within a head are left in the plan.
    assert "windowspecdefinition(_s" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_streams_by_element_agree_with_plain_versions(spark, tmp_path):
    rows = spark.range(300).selectExpr("cast(if(id % 7 = 0, null, id % 2) as int) AS layer", "concat('h', id % 3) AS head", "id AS pos", "if(id % 11 = 0, null, cast(id * 37 % 23 as double)) AS score")
    S.sliced(rows, str(tmp_path / "in"), "pos", 5)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/slice=*"))
    heads = {}
    for r in rows.orderBy("pos").collect():
        heads.setdefault((r.layer, r["head"]), []).append((r.pos, float("-inf") if r.score is None else r.score))
    best = lambda cells, n: sorted(sorted(cells, key=lambda x: (-x[1], x[0]))[:n])
    numbered, phases, late = set(), set(), set()
    for key, cells in heads.items():
        numbered |= {(*key, k, p) for k, (p, _) in enumerate(cells)}
        late |= {(*key, p) for p, v in cells[:-12] if 0 <= v < 9}
        prompt, rest = [c for c in cells if c[0] < 90], [c for c in cells if c[0] >= 90]
        kept, step = best(prompt, int(len(prompt) * 0.5)), 0
        phases |= {(*key, 0, p) for p, _ in kept}
        for k in range(0, len(rest) // 8 * 8, 8):
            kept, step = best(kept + rest[k : k + 8], 6), step + 1
            phases |= {(*key, step, p) for p, _ in kept}
    assert {tuple(r) for r in S.run_to_table(S.ingested(stream()), "a").collect()} == numbered
    assert {tuple(r) for r in S.run_to_table(S.phased_cache(stream(), 90, 0.5, 6, 8), "b").collect()} == phases
    assert {tuple(r)[:3] for r in S.run_to_table(S.delayed_eviction(stream(), 12, 9.0), "c").collect()} == late
    assert spark.conf.get(S.STORE[0]) != S.STORE[1]
    S.sliced(rows.limit(0), str(tmp_path / "none"), "pos", 3)
    assert not (tmp_path / "none").exists()


def test_micro_batches_and_state_calls_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = S.sliced(spark.range(400).withColumnRenamed("id", "pos"), str(tmp_path / "many"), "pos", 4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    written = len(list((tmp_path / "many").glob("slice=*/*.parquet")))
    assert written > 4 and -(-written // files) <= 4
    monkeypatch.setattr(S, "PER_BATCH", 50)
    assert -(-8 // S.sliced(spark.range(400).withColumnRenamed("id", "pos").coalesce(1), str(tmp_path / "more"), "pos", 8)) == 8

    class Cells(dict):
        calls = 0

        def iterator(self):
            return iter(())

        def updateValue(self, key, value):  # noqa: N802 - a name of Spark's interface
            self.calls, self[key] = self.calls + 1, value

    one = S._Bounded(10, 16)
    one.cells = Cells()
    out = one.take([0, 0, 0], pd.DataFrame({"pos": range(1600), "score": [float(k * 37 % 1009) for k in range(1600)]}))
    assert len(out) == 1000 and one.cells.calls == 10
