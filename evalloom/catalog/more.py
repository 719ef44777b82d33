"""Chunked attention, retrieval, reports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import scratch
from ..functions import text as T

from ..operators import chunked_attention as K
from ..operators import relations
from ..operators import report as P
from ..operators import retrieval as G
from ..operators import vector_index
from ..sources import manifest

from ..operators import vectors as V
from .base import KEYS, dot, keys, query, read
from .retention import D, _all, _rot

C = F.col


def _total(c):
    return F.round(V.total(F.transform(c, lambda x, i: x * (i + 1))), 6)


# Chunk size 12, local window 4: chunks of 8 positions.
def _dual(queries: str, back: str) -> str:
    return f"""WITH {KEYS}, k AS (SELECT *, {_rot('key', '(pos % 8)')} AS rk FROM kv),
q AS (SELECT layer, head, pos AS qpos, {_rot('key', '(pos % 8)')} AS q0, {_rot('key', 'least(pos % 8 + 8, 12)')} AS q1, {_rot('key', '12')} AS q2 FROM kv {queries}),
l AS (SELECT q.layer, q.head, q.qpos, k.value, list_dot_product(CASE {back} - k.pos // 8 WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END, rk) / 8 AS l FROM q JOIN k ON q.layer = k.layer AND q.head = k.head AND k.pos <= q.qpos),
e AS (SELECT *, max(l) OVER (PARTITION BY layer, head, qpos) AS m FROM l)
SELECT layer, head, qpos, round(ln(sum(exp(l - m))) + max(m), 6) AS lse, round(sum(exp(l - m) * list_sum(list_transform(value, lambda x, i: x * i))) / sum(exp(l - m)), 6) AS out FROM e GROUP BY layer, head, qpos"""


def _attended(out):
    return out.select("layer", "head", "qpos", F.round("lse", 6).alias("lse"), _total("out").alias("out"))


@query("attention_dual_chunk", _dual("", "q.qpos // 8"))
def _(s, d):
    kv, q = _all(s, d)
    return _attended(K.dual_chunk(q, kv, D, 12, 4))


# Decoding steps: the last position of each head, and its last twelve as one block, which crosses chunks.


@query("attention_dual_chunk_step", _dual("WHERE pos = k_len - 1", "q.qpos // 8"))
def _(s, d):
    kv = keys(s, d)
    return _attended(K.dual_chunk_decode(relations.last_queries(kv, 1), kv, D, 12, 4))


@query("attention_dual_chunk_block", _dual("WHERE pos >= k_len - 12", "(k.k_len - 1) // 8"))
def _(s, d):
    kv = keys(s, d)
    return _attended(K.dual_chunk_decode(relations.last_queries(kv, 12), kv, D, 12, 4))


def _recall(kind: str, clip: str = "") -> str:
    weight = {"qk": "1", "qkv": "list_sum(list_transform(k.value, lambda x: abs(x)))", "qkv2": "sqrt(list_dot_product(k.value, k.value))"}[kind]
    return f"""WITH {KEYS}, q AS (SELECT layer, head, pos AS qpos, key AS query FROM kv WHERE pos >= k_len - 4),
p AS (SELECT k.layer, k.head, q.qpos, k.pos, {dot('q.query', 'k.key')} * {weight} AS l FROM q JOIN kv k ON q.layer = k.layer AND q.head = k.head WHERE k.pos >= 4 AND k.pos < k.k_len - 8),
t AS (SELECT layer, pos FROM (SELECT *, row_number() OVER (PARTITION BY layer, head, qpos ORDER BY round(l, 9) DESC, pos) AS r FROM p) WHERE r <= 2),
c AS (SELECT layer, pos, count(*) AS times FROM t GROUP BY ALL), u AS (SELECT layer, pos FROM c {clip}),
x AS (SELECT DISTINCT layer, least(greatest(pos + o, 4), (SELECT max(k_len) FROM kv) - 9) AS pos FROM u, (SELECT unnest(range(-1, 2)) AS o))
SELECT layer, pos FROM x UNION SELECT DISTINCT layer, pos FROM kv WHERE pos < 4 OR pos >= k_len - 8"""


def _last(s, d):
    kv = keys(s, d)
    return kv, relations.last_queries(kv, 4)


@query("recall_positions", _recall("qk"))
def _(s, d):
    kv, q = _last(s, d)
    return K.recalled_positions(kv, q, 4, 8, 2, 3)


@query("recall_positions_clipped", _recall("qkv", "QUALIFY row_number() OVER (PARTITION BY layer ORDER BY times DESC, pos) <= 5"))
def _(s, d):
    kv, q = _last(s, d)
    return K.recalled_positions(kv, q, 4, 8, 2, 3, clip=5, kind="qkv")


@query("recall_positions_by_length", _recall("qkv2"))
def _(s, d):
    kv, q = _last(s, d)
    return K.recalled_positions(kv, q, 4, 8, 2, 3, kind="qkv2")


@query("recall_compacted", f"WITH {KEYS}, r AS (SELECT layer, head, pos, key, row_number() OVER (PARTITION BY layer, head ORDER BY pos) - 1 + 100 - count(*) OVER (PARTITION BY layer, head) AS new_pos FROM kv WHERE pos % 3 = 0) SELECT layer, head, pos, new_pos, round(list_sum(list_transform({_rot('key', '(new_pos - pos)')}, lambda x, i: x * i)), 6) AS total FROM r")
def _(s, d):
    out = K.compacted(keys(s, d).where("pos % 3 = 0"), 100, 10000.0, D)
    return out.select("layer", "head", "pos", "new_pos", _total("key").alias("total"))


@query("recall_padded", f"WITH {KEYS}, h AS (SELECT DISTINCT layer, pos FROM kv) SELECT layer, pos FROM h WHERE pos % 5 = 0 UNION ALL SELECT layer, pos FROM (SELECT layer, pos, row_number() OVER (PARTITION BY layer ORDER BY pos DESC) AS r FROM h WHERE pos % 5 <> 0) WHERE r <= 20 - (SELECT count(*) FROM h WHERE pos % 5 = 0)")
def _(s, d):
    kv = keys(s, d)
    return K.padded(kv.where("pos % 5 = 0").select("layer", "pos").distinct(), kv, 20)


@query("recall_view_positions", f"WITH {KEYS} SELECT layer, head, pos, row_number() OVER (PARTITION BY layer, head ORDER BY pos) - 1 AS view_pos, count(*) OVER (PARTITION BY layer, head) - 4 AS query_start FROM kv WHERE pos % 2 = 0")
def _(s, d):
    return K.view_positions(keys(s, d).where("pos % 2 = 0"), 4).select("layer", "head", "pos", "view_pos", "query_start")


# Retrieval

_CHUNKS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, i AS chunk_id, array_to_string(w[i * 48 + 1 : i * 48 + 64], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 64) / 48.0), 0)::INT + 1)) AS i FROM w WHERE len(w) > 0))"""


@query("retrieval_chunks", f"WITH {_CHUNKS} SELECT doc_id, chunk_id::INT AS chunk_id, md5(text) AS text FROM c")
def _(s, d):
    return G.chunks(read(s, d, "documents"), 64, 16).select("doc_id", "chunk_id", F.md5("text").alias("text"))


def _questions(s, d):
    e = read(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id % 20 = 0").select("label", C("vec_id").alias("question"), C("v").alias("q_vector"))
    return q, e.select("label", C("vec_id").alias("chunk_id"), C("v").alias("p_vector"))


_NEAR = f"""e AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
h AS (SELECT label, question, chunk_id, similarity, row_number() OVER (PARTITION BY label, question ORDER BY round(similarity, 9) DESC, chunk_id) AS rank FROM (SELECT q.label, q.vec_id AS question, p.vec_id AS chunk_id, {dot('q.v', 'p.v')} AS similarity FROM e q JOIN e p ON q.label = p.label WHERE q.vec_id % 20 = 0))"""


@query("retrieval_nearest", f"WITH {_NEAR} SELECT label, question, chunk_id, round(similarity, 6) AS similarity, rank FROM h WHERE rank <= 12")
def _(s, d):
    q, p = _questions(s, d)
    return G.nearest(q, p, ["label"], "question").withColumn("similarity", F.round("similarity", 6))


# A stored index: every vector is indexed, every twentieth one asks.

RECALL = 0.96


def _index(s, d):
    e = read(s, d, "embeddings")
    return vector_index.build(e, scratch(s, "index"), "vec_id", "embedding"), e, e.where("vec_id % 20 = 0")


@query("vector_index_exact", f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), h AS (SELECT q.vec_id AS question, p.vec_id AS id, {dot('q.v', 'p.v')} AS similarity FROM e q, e p WHERE q.vec_id % 20 = 0) SELECT question, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY question ORDER BY round(similarity, 9) DESC, id) AS rank FROM h QUALIFY rank <= 12")
def _(s, d):
    index, _, q = _index(s, d)
    return vector_index.search_exactly(index, q, "vec_id", "embedding", 12, 4).withColumn("similarity", F.round("similarity", 6))


@query("vector_index_recall", "SELECT count(*) FILTER (vec_id % 20 = 0) AS questions, count(*) AS indexed, true AS recalled, true AS fewer_rows FROM embeddings")
def _(s, d):
    """Whether a probing search finds nine of ten rows that a full scan finds, reading fewer rows."""
    index, e, q = _index(s, d)
    probes = vector_index.calibrated(index, e, "vec_id", "embedding", 12, RECALL)
    asked = q.select("vec_id", "embedding", F.lit(0).alias("all"))
    whole = vector_index.nearest(asked, e.withColumn("all", F.lit(0)), ["all"], 12, ("vec_id", "vec_id"), ("embedding", "embedding"))
    hits = whole.select("question", "id").join(vector_index.search(index, q, "vec_id", "embedding", 12, probes).select("question", "id", F.lit(1).alias("hit")), ["question", "id"], "left")
    share = hits.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"), F.countDistinct("question").alias("questions"))
    read_rows = vector_index.rows_read(index, q, "vec_id", "embedding", probes).agg(F.avg("rows").alias("rows"))
    n = int(index.sizes.sum())
    return share.crossJoin(read_rows).select("questions", F.lit(n).cast("long").alias("indexed"), (C("recall") >= 0.9).alias("recalled"), (C("rows") < n).alias("fewer_rows"))


@query("retrieval_prompt", f"""WITH {_NEAR}, p AS (SELECT label, question, string_agg('passage ' || chunk_id, chr(10) || chr(10) ORDER BY rank DESC) AS context FROM h WHERE rank <= 3 GROUP BY ALL)
SELECT label, question, md5('Context information is below.' || chr(10) || '---------------------' || chr(10) || context || chr(10) || '---------------------' || chr(10) || 'Using only the context above, answer the question concisely. If the answer is not in the context, output only the word: unanswerable' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS prompt FROM p""")
def _(s, d):
    q, p = _questions(s, d)
    hits = G.nearest(q, p, ["label"], "question", 3).withColumn("text", F.concat(F.lit("passage "), C("chunk_id").cast("string")))
    packed = G.packed(hits, ["label", "question"])
    return packed.select("label", "question", F.md5(G.prompt(C("context"), C("question").cast("string"))).alias("prompt"))


@query("retrieval_hashed_embedding")
def _(s, d):
    docs = read(s, d, "benchmark")
    return docs.select("item_id", F.round(V.l2(G.hashed_embedding(T.words(C("text")), 32)), 6).alias("length"))


# Reports

# The methods of the sweep are the sources of documents; the documents of a source are dealt to ratios and tasks by their ids.
_GRID = """m AS (SELECT source AS label, min(lang) AS method FROM documents WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT m.label || '__r' || r.ratio::VARCHAR AS cell_id, m.label, m.method, r.ratio FROM m, (VALUES (0.6::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) r(ratio) UNION ALL SELECT 'Full', 'Full', NULL, NULL)"""
_SCORES = "sc AS (SELECT [0.6::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE][(doc_id // 3 % 3)::INT + 1] AS ratio, source AS label, ['qa', 'sum', 'code'][(doc_id % 3)::INT + 1] AS task, avg(n_chars)::DOUBLE AS score FROM documents WHERE source IS NOT NULL GROUP BY ALL)"


def _cells(s, d):
    sources = read(s, d, "documents").where("source is not null").groupBy(C("source").alias("label")).agg(F.min("lang").alias("method"))
    return P.cells(sources)


def _scores(s, d):
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    ratio, task = of(P.RATIOS, F.floor(C("doc_id") / 3) % 3), of(("qa", "sum", "code"), C("doc_id") % 3)
    docs = read(s, d, "documents").where("source is not null")
    return docs.groupBy(ratio.alias("ratio"), C("source").alias("label"), task.alias("task")).agg(F.avg("n_chars").alias("score"))


@query("report_grid", f"WITH {_GRID} SELECT cell_id, label, method, ratio, split_part(cell_id, '__r', 1) AS row_label FROM g")
def _(s, d):
    return P.row_label(_cells(s, d))


@query("report_pivot", f"WITH {_GRID}, {_SCORES}, w AS (SELECT ratio, label, max(score) FILTER (WHERE task = 'qa') AS qa, max(score) FILTER (WHERE task = 'sum') AS sum, max(score) FILTER (WHERE task = 'code') AS code, avg(score) AS \"Avg\" FROM sc GROUP BY ratio, label) SELECT ratio, label, qa, sum, code, round(\"Avg\", 6) AS \"Avg\" FROM w")
def _(s, d):
    return P.pivoted(_scores(s, d), ["qa", "sum", "code"]).withColumn("Avg", F.round("Avg", 6))


@query("report_missing", f"WITH {_GRID}, {_SCORES} SELECT cell_id, label, method, ratio FROM g WHERE cell_id NOT IN (SELECT label || '__r' || ratio::VARCHAR FROM sc WHERE task = 'qa' AND score > 2000)")
def _(s, d):
    done = _scores(s, d).where("task = 'qa' and score > 2000")
    return P.missing(_cells(s, d), done.select(P.cell_id().alias("cell_id")))


@query("report_compared", f"WITH {_GRID}, {_SCORES} SELECT a.label, a.task, a.score, b.score AS published, round(a.score - b.score, 6) AS delta, CASE WHEN abs(a.score - b.score) > 1.0 THEN '!!' ELSE '' END AS mark FROM sc a LEFT JOIN sc b ON a.label = b.label AND a.task = b.task AND b.ratio = 0.9 WHERE a.ratio = 0.6")
def _(s, d):
    sc = _scores(s, d)
    out = P.compared(sc.where("ratio = 0.6D").drop("ratio"), sc.where("ratio = 0.9D").drop("ratio"), ["label", "task"], 1.0)
    return out.withColumn("delta", F.round("delta", 6))


# A sweep whose cells are the languages: their metrics files hold a score for each source, and two cells have none to read.

_MANIFEST = """SELECT lang AS cell_id, lang AS label, 0.5::DOUBLE AS ratio, 'read' AS state, source AS task, avg(n_chars)::DOUBLE AS score FROM documents GROUP BY lang, source
UNION ALL SELECT 'gone', 'gone', 0.5::DOUBLE, 'missing', NULL, NULL UNION ALL SELECT 'torn', 'torn', 0.5::DOUBLE, 'unreadable', NULL, NULL"""


@query("sweep_manifest", f"SELECT cell_id, label, ratio, state, task, round(score, 6) AS score FROM ({_MANIFEST})")
def _(s, d):
    root = scratch(s, "sweep")
    groups = read(s, d, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("score"))
    scores = groups.groupBy(C("lang").alias("cell_id")).agg(F.map_from_entries(F.collect_list(F.struct("source", "score"))).alias("task_scores"))
    scores.repartition("cell_id").write.partitionBy("cell_id").json(f"{root}/out")
    s.createDataFrame([("{ torn", "torn")], "value string, cell_id string").write.mode("append").partitionBy("cell_id").text(f"{root}/out")
    names = scores.select("cell_id").union(s.createDataFrame([("gone",), ("torn",)], "cell_id string"))
    cells = names.select("cell_id", C("cell_id").alias("label"), F.lit(0.1).alias("ratio"), F.concat(F.lit(f"{root}/out/cell_id="), "cell_id", F.lit("/metrics.json")).alias("metrics"))
    for part in (cells, cells.withColumn("ratio", F.lit(0.5))):  # recorded again, each cell takes its own place
        manifest.record(part, root)
    return manifest.results(manifest.recorded(s, root), f"{root}/out", "part-*").withColumn("score", F.round("score", 6))


# Sets and table scans


@query("sets_intersect_all", "SELECT lang, source FROM documents WHERE doc_id % 2 = 0 INTERSECT ALL SELECT lang, source FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    docs = read(s, d, "documents").select("doc_id", "lang", "source")
    return docs.where("doc_id % 2 = 0").drop("doc_id").intersectAll(docs.where("doc_id % 3 = 0").drop("doc_id"))


@query("sets_complement", f"WITH {KEYS} SELECT layer, head, pos FROM kv WHERE pos % 4 <> 0")
def _(s, d):
    kv = keys(s, d).select("layer", "head", "pos")
    return kv.join(kv.where("pos % 4 = 0"), ["layer", "head", "pos"], "left_anti")


@query("sets_top_overlap", f"WITH {KEYS}, r AS (SELECT layer, head, row_number() OVER (PARTITION BY layer, head ORDER BY round(list_sum(key), 9) DESC, pos) <= 10 AS a, row_number() OVER (PARTITION BY layer, head ORDER BY round(list_sum(value), 9) DESC, pos) <= 10 AS b FROM kv) SELECT layer, head, sum((a AND b)::INT)::DOUBLE / 10 AS share FROM r GROUP BY ALL")
def _(s, d):
    from pyspark.sql.window import Window as W

    top = lambda c: F.row_number().over(W.partitionBy("layer", "head").orderBy(F.round(V.total(C(c)), 9).desc(), "pos")) <= 10
    flags = keys(s, d).select("layer", "head", top("key").alias("a"), top("value").alias("b"))
    return flags.groupBy("layer", "head").agg((F.sum((C("a") & C("b")).cast("int")).cast("double") / 10).alias("share"))


@query("scan_filtered", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND contains(source, '1') AND n_chars > 500")
def _(s, d):
    return read(s, d, "documents").where(C("lang").isin("de", "fr") & C("source").contains("1") & (C("n_chars") > 500)).select("doc_id", "lang", "n_chars")


@query("rollup_orders", "SELECT n_name, o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(s, d):
    o, c, n = (read(s, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count("*").alias("n"))


@query("window_cumulative_counts", "SELECT event_type, user_id, event_id, sum((value > 0)::INT) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS positive FROM events")
def _(s, d):
    from pyspark.sql.window import Window as W

    order = W.partitionBy("event_type", "user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return read(s, d, "events").select("event_type", "user_id", "event_id", F.sum((C("value") > 0).cast("int")).over(order).alias("positive"))


