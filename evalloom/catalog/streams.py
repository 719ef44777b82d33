"""Stream operators over the events table: as bounded streams that run to their end, and in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..checkpoints import scratch
from ..streaming import retention as S
from .base import query, read

C = F.col
_ROWS = "r AS (SELECT user_id % 5 AS layer, event_type AS head, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id) - 1 AS pos, value AS score FROM events)"


def rows(s, d):
    e = read(s, d, "events").select((C("user_id") % 5).alias("layer"), C("event_type").alias("head"), "event_id", C("value").alias("score"))
    return e.select("layer", "head", (F.row_number().over(W.partitionBy("layer", "head").orderBy("event_id")) - 1).alias("pos"), "score")


@query("stream_delayed_eviction", f"WITH {_ROWS} SELECT layer, head, pos, score FROM (SELECT *, count(*) OVER (PARTITION BY layer, head) AS n FROM r) WHERE pos < n - 20 AND score < 40")
def _(s, d):
    return S.delayed_eviction_batch(rows(s, d), 20, 40.0)


@query("stream_restored", f"WITH {_ROWS} SELECT layer, head, pos, score FROM r WHERE pos < layer * 10 + 5")
def _(s, d):
    r = rows(s, d)
    return S.restored(r, r.select("layer").distinct().withColumn("length", C("layer") * 10 + 5))


@query("stream_tumbling_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    """An extension: plain event-time windows."""
    e = read(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", C("w.start").alias("start"), "n", "total")


# Bounded streams of the events, in four slices, as many micro-batches or more of bounded size. Positions are those that the stream counts itself.

SLICES = 4


def _stream(s, d):
    e = read(s, d, "events").select((C("user_id") % 5).cast("int").alias("layer"), C("event_type").alias("head"), C("event_id").alias("pos"), C("value").alias("score"))
    path = scratch(s, "events")
    files = S.sliced(e, path, "pos", SLICES)
    return S.chunks(s, f"{path}/slice=*", e.schema, files)


_EVENTS = "r AS (SELECT user_id % 5 AS layer, event_type AS head, event_id, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id) - 1 AS pos, value AS score, count(*) OVER (PARTITION BY user_id % 5, event_type) AS n FROM events)"


@query("stream_ingest", f"WITH {_EVENTS} SELECT layer, head, pos, event_id AS row FROM r")
def _(s, d):
    return S.run_to_table(S.ingested(_stream(s, d)), "ingest")


@query("stream_evicted", f"WITH {_EVENTS} SELECT layer, head, event_id AS pos, score FROM r WHERE pos < n - 20 AND score < 40")
def _(s, d):
    return S.run_to_table(S.delayed_eviction(_stream(s, d), 20, 40.0), "evicted")


@query("stream_cache", f"WITH {_EVENTS}, t AS (SELECT unnest(range(1, n // 16 + 1)) AS step, layer, head FROM (SELECT DISTINCT layer, head, n FROM r)) SELECT layer, head, step, event_id AS pos FROM r JOIN t USING (layer, head) WHERE r.pos < 16 * step QUALIFY row_number() OVER (PARTITION BY layer, head, step ORDER BY score DESC, event_id) <= 10")
def _(s, d):
    """What stays of a cache is the best of all that has come, since a row that goes has enough better ones."""
    return S.run_to_table(S.bounded_cache(_stream(s, d), 10, 16), "cache")


# The prompt is the first third of the events.
_PHASES = f"""WITH {_EVENTS}, p AS (SELECT *, event_id < (SELECT max(event_id) // 3 FROM events) AS prompt FROM r),
c AS (SELECT *, count(*) FILTER (prompt) OVER (PARTITION BY layer, head) AS long FROM p),
zero AS (SELECT layer, head, 0 AS step, event_id AS pos FROM c WHERE prompt AND n > long QUALIFY row_number() OVER (PARTITION BY layer, head ORDER BY score DESC, event_id) <= floor(long * 0.5::DOUBLE)),
t AS (SELECT unnest(range(1, (n - long) // 16 + 1)) AS step, layer, head FROM (SELECT DISTINCT layer, head, n, long FROM c)),
later AS (SELECT layer, head, step, event_id AS pos, score FROM (SELECT c.*, t.step, row_number() OVER (PARTITION BY layer, head, step, prompt ORDER BY score DESC, event_id) AS place FROM c JOIN t USING (layer, head) WHERE c.pos < long + 16 * step) WHERE NOT prompt OR place <= floor(long * 0.5::DOUBLE) QUALIFY row_number() OVER (PARTITION BY layer, head, step ORDER BY score DESC, event_id) <= 10)
SELECT * FROM zero UNION ALL SELECT layer, head, step, pos FROM later"""


@query("stream_phases", _PHASES)
def _(s, d):
    last = read(s, d, "events").agg(F.floor(F.max("event_id") / 3)).first()[0]
    return S.run_to_table(S.phased_cache(_stream(s, d), last, 0.5, 10, 16), "phases")
