"""URL rules and empirical-Bayes host reputation, in DataFrame functions only.

Rules (host and path prefix) judge a url first; the longest that fits wins. Pages that a rule
judges are the labelled outcomes: allowed 0, blocked 1. Their sums per host, registered domain (the
last two labels of the host) and suffix (the last label) give block rates, which are shrunk from
the top down: the rate of all pages is the prior mean of each suffix, a suffix's posterior mean that
of its domains, a domain's that of its hosts. Each level has its own prior weight, by the method of
moments over its members. A url without a rule is blocked if the lower bound of its host's
posterior rate, the mean less ``Z`` standard deviations, is above ``MAX_RATE``.

Sums are made from partial sums; only urls are read, once for the sums and once to judge them. Hosts join back to the thin table of parsed
urls, which adaptive execution splits where a host holds much of it.

Nulls: a null url, and one without ``://``, has an empty host and an empty path, which form a host
of their own. Empty tables give no rows. Repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The rules, as (action, host, path prefix): fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_RATE, Z = 0.5, 2.0
WEIGHTS = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEVELS = ("suffix", "domain", "host")


def parse_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, domain, suffix, rule, label (0 allowed, 1 blocked, null without a rule)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = pages.select("page_id", F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))

    def pick(value) -> Column:
        found = F.lit(None)
        for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            found = F.when(fits, F.lit(value(action, host, path))).otherwise(found)
        return found

    return out.select("*", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), pick(lambda a, h, p: h + p).alias("rule"), pick(lambda a, h, p: float(a == "block")).cast("double").alias("label"))


def _shrunk(members: DataFrame) -> DataFrame:
    """Adds pa, pb, the posterior of each member (n, f) about its prior mean (prior)."""
    parts = ("sum(n * prior * (1 - prior))", "sum(pow(f - n * prior, 2) / n)", "count(*)", "sum(n)", "avg(prior * (1 - prior))")
    within, between, size, n, typical = members.where("n > 0").selectExpr(*[f"{e} AS c{k}" for k, e in enumerate(parts)]).first()
    weight = WEIGHTS[1]
    if size:
        spread = (between - size * typical) / n
        weight = min(max(within / n / spread - 1 if spread > 1e-12 else WEIGHTS[1], WEIGHTS[0]), WEIGHTS[1])
    return members.selectExpr("*", f"f + {weight!r}D * prior AS pa", f"n - f + {weight!r}D * (1 - prior) AS pb")


def reputation(parsed: DataFrame) -> DataFrame:
    """(host, rate, sd) for every host of parse_urls."""
    sums = [F.count("label").cast("double").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("f")]
    # Sums of hosts are made once; all levels roll up from them.
    hosts = table(parsed.groupBy("suffix", "domain", "host").agg(*sums), "hosts")
    up = [F.sum("n").alias("n"), F.sum("f").alias("f")]
    domains = table(hosts.groupBy("suffix", "domain").agg(*up), "domains")
    suffixes = table(domains.groupBy("suffix").agg(*up), "suffixes")
    whole = suffixes.agg(*up).first()
    mean = (whole.f + 1.0) / (whole.n + 2.0) if whole.n else 0.5
    level = _shrunk(suffixes.withColumn("prior", F.lit(mean)))
    for members, keys in ((domains, ["suffix"]), (hosts, ["suffix", "domain"])):
        prior = level.select(*keys, F.expr("pa / (pa + pb)").alias("prior"))
        level = _shrunk(members.join(prior, keys))
    return level.selectExpr("host", "pa / (pa + pb) AS rate", "sqrt(pa * pb / (pa + pb + 1)) / (pa + pb) AS sd")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's shrunk block rate."""
    parsed = parse_urls(pages, rules)
    out = parsed.join(reputation(parsed), "host", "left")
    verdict = F.when(F.col("label").isNotNull(), F.col("label") > 0.5).otherwise(F.expr(f"rate - {Z}D * sd > {MAX_RATE}D"))
    return out.select("page_id", "host", "path", "rule", F.when(verdict, "block").otherwise("allow").alias("verdict"), F.round("rate", 9).alias("host_rate"))


def _level_sql(name: str, members: str, keys: str, above: str | None) -> str:
    prior = f"SELECT m.*, prior FROM {members} m JOIN (SELECT {keys}, pa / (pa + pb) AS prior FROM {above}) USING ({keys})" if above else f"SELECT *, (SELECT CASE WHEN sum(n) > 0 THEN (sum(f) + 1) / (sum(n) + 2) ELSE 0.5::DOUBLE END FROM {members}) AS prior FROM {members}"
    return f"""{name}_in AS ({prior}), {name}_m AS (
  SELECT sum(n * prior * (1 - prior)) / sum(n) AS within, (sum(pow(f - n * prior, 2) / n) - count(*) * avg(prior * (1 - prior))) / sum(n) AS spread FROM {name}_in WHERE n > 0
), {name} AS (SELECT i.*, f + w * prior AS pa, n - f + w * (1 - prior) AS pb FROM {name}_in i,
  (SELECT least(greatest(CASE WHEN spread > 1e-12 THEN within / spread - 1 ELSE {WEIGHTS[1]}::DOUBLE END, {WEIGHTS[0]}::DOUBLE), {WEIGHTS[1]}::DOUBLE) AS w FROM {name}_m))"""


def oracle(rules=RULES) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", a, h + p) for a, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in fits) + " END"
    label = "CASE " + " ".join(f"WHEN {c} THEN {int(a == 'block')}::DOUBLE" for c, a, _ in fits) + " END"
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{url}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path FROM pages
), p AS (
  SELECT *, {rule} AS rule, {label} AS label, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM u
), hosts AS (SELECT suffix, domain, host, count(label)::DOUBLE AS n, coalesce(sum(label), 0)::DOUBLE AS f FROM p GROUP BY ALL
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(f) AS f FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(f) AS f FROM domains GROUP BY ALL
), {_level_sql('s', 'suffixes', 'suffix', None)}, {_level_sql('d', 'domains', 'suffix', 's')}, {_level_sql('h', 'hosts', 'suffix, domain', 'd')}
SELECT page_id, p.host AS host, path, rule,
  CASE WHEN coalesce(label > 0.5, pa / (pa + pb) - {Z}::DOUBLE * sqrt(pa * pb / (pa + pb + 1)) / (pa + pb) > {MAX_RATE}) THEN 'block' ELSE 'allow' END AS verdict,
  round(pa / (pa + pb), 9) AS host_rate
FROM p JOIN h ON p.host = h.host
"""
