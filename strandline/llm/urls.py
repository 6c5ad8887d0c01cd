"""URL filter: rules first, then link-graph propagation of trust and distrust over hosts.

Pages that a rule allows seed their host with trust, pages that a rule blocks seed it with distrust. Trust flows
along host links (personalised PageRank), distrust against them (the same on the reversed links). A host whose
distrust exceeds its trust is blocked, any other allowed; that is the verdict where no rule fits. Steps go on until all
ranks together grow by less than TOLERANCE of the seeds' mass, ITERATIONS at most; what is missing then is under
DAMPING ^ ITERATIONS, 0.01 %, of that mass. Both sides of a step's join are written tables, so Spark splits hub hosts.

A null url, or one without `://`, has an empty host and path; links without a host of their own are inside
their page's host and don't count; repeated pages count each on its own; an empty table gives an empty
result; other columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import read, stored

#: (verdict, host, path), fixed by the query's contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
ITERATIONS = 60
TOLERANCE = 1e-6
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"
#: An anchor's or area's link with a host of its own.
LINK = r"""(?i)<a(?:rea)?\s[^<>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
LINK_HOST = r"//([^/?#]*)"


def host_of(url: Column, pattern: str = HOST) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), BIG, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path in one, and its verdict; null where none fits. The rules
    are a short list in the plan; blocklists of many hosts belong in a table joined on host suffixes."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links lead from one host's pages to another host."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(F.col("link"), LINK_HOST).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(seeds: DataFrame, links: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust. seeds: host, trust, distrust; links: src, dst, n. Both directions walk in one
    join and one aggregation a step, on (kind, host). Ranks only grow, so the growth of their sum is all that changes."""
    both = seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("seed")))).alias("s")).select("s.kind", "host", (F.col("s.seed") * (1 - damping)).alias("r")).where("r > 0")
    rank = both
    if not links.isEmpty():
        ways = links.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to")), F.struct(F.lit("d").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to")))).alias("w"), "n").select("w.*", "n")
        ways = stored(ways)
        out = stored(ways.groupBy("kind", "from").agg(F.sum("n").alias("out")))
        ways = stored(ways.join(out, ["kind", "from"]).select("kind", "from", "to", (damping * F.col("n") / F.col("out")).alias("share")))
        mass = lambda df: df.agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        before = least = mass(both)
        for _ in range(iterations):
            moved = ways.join(rank.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (F.col("r") * F.col("share")).alias("r"))
            rank = stored(moved.unionByName(both).groupBy("kind", "host").agg(F.sum("r").alias("r")))
            now = mass(rank)
            if now - before <= tolerance * least / (1 - damping):
                break
            before = now
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(total("t").alias("trust"), total("d").alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = at.withColumns({"rule": rule, "ruled": verdict})
    count = lambda v: F.count(F.when(F.col("ruled") == v, 1)).cast("double")
    seeds = ruled.where(F.col("ruled").isNotNull()).groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    ranks = propagate(stored(seeds), stored(host_links(pages)), iterations, damping)
    blocked = stored(ranks.where(F.round("distrust", 9) > F.round("trust", 9)).select(F.col("host").alias("blocked")))
    return ruled.join(blocked, F.col("host") == F.col("blocked"), "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def sql7(iterations: int = ITERATIONS, damping: float = DAMPING) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(v, h, p)}'" for v, h, p in order) + " END"
    link = LINK.replace("'", "''")
    steps = ["r0 AS (SELECT * FROM s)"]
    for k in range(1, iterations + 1):
        steps.append(f"r{k} AS (SELECT kind, host, sum(r) AS r FROM (SELECT w.kind, w.\"to\" AS host, p.r * w.share AS r FROM w JOIN r{k - 1} p ON p.kind = w.kind AND p.host = w.\"from\" UNION ALL SELECT * FROM s) GROUP BY ALL)")
    return rf"""
WITH a AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{BIG}', '{SMALL}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html FROM pages),
b AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM a),
s0 AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow')::DOUBLE AS t, count(*) FILTER (WHERE ruled = 'block')::DOUBLE AS d FROM b WHERE ruled IS NOT NULL GROUP BY host),
s AS (SELECT kind, host, r * {1 - damping!r}::DOUBLE AS r FROM (SELECT 't' AS kind, host, t AS r FROM s0 UNION ALL SELECT 'd', host, d FROM s0) WHERE r > 0),
l0 AS (SELECT host AS src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{BIG}', '{SMALL}') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM a)),
l AS (SELECT src, dst, count(*) AS n FROM l0 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
w0 AS (SELECT 't' AS kind, src AS "from", dst AS "to", n FROM l UNION ALL SELECT 'd', dst, src, n FROM l),
w AS (SELECT kind, "from", "to", {damping}::DOUBLE * n / sum(n) OVER (PARTITION BY kind, "from") AS share FROM w0),
{", ".join(steps)},
v AS (SELECT host FROM r{iterations} GROUP BY host HAVING round(coalesce(sum(r) FILTER (WHERE kind = 'd'), 0), 9) > round(coalesce(sum(r) FILTER (WHERE kind = 't'), 0), 9))
SELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN v.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM b LEFT JOIN v ON b.host = v.host
"""
