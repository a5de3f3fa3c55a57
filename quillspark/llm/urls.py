"""URL filter: rules first, then trust and distrust that spread over the link graph of hosts.

Edges are (linking host, linked host) with the number of links, from absolute links in the pages. Trust starts at hosts
with allowed pages and follows links forward (personalised PageRank); distrust starts at hosts with blocked pages and
follows links backward, as a page that links to bad ones is suspect. Both stay distributed: a vector is one row per host
that the graph or the seeds name. Each step moves the mass that is still under way along the edges, a join on the host
and a sum written to the shared folder, until less than TOLERANCE of it is left: at most STEPS steps, as each keeps a
share of DAMPING. A host whose distrust share exceeds RATIO is blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import few, materialise, read_table

#: Share of a vector's mass that may be left under way, and the steps after which it is.
DAMPING, TOLERANCE = 0.85, 1e-4
STEPS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Distrust / (trust + distrust) above which a host is blocked; each vector sums to 1 at most.
RATIO = 0.5
#: Links in markup that name a host, which stands between // and the next delimiter; other links stay on their host.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Rules are an expression per row up to this number; longer lists are joined by host.
EXPRESSION_RULES = 200


@dataclass(frozen=True)
class Rule:
    """host/path, and whether its pages are allowed or blocked."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, A to Z lower-cased; empty for null or without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits the host or a domain above it and the start of the path, as a struct; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(df: DataFrame, rules: list[Rule], out: str = "__r") -> DataFrame:
    """df (host, path) with the longest rule that fits, of a list of any length: rules meet hosts by the domains above them, each host once."""
    if len(rules) <= EXPRESSION_RULES:
        return df.withColumn(out, longest_rule(F.col("host"), F.col("path"), rules))
    table = df.sparkSession.createDataFrame([(r.host, r.path, r.rule, r.verdict) for r in rules], "domain string, start string, rule string, verdict string")
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hosts = df.select("host").distinct().select("host", F.explode(above).alias("domain"))
    fit = hosts.join(few(table), "domain").groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("n"), "start", "rule", "verdict"))).alias("__rules"))
    first = F.get(F.filter("__rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    found = F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))
    return df.join(few(materialise(fit, "rules")), "host", "left").withColumn(out, found).drop("__rules")


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst, n: links between distinct hosts; a page without a host or without markup links to nothing."""
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: host, v. edges: src, dst, share (shares of a source sum to 1); seeds: host, v (sum 1).

    The sum over k of (1 - damping) * damping**k times what k steps make of the seeds, up to the step that leaves less than
    tolerance under way. What reaches a host without outgoing edges goes no further. Without seeds the result is empty;
    without edges it is the seeds, scaled by 1 - damping.
    """
    moving, rank = seeds, seeds
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping))):
        moving = edges.join(moving, edges.src == moving.host).groupBy("dst").agg(F.sum(F.col("v") * F.col("share") * damping).alias("v")).withColumnRenamed("dst", "host")
        moving = materialise(moving, "moving")
        rank = rank.unionByName(moving)
        if (moving.agg(F.sum("v")).first()[0] or 0.0) < tolerance:
            break
    return rank.groupBy("host").agg((F.sum("v") * (1 - damping)).alias("v"))


def shares(edges: DataFrame, backward: bool = False) -> DataFrame:
    """Edges with each one's share of its source's links; backward turns them round first."""
    own = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n") if backward else edges
    total = own.groupBy("src").agg(F.sum("n").alias("all"))
    return own.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def host_verdicts(hosts: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, ratio: float = RATIO) -> DataFrame:
    """host, trust, distrust, blocked. hosts: host, allowed, blocked (numbers of pages by rule) of each host of the pages."""
    totals = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    vectors = {}
    for name, col, total, back in (("trust", "allowed", totals.a, False), ("distrust", "blocked", totals.b, True)):
        seeds = hosts.where(F.col(col) > 0).select("host", (F.col(col) / F.lit(total or 1)).alias("v"))
        vectors[name] = spread(materialise(shares(edges, back), "edges"), seeds, tolerance).withColumnRenamed("v", name)
    both = hosts.select("host").join(vectors["trust"], "host", "left").join(vectors["distrust"], "host", "left").fillna(0.0, ["trust", "distrust"])
    share = F.when(F.col("distrust") > 0, F.col("distrust") / (F.col("trust") + F.col("distrust"))).otherwise(F.lit(0.0))
    return both.withColumn("blocked", share > ratio)


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", html: str = "html", keep: list[str] | None = None, tolerance: float = TOLERANCE, ratio: float = RATIO) -> DataFrame:
    """One row for each row of pages: the columns in keep (page_id), host, path, rule (null if none fits) and verdict.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed, as no link names it. Equal
    rows count once each as seeds. Only hosts whose distrust share is above ratio are joined back to the pages, by a
    left join that Spark may broadcast by its measured size and else splits where a host is frequent.
    """
    rules = RULES if rules is None else rules
    keep = ["page_id"] if keep is None else keep
    flat = pages.select(*[pages[c].alias(f"__k{i}") for i, c in enumerate(keep)], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), pages[html].alias("__html"))
    ruled = with_rule(flat, rules)
    counts = ruled.groupBy("host").agg(F.count_if(F.col("__r.verdict") == "allow").alias("allowed"), F.count_if(F.col("__r.verdict") == "block").alias("blocked"))
    hosts = materialise(counts.where("host <> ''"), "hosts")
    edges = materialise(host_edges(flat, "host", "__html"), "links")
    bad = host_verdicts(hosts, edges, tolerance, ratio).where("blocked").select("host", F.lit("block").alias("__host"))
    judged = ruled.drop("__html").join(bad, "host", "left")
    own = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return judged.select(*own, "host", "path", F.col("__r.rule").alias("rule"), F.coalesce("__r.verdict", "__host", F.lit("allow")).alias("verdict"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_urls of all pages: one row each, repeated rows included. Null urls and those without :// are allowed without a rule;
    null and empty markup links to nothing; an empty table gives no row."""
    return filter_urls(read_table(spark, sf_dir, "pages"))


def oracle(rules: list[Rule] = RULES, steps: int = STEPS, damping: float = DAMPING, ratio: float = RATIO) -> str:
    """The same in SQL: the rules as a table, both vectors as recursive sums of steps."""
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.rule}', '{r.verdict}')" for r in rules)
    out = f"""
with recursive rules(rhost, rpath, rule, verdict) as (values {values}),
flat as (select page_id, coalesce(html, '') as html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
ruled as (select f.page_id, f.host, f.path, max_by(r.rule, length(r.rule)) as rule, max_by(r.verdict, length(r.rule)) as rv from flat f
  left join rules r on (f.host = r.rhost or ends_with(f.host, '.' || r.rhost)) and starts_with(f.path, r.rpath) group by 1, 2, 3),
links as materialized (select src, dst, count(*) as n from (select host as src, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from flat where host <> '') where src <> dst group by 1, 2),
hosts as materialized (select host, count(*) filter (rv = 'allow') as a, count(*) filter (rv = 'block') as b from ruled where host <> '' group by 1)"""
    for name, col, src, dst in (("t", "a", "src", "dst"), ("d", "b", "dst", "src")):
        out += f""",
{name}e as materialized (select {src} as src, {dst} as dst, n / sum(n) over (partition by {src}) as share from links),
{name}s(k, host, v) as (select 0, host, {col} / (select sum({col}) from hosts) from hosts where {col} > 0
  union all select k + 1, dst, sum(v * share * {damping}) from {name}s join {name}e on src = host where k < {steps} group by k, dst),
{name} as (select host, sum(v) * {1 - damping} as v from {name}s group by 1)"""
    return (
        out
        + f"""
select r.page_id, r.host, r.path, r.rule, coalesce(r.rv, case when coalesce(d.v, 0) > 0 and d.v / (coalesce(t.v, 0) + d.v) > {ratio} then 'block' else 'allow' end) as verdict
from ruled r left join t using (host) left join d using (host)"""
    )
