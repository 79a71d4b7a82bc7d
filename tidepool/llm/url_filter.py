"""URL rules and link-graph propagation of trust and distrust over hosts.

A page is judged by the longest rule that fits its url.  Where no rule fits, its
host decides: personalised PageRank runs from trusted hosts along links and, for
distrust, from blocked hosts against the links (a page that links to a blocked
host is suspect); a host is blocked where distrust outweighs trust.

Cases: a null url or one without ``://`` has empty host and path, fits no rule,
and is allowed; a host that neither walk reaches, or both reach alike, is allowed; null html has no
links; repeated pages count as often as they occur; a null id stays null; empty tables give no rows;
urls and pages of any length are read whole; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, named

#: Up to so many rules become one expression of the plan; more are joined by host.
RULES_IN_PLAN = 100


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null where none fits. A block wins among equals."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` (host, path and others) with ``r``, the longest fitting rule or null.

    Many rules meet each distinct host by its suffixes; a host has few of them, which are tried on its pages' paths.
    """
    if len(rules) <= RULES_IN_PLAN:
        return pages.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, verdict string")
    parts = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    own = pages.select("host").distinct().select("host", suffix.alias("rule_host")).join(table, "rule_host")
    rank = F.struct(F.char_length("rule").alias("n"), F.char_length("rule_host").alias("m"), (F.col("verdict") == "block").alias("b"), "rule_path", "rule", "verdict")
    own = own.groupBy(F.col("host").alias("of")).agg(F.collect_list(rank).alias("own"))
    best = F.array_max(F.filter("own", lambda x: F.startswith(F.col("path"), x["rule_path"])))
    return pages.join(own, F.expr("host = of"), "left").withColumn("r", F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))).drop("of", "own")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) links between different hosts, from the html's hrefs. ``pages``: host, html.

    Absolute and protocol-relative links name their host; all others belong to the host of the
    page's ``<base href>``, or to the page's own, which makes no edge.
    """
    of = lambda link: host_of(F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link)).otherwise(link))
    far = r"""(?i)^(?:[a-z][a-z0-9+.-]*:)?//"""
    html = pages.where(F.contains(F.lower("html"), F.lit("href"))).select(F.col("host").alias("src"), "html", F.regexp_extract("html", r"""(?i)<base\b[^>]*?\shref\s*=\s*["']?([^"'\s>]*)""", 1).alias("base"))
    href = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<(?!base\b)[a-z][^>]*?\shref\s*=\s*["']?([^"'\s>]*)"""), F.lit(1))
    links = html.where(F.contains("html", F.lit("//"))).select("src", F.when(F.rlike("base", F.lit(far)), of(F.col("base"))).otherwise(F.col("src")).alias("own"), F.explode(href).alias("to"))
    opaque = F.rlike("to", F.lit(r"(?i)^[a-z][a-z0-9+.-]*:(?!//)"))  # mailto: and the like lead to no host
    links = links.where(~opaque).select("src", F.when(F.rlike("to", F.lit(far)), of(F.col("to"))).otherwise(F.col("own")).alias("dst"))
    return links.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 400) -> DataFrame:
    """Personalised PageRank for both walks at once.

    ``edges``: src, dst, n.  ``seeds``: host, trusted, blocked (weights).  Returns host,
    trust, distrust, each summing to 1.  Rounds go on until the ranks change by ``tolerance`` in all;
    more than ``most`` rounds raise.  Walks that end at a host without links start again at
    the seeds, which is the same as to scale what is left to a sum of 1.  A host's links are
    summed before each shuffle; a hub's share of the join is split by skew handling.
    """
    walks = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = walks.groupBy("kind", "src").agg(F.sum("n").alias("all_n"))
    step = cut(walks.join(out, ["kind", "src"]).select(F.col("kind").alias("walk"), "src", "dst", (F.col("n") / F.col("all_n")).alias("w")))
    start = seeds.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), "host", F.col("trusted").cast("double").alias("v")), F.struct(F.lit("d").alias("kind"), "host", F.col("blocked").cast("double").alias("v")))).alias("s")).select("s.*").where("v > 0")
    mass = start.groupBy("kind").agg(F.sum("v").alias("m"))
    start = cut(start.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("v") / F.col("m")).alias("v")))  # mass: two rows
    # the ranks are sums over walks of each length: ``flow`` is the mass that still walks, of which 1 - damping stays each round
    flow, parts, k = start, [], 0
    while True:
        parts.append(flow.select("kind", "host", (F.lit(1 - damping) * F.col("v")).alias("v")))
        flow = cut(flow.join(step, F.expr("kind = walk and host = src")).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.lit(damping) * F.col("v") * F.col("w")).alias("v")))
        k += 1
        if k % 4 == 0:
            parts = [cut(reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("v").alias("v")))]
            left = flow.agg(F.sum("v")).first()[0] or 0.0  # all that later rounds can add
            if left <= tolerance:
                break
            if k >= most:
                raise RuntimeError(f"ranks still change by {left} after {most} rounds")
    rank = parts[0]
    whole = rank.groupBy(F.col("kind").alias("walk")).agg(F.sum("v").alias("all_v"))  # two rows
    rank = rank.join(F.broadcast(whole), F.expr("kind = walk")).select("kind", "host", (F.col("v") / F.col("all_v")).alias("v"))
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("v")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("v")).otherwise(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule], threshold: float = 1.0, damping: float = 0.85, tolerance: float = 1e-6, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    base = named(pages, page_id=page_id, url=url, html=html).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = with_rule(base.select("page_id", "host", "path"), rules)
    seeds = judged.where("host != '' and r is not null").groupBy("host").agg(F.count(F.when(F.col("r.verdict") == "allow", 1)).alias("trusted"), F.count(F.when(F.col("r.verdict") == "block", 1)).alias("blocked"))
    ranks = spread(host_edges(base.select("host", "html")), cut(seeds), damping, tolerance)
    ranks = ranks.select(F.col("host").alias("of"), "trust", "distrust")
    by_host = F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), "block").otherwise("allow")
    return judged.join(ranks, F.expr("host = of"), "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_host).alias("verdict"), "trust", "distrust")
