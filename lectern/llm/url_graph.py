"""URL filter by link-graph propagation over hosts.

Trust is a personalised PageRank from trusted hosts along edges, distrust one from blocked hosts along reversed
edges: who links to blocked hosts is distrusted. Edges are the links between hosts that pages hold and, between a
host and the domain one label above it (of at least min_labels labels), edges in both directions, as they belong
to one site. Seeds are sought among the hosts of pages and of both ends of edges, as blocked hosts are often only
linked to. A host is blocked if its distrust is at least threshold of both. URL rules come first.

Edges are summed before they move; each round is one join and one aggregation of sums, and every second one is written
to the shared folder, which also tells how much moved. Rules are matched once for each host and only their paths for each
page. Hosts with more than a thousandth of all edges or pages, fewer than a thousand by that, are hubs: their edges are
dealt over as many numbers as keep each number's share under that, and the driver holds the hubs' names.

Defined results: a null URL or one without :// has an empty host and path, fits no rule and is allowed. Repeated
rows are judged alike, each for itself. Links in null pages: none. Without seeds or edges no host is distrusted but the blocked ones
themselves. Of equally long rules blocking wins. An empty table gives an empty result. Columns other than the id, URL
and page are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import common as C

DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-4
#: Rounds that one plan holds.
TURNS = 2
#: A tag ends at the next < or > and white space is not given back, so the search takes time linear in the page.
LINK = r"""(?i)<a\s[^<>]*?href\s*+=\s*+["']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/"'\s>?#]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return C.lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    return C.let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", min_labels: int = 3) -> DataFrame:
    """(src, dst, w): how often pages of src link to dst, and the edges within sites."""
    of = pages.select(host_and_path(F.col(url))[0].alias("src"), F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)).alias("to"))
    linked = of.where(F.size("to") > 0).select("src", F.explode("to").alias("dst")).select("src", C.lower_ascii(F.regexp_replace(F.regexp_replace("dst", r"^.*@", ""), r":\d*$", "")).alias("dst"))
    linked = linked.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select(host_and_path(F.col(url))[0].alias("src")).where("src <> ''").distinct()
    up = hosts.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).where(F.size(F.split("src", r"\.")) > min_labels).select("src", "dst", F.lit(1.0).alias("w"))
    return linked.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust), each summing to at most 1.

    edges (src, dst, w); seeds (host, trusted, blocked) of distinct hosts with their shares of the jumps. A host
    without edges keeps what it got and passes nothing on. Rounds end when less than tolerance moved. What moves is at
    most 4 * damping ** n in round n, which bounds their number unless most_rounds does.
    """
    if most_rounds is None:
        most_rounds = math.floor(math.log(tolerance / 4) / math.log(damping)) + 1
    out, into = edges.groupBy("src").agg(F.sum("w").alias("t")), edges.groupBy("dst").agg(F.sum("w").alias("t"))
    along = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("t")).alias("ft"), F.lit(0.0).alias("fd"))
    against = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("ft"), (F.col("w") / F.col("t")).alias("fd"))
    steps = C.materialise(along.unionByName(against).groupBy("a", "b").agg(F.sum("ft").alias("ft"), F.sum("fd").alias("fd")), "host-steps")
    dealt = C.shares(steps, "a")
    key = ["host"]
    if dealt:
        summed, key = steps, ["host", "part"]
        steps = C.materialise(summed.withColumn("part", F.pmod(F.hash("b"), dealt(F.col("a")))), "host-steps")
        C.discard(summed)
    steps = steps.withColumnRenamed("a", "host")
    start = C.materialise(seeds.where("trusted > 0 OR blocked > 0"), "host-seeds")
    rank = C.materialise(start.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"), F.lit(0.0).alias("moved")), "host-rank")
    jump = start.select("host", (F.col("trusted") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"), F.lit(0.0).alias("t0"), F.lit(0.0).alias("d0"))

    def turn(now, last):
        parted = now.withColumn("part", F.explode(F.sequence(F.lit(0), dealt(F.col("host")) - 1))) if dealt else now
        moving = parted.join(steps, key)
        sent = moving.select(F.col("b").alias("host"), (F.col("trust") * F.col("ft") * damping).alias("trust"), (F.col("distrust") * F.col("fd") * damping).alias("distrust"), F.lit(0.0).alias("t0"), F.lit(0.0).alias("d0"))
        if not last:
            return jump.unionByName(sent).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before = now.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        summed = jump.unionByName(sent).unionByName(before).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t0", "d0")])
        return summed.select("host", "trust", "distrust", (F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))).alias("moved"))

    for done in range(0, most_rounds, TURNS):
        after, n, seen = rank, min(TURNS, most_rounds - done), Observation()
        for k in range(n):
            after = turn(after, k == n - 1)
        after = C.materialise(after.observe(seen, F.sum("moved").alias("moved")), "host-rank")
        C.discard(rank)
        rank = after
        if (seen.get["moved"] or 0.0) < tolerance:
            break
    return rank.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str]], trusted: Column, blocked: Column, id_col: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD, min_labels: int = 3, damping: float = DAMPING, blocklist: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for each row of pages.

    rules are (allow or block, host and path). Seeds are hosts of pages or links: trusted and blocked are conditions on the
    column host, on ruled, whether a page of the host is allowed by a rule, and on barred, whether rules block all of its
    pages; blocklist may be a table with a column host, whose hosts and their subdomains are blocked seeds too. A host of both
    is blocked.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    named = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    table = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", r, v) for v, r in rules] or [(None,) * 4], "on string, prefix string, rule string, verdict string")
    hosts = named.groupBy("host").agg(F.count("*").alias("pages")).where("host <> ''")
    fits = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("on")).join(table, "on").groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("n"), "verdict", "rule", "prefix"))).alias("rules"))
    ruled = C.materialise(hosts.join(fits, "host", "left"), "hosts")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    by_rule = named.join(ruled.where("rules IS NOT NULL").select("host", "rules"), "host").groupBy("host").agg(*(F.count(F.when(best["verdict"] == v, 1)).alias(v) for v in ("allow", "block")))
    held = by_rule.join(ruled.select("host", "pages"), "host").select(F.col("host").alias("h"), (F.col("allow") > 0).alias("ruled"), (F.col("block") == F.col("pages")).alias("barred"))
    edges = C.materialise(host_edges(pages, url, html, min_labels), "host-edges")
    named_hosts = ruled.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    no = F.lit(False)
    known = named_hosts.join(held, F.col("host") == F.col("h"), "left").select("host", F.coalesce("ruled", no).alias("ruled"), F.coalesce("barred", no).alias("barred"), no.alias("listed"))
    if blocklist is not None:
        listed = known.select("host", F.explode(suffixes(F.col("host"))).alias("on")).join(blocklist.select(C.lower_ascii(F.col("host")).alias("on")), "on", "left_semi").select(F.col("host").alias("h")).distinct()
        known = known.drop("listed").join(listed, F.col("host") == F.col("h"), "left").withColumn("listed", F.col("h").isNotNull()).drop("h")
    marks = known.select("host", trusted.alias("t"), (blocked | F.col("listed")).alias("b")).select("host", F.when(F.col("t") & ~F.col("b"), 1.0).otherwise(0.0).alias("t"), F.when(F.col("b"), 1.0).otherwise(0.0).alias("b"))
    marks = C.materialise(marks.where("t > 0 OR b > 0"), "host-marks")
    sums = marks.agg(F.sum("t").alias("t"), F.sum("b").alias("b")).first()
    seeds = marks.select("host", (F.col("t") / (sums["t"] or 1.0)).alias("trusted"), (F.col("b") / (sums["b"] or 1.0)).alias("blocked"))
    ranks = propagate(edges, seeds, damping)
    facts = ruled.join(ranks, "host", "left").select("host", F.col("pages").alias("n"), "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    own = named.select(F.col(id_col).alias("_id"), "host", "path")
    hostless = own.where("host = ''").select("*", F.lit(None).cast(facts.schema["rules"].dataType).alias("rules"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    total = ruled.agg(F.sum("pages")).first()[0] or 0
    found = C.join_hot(own.where("host <> ''"), facts, "host", total, "host-facts").unionByName(hostless).withColumnRenamed("_id", id_col)
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return found.select(id_col, "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
