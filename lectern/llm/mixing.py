"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by membership pattern (the sorted set of their sources). Tokens flow from patterns to the
quotas of their sources: the first pass over a pattern's documents is free, each further pass costs one more, and
no more than `passes` are allowed. As cost lies on the arcs into patterns and rises with the pass, filling the
passes one after the other with a maximal flow, each time continuing from the last, gives the cheapest flow.

A pattern's flow buys whole passes over all its documents and, for the rest, those documents that come first
by a seeded hash. Three histograms, each of the 256 parts of the part in which the rest ran out before, find where it runs
out to 1 in 16 million, and only the rows there are ordered. The document at which it runs out gives what is left (cut="partial") or, where that
is at least half of it, all its words (cut="whole").

The driver holds a row for each pattern. Their number does not grow with documents, but with the mixture that is
asked for; beyond max_patterns it is an error, not a silent cut.

Defined results: null texts have size 0 and take 0. A null source is a source of its own, last in order. Sources
without words have target 0. Repeated rows draw alike; where the rest runs out among rows of one id, they share it
evenly. Null ids draw as one id. An empty table gives an empty result. Long texts are counted whole. Columns other than
the id, text and source are not looked at; mixed() returns them as they are.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
SEED = 1729
MAX_PATTERNS = 100_000
#: Bits of the hash that a histogram looks at, and histograms.
DIGIT, DIGITS = 8, 3


def targets(sizes: dict, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> dict:
    """Words wanted from each source. Sources in order of code points, None last, get the weights in turn; none is over passes times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in names if s in free)
        full = [s for s in names if s in free and left * weight[s] / total > passes * sizes[s]]
        if not full:
            return want | {s: left * weight[s] / total for s in names if s in free}
        for s in full:
            want[s] = float(passes * sizes[s])
            free.discard(s)
        left = share * sum(sizes.values()) - sum(want[s] for s in names if s in want)
    return want


def flow(sizes: dict[tuple, int], quotas: dict, passes: int = PASSES) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources, at least cost in repeated words.

    Blocking flows (levels by breadth, then walks along them) fill the quotas with the first pass alone, then
    with two, and so on. Quotas that cannot be met are met as far as they can.
    """
    nodes: dict = {"in": 0, "out": 1}
    arcs: list[list[int]] = [[], []]
    to: list[int] = []
    room: list[int] = []

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(arcs)
            arcs.append([])
        return nodes[x]

    def arc(a: int, b: int, most: int) -> int:
        arcs[a].append(len(to)), to.append(b), room.append(most)
        arcs[b].append(len(to)), to.append(a), room.append(0)
        return len(to) - 2

    entry = {p: arc(0, node(("p", p)), 0) for p in sizes}
    used = {(p, s): arc(node(("p", p)), node(("s", s)), 2**62) for p in sizes for s in p}
    for s, q in quotas.items():
        arc(node(("s", s)), 1, q)
    for _ in range(passes):
        for p, n in sizes.items():
            room[entry[p]] += n
        while True:
            level = {0: 0}
            line = deque([0])
            while line:
                a = line.popleft()
                for e in arcs[a]:
                    if room[e] and to[e] not in level:
                        level[to[e]] = level[a] + 1
                        line.append(to[e])
            if 1 not in level:
                break
            at = [0] * len(arcs)
            path: list[int] = []
            here = 0
            while True:
                if here == 1:
                    most = min(room[e] for e in path)
                    for e in path:
                        room[e] -= most
                        room[e ^ 1] += most
                    k = next(k for k, e in enumerate(path) if not room[e])
                    here = to[path[k] ^ 1]
                    del path[k:]
                while at[here] < len(arcs[here]) and not (room[e := arcs[here][at[here]]] and level.get(to[e], -1) == level[here] + 1):
                    at[here] += 1
                if at[here] < len(arcs[here]):
                    path.append(arcs[here][at[here]])
                    here = to[path[-1]]
                elif path:
                    here = to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break
    got: dict[tuple, dict] = {p: {} for p in sizes}
    for (p, s), e in used.items():
        if room[e ^ 1]:
            got[p][s] = room[e ^ 1]
    return got


def _members(docs: DataFrame, source: str) -> Column:
    """The membership pattern as an array: of a plain column, its value alone."""
    if docs.schema[source].dataType.typeName() == "array":
        return F.when(F.col(source).isNull() | (F.size(source) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.sort_array(F.array_distinct(F.col(source).cast("array<string>")), asc=True))
    return F.array(F.col(source).cast("string"))


def _draw(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col))


def _place(draw: Column, bits: int) -> Column:
    """The first bits of a draw, as a number that rises with the signed hash."""
    return F.shiftrightunsigned(draw.bitwiseXOR(F.lit(-(2**63))), 64 - bits)


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    return docs.select(F.col(id_col), _members(docs, source).alias("pattern"), C.word_count(F.col(text)).alias("size"), _draw(id_col, seed).alias("draw"))


def plan(found: DataFrame, id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """A row for each pattern: whole passes (base), and the hash up to which documents come once more (cut), with the words that documents at the cut give (rest, over ties).

    found comes from sized() and is read three times. Also source_size and target, of the pattern's first source.
    """
    spark = found.sparkSession
    rows = found.groupBy("pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns; mix by coarser sources or raise max_patterns")
    sizes = {tuple(r["pattern"]): int(r["n"]) for r in rows}
    source_size: dict = {}
    for p, n in sizes.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + n
    want = targets(source_size, weights, share, passes)
    given = flow(sizes, {s: int(x) for s, x in want.items()}, passes)
    bought = []
    for p, n in sizes.items():
        total = sum(given[p].values())
        base = total // n if n else 0
        bought.append((list(p), base, total - base * n, source_size[p[0]], want[p[0]]))
    # of an Arrow table, as one of a list of rows would start Python workers of a kind of their own
    kinds = (pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    columns = zip(*bought, strict=True) if bought else [()] * len(kinds)
    names = ["pattern", "base", "more", "source_size", "target"]
    wanted = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names))
    open_ = wanted.where("more > 0").select(F.col("pattern").alias("p"), "more")
    join = F.col("pattern") == F.col("p")
    # at most 256 sums of a pattern come into a window, then the few rows of one place; what is broadcast has a row for each
    # pattern, of which there are max_patterns at most, so no row moves to its pattern
    last = open_.select("p", F.lit(0).cast("long").alias("place"), F.col("more").alias("need"))
    for digit in range(1, DIGITS + 1):
        bits = DIGIT * digit
        open_place = join & (_place(F.col("draw"), bits - DIGIT) == F.col("place")) if digit > 1 else join
        within = found.join(F.broadcast(last), open_place)
        sums = within.groupBy("p", "need", _place(F.col("draw"), bits).alias("b")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("p").orderBy("b")))
        last = C.materialise(run.where("upto >= need and upto - n < need").select("p", F.col("b").alias("place"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need")), "mixing-place")
    inside = found.join(F.broadcast(last), join & (_place(F.col("draw"), DIGIT * DIGITS) == F.col("place"))).groupBy("p", "need", "draw").agg(F.sum("size").alias("n"))
    ordered = inside.withColumn("upto", F.sum("n").over(W.partitionBy("p").orderBy("draw")))
    cuts = ordered.where("upto >= need and upto - n < need").select("p", F.col("draw").alias("cut"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("n").alias("at_cut"))
    return C.materialise(wanted.join(cuts, join, "left").select("pattern", "base", "cut", "rest", "at_cut", "source_size", "target"), "mixing-plan")


def taken(found: DataFrame, bought: DataFrame, cut: str = "partial") -> DataFrame:
    """found with source_size, target and taken: words of each row that the mix takes, repeats counted."""
    if cut not in ("partial", "whole"):
        raise ValueError(f"cut is {cut!r}; it is partial or whole")
    share = F.expr("size * rest div at_cut") if cut == "partial" else F.when(2 * F.col("rest") >= F.col("at_cut"), F.col("size")).otherwise(0)
    once_more = F.when(F.col("draw") < F.col("cut"), F.col("size")).when(F.col("draw") == F.col("cut"), share).otherwise(0)
    plan_ = bought.withColumnRenamed("pattern", "p")
    return found.join(F.broadcast(plan_), F.col("pattern") == F.col("p")).withColumn("taken", (F.col("base") * F.col("size") + once_more).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED, cut: str = "partial") -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs; the text is read once."""
    found = C.materialise(sized(docs, id_col, text, source, seed), "mixing")
    return taken(found, plan(found, id_col, weights, share, passes), cut).select(id_col, "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken, whole documents only. Texts are not shuffled."""
    own = docs.columns
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    ic, tc, sc = (f"c{own.index(c)}" for c in (id_col, text, source))
    found = C.materialise(sized(named, ic, tc, sc, seed), "mixing")
    bought = plan(found, ic, weights, share, passes)
    every = named.withColumn("pattern", _members(named, sc)).withColumn("size", C.word_count(F.col(tc))).withColumn("draw", _draw(ic, seed))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    copies = taken(every, bought, "whole").select(*[f"c{i}" for i in range(len(own))], F.explode(F.array_repeat(F.lit(0), times)))
    return copies.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
