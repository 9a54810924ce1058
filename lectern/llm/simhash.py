"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made once, equal ones are merged, and the distinct ones go into tiles of one population count
each. Two tiles whose counts differ by more than the radius cannot hold a link and are never paired. Within
a pair of tiles, classes of rows with equal counts in the four 16-bit lanes are compared by exclusive-or and bit
counts, again skipping classes whose lane counts differ by more than the radius in sum. No candidate is missed:
the distance of two words is never below the difference of their counts, in whole or lane by lane.

Tiles are files in the shared folder; what moves are pairs of their names. A step compares at most STEP pairs of
fingerprints and merges their links at once, so a worker's memory is bounded however dense a group is. A pair of tiles
returns a spanning forest of its links, never the links themselves, so a group of n near copies gives at most
n - 1 edges a pair of tiles. Components then come from alternating large-star and small-star steps, whose joins give
nodes with more than a thousandth of all edges a way of their own. The driver holds a row for each tile.

All tables in between are narrow and written by Python workers, so that no executor starts processes (see common.by_workers).

Defined results: null and blank texts have fingerprint zero and are linked as any other. Repeated rows share
their component. Null ids are kept; a component's id is its smallest id that is not null. Empty table: no rows.
Other columns, also such as th, fp or t, are not looked at; keep_first() returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import files

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints that a tile holds on average at most; a tile is an array of half a megabyte.
TILE = 65_536
#: Comparisons at a time.
STEP = 250_000


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Of one text in UTF-8; a bit is set if more than half of the shingles' hashes have it."""
    import xxhash

    ws = (text or b"").lower().split()  # bytes.lower() and bytes.split() know ASCII alone
    if not ws:
        return 0
    joined, n = b" ".join(ws), max(1, len(ws) - width + 1)
    if len(ws) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        set_bits += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, fp): a hash that tells texts apart and a signed 64-bit fingerprint, for each row; a table in the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        b = None
        for b in batches:
            fps = np.fromiter(map(fingerprint, (x.as_py() for x in b.column(2))), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=[id_col, "th", "fp"])
        del b
        C.give_back()

    read = docs.select(id_col, F.xxhash64(text).alias("th"), F.encode(F.col(text), "UTF-8").alias("t"))
    return C.by_workers(read, "simhash", run, f"`{id_col}` {kind}, th long, fp long")


def _lanes(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x sorted by its lane counts, the classes' counts, and where they start (with the end)."""
    lanes = _lanes(x)
    key = lanes @ np.array([4913, 289, 17, 1])
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    return x[order], lanes[order][start], np.append(start, len(x))


def _settle(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the links a-b into root, which always points to a smaller place of the same component."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most radius bits connect, within left if right is None, else between the two.

    Fingerprints in left and right are distinct. At most about step comparisons, and their links, are held at a time.
    """
    a, lanes_a, at_a = _classes(left)
    b, lanes_b, at_b = (a, lanes_a, at_a) if right is None else _classes(right)
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate((a, b))
    root = np.arange(len(nodes), dtype=np.int32)
    sizes = np.diff(at_b)
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, lane in enumerate(lanes_a):
        near = np.abs(lanes_b - lane).sum(axis=1) <= radius
        if right is None:
            near[:i] = False
        rows = np.flatnonzero(np.repeat(near, sizes)).astype(np.int32)
        for from_b in range(0, len(rows), step):
            at = rows[from_b : from_b + step]
            others, height = b[at], max(1, step // len(at))
            for lo in range(at_a[i], at_a[i + 1], height):
                mine = a[lo : min(lo + height, at_a[i + 1])]
                x, y = np.divmod(np.flatnonzero(np.bitwise_count(mine[:, None] ^ others[None, :]) <= radius).astype(np.int32), np.int32(len(at)))
                x, y = x + np.int32(lo), at[y] + np.int32(shift)
                new = root[x] != root[y]  # also leaves out each fingerprint's link to itself
                if new.any():
                    pending.append((x[new], y[new]))
                    n += len(pending[-1][0])
                if n > step // 4:
                    _settle(root, *map(np.concatenate, zip(*pending, strict=True)))
                    pending, n = [], 0
    if pending:
        _settle(root, *map(np.concatenate, zip(*pending, strict=True)))
    child = np.flatnonzero(root != np.arange(len(nodes), dtype=np.int32))
    return nodes[child], nodes[root[child]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the components of the distinct fingerprints in column fp; a table in the shared folder."""
    spark = distinct.sparkSession
    counted = distinct.select("fp", F.bit_count("fp").cast("int").alias("c"))
    tiles_of = {r["c"]: -(-r["n"] // tile) for r in counted.groupBy("c").agg(F.count("*").alias("n")).collect()}  # at most 65 rows
    if not tiles_of:
        return spark.createDataFrame([], "a long, b long")
    of = F.create_map(*[F.lit(x) for c in range(65 + radius) for x in (c, tiles_of.get(c, 0))])
    number = lambda c, j: c.cast("long") * F.lit(2**32) + j
    keyed = counted.select("fp", number(F.col("c"), F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.element_at(of, F.col("c")))).alias("t"))
    folder = C.fresh_path(spark, "simhash-tiles")

    def write(group: pa.Table) -> pa.Table:
        fps = np.sort(group.column("fp").to_numpy()).astype("<i8")
        uri = files.write_arrays(folder, f"tile-{group.column('t')[0].as_py()}", [fps])
        return pa.table({"t": group.column("t")[:1], "uri": [uri], "n": pa.array([len(fps)], pa.int64())})

    tiles = spark.createDataFrame(keyed.groupBy("t").applyInArrow(write, "t long, uri string, n long").toArrow())
    # tiles that may follow a tile: of its count and of up to radius more
    count = F.shiftright("t", 32).cast("int")
    following = F.explode(F.flatten(F.transform(F.sequence(count, count + radius), lambda c: C.let(F.element_at(of, c), lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: number(c, j))).otherwise(F.array().cast("array<long>"))))))
    pairs = tiles.select("t", F.col("uri").alias("l"), F.col("n").alias("n_l"), following.alias("u")).where("u >= t")
    named = pairs.join(tiles.select(F.col("t").alias("u"), F.col("uri").alias("r"), F.col("n").alias("n_r")), "u")
    # the pairs differ in cost: deal them out one by one
    spread = named.select("l", "n_l", "r", "n_r").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "l", "r")

    def run(batches):
        for batch in batches:
            for l, n_l, r, n_r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine, other = (files.open_arrays(uri, n, ["<u8"])[0] for uri, n in ((l, n_l), (r, n_r)))
                a, b = forest(mine, None if l == r else other, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return C.by_workers(spread, "simhash-links", run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node with an edge is connected to, by alternating stars.

    edges (a, b) in any direction. Every round cuts lineage with a table in the shared folder.
    """

    def least(e):  # the smallest neighbour of each node
        return e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))

    def large(e):  # neighbours above a node go to the smallest in its neighbourhood
        both = e.union(e.select("b", "a"))
        joined = C.join_hot(both, C.in_few(least(both).select("a", F.least("a", "m").alias("m"), "n"), 2 * seen["n"]), "a", 2 * seen["n"], "star")
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e, most):  # a node and its smaller neighbours go to the smallest of these; e has at most so many rows
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        joined = C.join_hot(down, C.in_few(least(down), most), "a", seen["n"], "star")
        return C.in_few(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), 2 * most)

    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    seen = mark(edges)
    now = C.materialise(small(edges, seen["n"]), "star")
    seen = mark(now)
    for _ in range(most_rounds):
        after = C.materialise(small(large(now), 2 * seen["n"]), "star")
        C.discard(now)
        now, last, seen = after, seen, mark(after)
        if seen == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _grouped(docs: DataFrame, id_col: str, text: str, radius: int, tile: int) -> DataFrame:
    """(id, th, fp, first): a row for each of docs; first is the (no_id, id, th) of its component that comes first. th tells texts of one id apart."""
    marked = fingerprints(docs, id_col, text)
    own = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("th").alias("th"))
    total = marked.count()
    distinct = C.materialise(C.in_few(marked.groupBy("fp").agg(F.min(own).alias("least"), F.count("*").alias("n")), total), "simhash-distinct")
    found = links(distinct, radius, tile)
    roots = components(found)
    of = C.by_workers(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), "n"), "simhash-roots")
    named = of.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    n_of = of.count()
    table = C.join_hot(of.select("fp", "root"), C.in_few(named, n_of), "root", n_of, "root").select("fp", "first")
    rows = C.in_few(distinct.select("fp", "n").join(table, "fp"), n_of)
    out = C.join_hot(marked, rows, "fp", total, "fp")
    C.discard(found)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) for each row of docs."""
    return _grouped(docs, id_col, text, radius, tile).select(id_col, "fp", F.col("first.id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one row of each component: the one of the smallest id (of its texts, the one of the smallest hash; of its copies, any).

    Ids, text hashes and fingerprints decide; whole rows move once, to leave the others out.
    """
    found = C.by_workers(_grouped(docs, id_col, text, radius, tile).select(F.col(id_col).alias("_id"), F.col("th").alias("_th"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "th").eqNullSafe(F.col("first")).alias("stays")), "simhash-stays")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_th"))
    kept = docs.join(found.where(~F.col("stays")).select("_id", "_th").distinct(), same, "left_anti")
    twice = C.by_workers(found.where("stays").groupBy("_id", "_th").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-twice")
    if twice.isEmpty():
        return kept
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text]))
