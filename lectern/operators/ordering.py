"""Reading order: columns, sequences, and pairwise statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import matching as M

#: Units up to which all pairs of a page are compared at once.
SMALL = 128


def assign_columns(lines: DataFrame, columns: Column | int, key: str = "artifact_id") -> DataFrame:
    """lines (with bbox) and their column: the place of their middle between the page's outermost middles, cut into equal parts."""
    n = columns if isinstance(columns, Column) else F.lit(columns)
    page = W.partitionBy(key)
    mid = F.col("bbox.x") + F.col("bbox.width") / 2
    placed = lines.withColumn("_m", mid).withColumn("_lo", F.min("_m").over(page)).withColumn("_w", F.max("_m").over(page) - F.col("_lo"))
    column = F.when((n <= 1) | (F.col("_w") <= 0), 0).otherwise(F.least(n - 1, ((F.col("_m") - F.col("_lo")) / F.when(F.col("_w") > 0, F.col("_w")) * n).cast("int")))
    return placed.withColumn("column", column.cast("int")).drop("_m", "_lo", "_w")


def gt_sequence(lines: DataFrame, key: str = "artifact_id", container: str = "container_id", index: str = "gt_index") -> DataFrame:
    """rank of lines by container, from the top down and left to right; ties by index."""
    w = W.partitionBy(key).orderBy(F.col(container), -F.col("bbox.y"), F.col("bbox.x"), F.col(index))
    return lines.withColumn("rank", F.row_number().over(w))


def predicted_sequence(lines: DataFrame, key: str = "artifact_id", downwards: int = -1, index: str = "pred_index") -> DataFrame:
    """rank of lines by column and height; downwards is -1 where y grows upwards, else 1."""
    w = W.partitionBy(key).orderBy(F.col("column"), downwards * F.col("bbox.y"), F.col("bbox.x"), F.col(index))
    return lines.withColumn("rank", F.row_number().over(w))


def assign_reading_order(elements: DataFrame, doc: str = "artifact_id") -> DataFrame:
    """reading_order from 1 for each role: by source place where there is one, else by geometry; elements without a box or page last."""
    sourced = F.col("source_index").isNotNull()
    place = F.coalesce("flow_order", "line_index", F.lit(0)).cast("double")
    lacking = F.col("bbox").isNull()
    w = W.partitionBy(doc, "role").orderBy(lacking.cast("int"), F.col("page_number"), F.when(sourced, F.col("source_index").cast("double")).otherwise(F.col("bbox.x")), F.when(sourced, place).otherwise(-F.col("bbox.y")), F.col("id"))
    return elements.withColumn("reading_order", F.row_number().over(w))


def page_goes_back(elements: DataFrame, doc: str = "artifact_id") -> DataFrame:
    """Elements whose page lies before that of the element read just before."""
    w = W.partitionBy(doc, "role").orderBy("reading_order")
    return elements.withColumn("previous_page", F.lag("page_number").over(w)).where("page_number < previous_page")


def _count_pairs(groups: np.ndarray, ranks: np.ndarray) -> tuple[int, int]:
    """Pairs of different groups whose ranks rise and fall with the groups, counted half by half, as in a merge sort."""
    order = np.lexsort((ranks, groups))
    groups, ranks = groups[order], ranks[order]
    runs = np.split(ranks, np.flatnonzero(np.diff(groups)) + 1)
    rising = falling = 0
    while len(runs) > 1:
        merged = []
        for left, right in zip(runs[::2], runs[1::2], strict=False):
            rising += int(np.searchsorted(left, right, "left").sum())
            falling += len(left) * len(right) - int(np.searchsorted(left, right, "right").sum())
            merged.append(np.sort(np.concatenate((left, right)), kind="stable"))
        runs = merged + runs[len(runs) - len(runs) % 2 :]
    return rising, falling


def pair_counts(sequence: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Of (key, group, rank), where group is the place in the predicted order and rank the true one: concordant, discordant, unresolved pairs and units.

    Pairs of different groups are compared; pairs within a group are unresolved. A page is a bounded group; its pairs are
    counted in little more than the time to sort it, and never made.
    """
    pages = sequence.groupBy(key).agg(F.collect_list(F.struct(F.col("group").cast("long").alias("group"), F.col("rank").cast("long").alias("rank"))).alias("units"))
    return pages.select(key, page_pairs("units.group", "units.rank").alias("c")).select(key, "c.*")


@F.arrow_udf(StructType([StructField(n, LongType()) for n in ("units", "concordant", "discordant", "unresolved")]))
def page_pairs(groups: pa.Array, ranks: pa.Array) -> pa.Array:
    """pair_counts() of pages' arrays of places in the predicted order and true ranks."""
    out = []
    for gs, rs in zip(groups, ranks, strict=True):
        gs, rs = gs.values, rs.values
        kept = np.flatnonzero((gs.is_valid().to_numpy(zero_copy_only=False)) & rs.is_valid().to_numpy(zero_copy_only=False))
        g, r = gs.fill_null(0).to_numpy(zero_copy_only=False), rs.fill_null(0).to_numpy(zero_copy_only=False)
        n = np.unique(g[gs.is_valid().to_numpy(zero_copy_only=False)], return_counts=True)[1]
        within = int((n * (n - 1) // 2).sum()) + gs.null_count * (gs.null_count - 1) // 2
        g, r = g[kept], r[kept]
        if len(g) <= SMALL:
            before = g[:, None] < g
            both = int((before & (r[:, None] < r)).sum()), int((before & (r[:, None] > r)).sum())
        else:
            both = _count_pairs(g, r)
        out.append((len(gs), *both, within))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["units", "concordant", "discordant", "unresolved"])


def page_ranks(columns: int, downwards: int = -1):
    """Of pages' arrays of indexes and boxes of predictions: their ranks by assign_columns() and predicted_sequence()."""

    def kernel(index: pa.Array, boxes: pa.Array) -> pa.Array:
        offsets = M._offsets(index)
        page, at = M._page(offsets), offsets[:-1][np.diff(offsets) > 0]
        x, y, w, _ = (M._numbers(v) for v in boxes.flatten().flatten())
        mid, i = x + w / 2, M._numbers(index.flatten(), 0)
        if not len(at):
            return M._lists(offsets, pa.array([], pa.int32()))
        there = ~np.isnan(mid)
        low = np.repeat(np.minimum.reduceat(np.where(there, mid, np.inf), at), np.diff(offsets)[np.diff(offsets) > 0])
        wide = np.repeat(np.maximum.reduceat(np.where(there, mid, -np.inf), at), np.diff(offsets)[np.diff(offsets) > 0]) - low
        with np.errstate(invalid="ignore", divide="ignore"):
            column = np.where((columns <= 1) | (wide <= 0), 0, np.where(there, np.minimum(columns - 1, np.nan_to_num((mid - low) / wide * columns).astype(np.int64)), columns - 1))
        first = lambda v: np.where(np.isnan(v), -np.inf, v)
        order = np.lexsort((i, first(x), first(downwards * y), column, page))
        rank = np.empty(len(page), np.int64)
        rank[order] = np.arange(len(page)) - offsets[:-1][page[order]] + 1
        return M._lists(offsets, pa.array(rank, pa.int32()))

    return F.arrow_udf(kernel, ArrayType(IntegerType()))


def order_statistics(counts: DataFrame) -> DataFrame:
    """Adds kendall_tau, pairwise_accuracy (null without pairs) and coverage (0 without)."""
    c, d = F.col("concordant"), F.col("discordant")
    pairs, possible = c + d, F.expr("units * (units - 1) div 2")
    return counts.withColumn("kendall_tau", F.try_divide(c - d, pairs)).withColumn("pairwise_accuracy", F.try_divide(c, pairs)).withColumn("coverage", F.coalesce(F.try_divide(pairs, possible), F.lit(0.0)))


def duplicate_ids(sequence: DataFrame, id_col: str = "id", key: str = "artifact_id") -> DataFrame:
    """Ids named more than once on a page; order statistics are undefined for such pages."""
    return sequence.groupBy(key, id_col).agg(F.count("*").alias("n")).where("n > 1")


def token_bags(pairs: DataFrame, gt: Column, predicted: Column, key: str) -> DataFrame:
    """Multiset precision, recall and F1 of the words of two texts; denominators are at least 1."""
    from ..functions.text import normalize_text, tokens

    side = lambda c, name: pairs.select(key, F.explode(tokens(normalize_text(c))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))
    both = side(gt, "a").join(side(predicted, "b"), [key, "w"], "full_outer").groupBy(key).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("common"), F.coalesce(F.sum("a"), F.lit(0)).alias("gt_tokens"), F.coalesce(F.sum("b"), F.lit(0)).alias("predicted_tokens"))
    one = F.lit(1)
    rated = both.withColumn("token_precision", F.col("common") / F.greatest(one, "predicted_tokens")).withColumn("token_recall", F.col("common") / F.greatest(one, "gt_tokens"))
    p, r = F.col("token_precision"), F.col("token_recall")
    return rated.withColumn("token_f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
