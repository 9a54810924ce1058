"""Recognition quality: page metrics from matched lines, and pooled rates from their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching as M

COUNTS = ["char_errors", "word_errors", "gt_char_count", "gt_word_count", "num_gt_lines", "num_predicted_lines", "num_matched_lines"]


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def mean_in_order(values: Column) -> Column:
    """Mean of an array of doubles added from first to last; nulls don't count, and none is null."""
    there = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, v: s + v), F.size(there))


def page_metrics_of(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each page of gt (gt_index, text), predicted (pred_index, text) and found (at, iou, free): counts, macro rates over lines of gt, and micro rates that count insertions.

    Macro rates are added over lines that were found, then those missed, each by gt_index, so they don't depend on how rows are
    dealt out: the last bit of a sum of doubles decides to which side a mean is rounded that lies half way, such as 79 / 640.
    DuckDB mostly adds in this order after a left join; it is nearer to the SQL than line order. A page is a bounded group by
    nature, and its row has all that is asked for.
    """
    one, words = F.lit(1), lambda c: F.size(T.tokens(c))
    get = lambda name, i: F.get(F.col(f"found.{name}"), i)
    texts = F.transform("gt", lambda r, i: F.struct(get("at", i).isNull().alias("missed"), r["gt_index"], get("iou", i).alias("iou"), T.normalize_text(r["text"]).alias("a"), T.normalize_text(F.get("predicted", get("at", i))["text"]).alias("b")))

    def apart(s: Column) -> Column:
        a, b = s["a"], s["b"]
        differ = F.struct(T.distance(a, b).alias("ce"), T.word_distance(T.tokens(a), T.tokens(b)).alias("we"))
        nothing = F.struct(F.lit(0).alias("ce"), F.lit(0).alias("we"))
        return F.struct(s.alias("s"), F.when(a == b, nothing).otherwise(differ).alias("d"), F.length(a).alias("cc"), words(a).alias("wc"))

    rated = lambda r: F.struct(r["s"]["missed"].alias("missed"), r["s"]["gt_index"].alias("gt_index"), (r["d"]["ce"] / F.greatest(one, r["cc"])).alias("cer"), (r["d"]["we"] / F.greatest(one, r["wc"])).alias("wer"), r["s"]["iou"].alias("iou"), r["d"]["ce"].alias("ce"), r["d"]["we"].alias("we"), r["cc"].alias("cc"), r["wc"].alias("wc"))
    spare = F.transform(F.filter("predicted", lambda _, i: F.get(F.col("found.free"), i)), lambda r: T.normalize_text(r["text"]))
    # generators of one row, so that arrays are made once and not in each use
    once = lambda c: F.explode(F.array(c))
    made = pages.select(*keep, F.size("gt").alias("n"), F.size("predicted").alias("m"), spare.alias("spare"), once(F.sort_array(F.transform(F.transform(texts, apart), rated))).alias("lines"))
    total = lambda c, of="lines": F.aggregate(of, F.lit(0).cast("long"), lambda s, r: s + c(r))
    count = lambda n: F.greatest(F.lit(0), n).cast("long")
    mean = lambda c: F.coalesce(mean_in_order(F.col("lines")[c]), F.lit(0.0)).alias("mean_" + c)
    sums = made.select(*keep, "spare", count(F.col("n")).alias("num_gt_lines"), total(lambda r: (~r["missed"]).cast("int")).alias("num_matched_lines"), *[total(lambda r, c=c: r[c]).alias(n) for c, n in (("ce", "_ce"), ("we", "_we"), ("cc", "gt_char_count"), ("wc", "gt_word_count"))], *map(mean, ("cer", "wer", "iou")), count(F.col("m")).alias("num_predicted_lines"))
    out = sums.select(*keep, "num_gt_lines", "num_matched_lines", "gt_char_count", "gt_word_count", "mean_cer", "mean_wer", "mean_iou", "num_predicted_lines", (F.col("_ce") + total(F.length, "spare")).alias("char_errors"), (F.col("_we") + total(words, "spare")).alias("word_errors"))
    out = out.withColumn("false_positives", F.col("num_predicted_lines") - F.col("num_matched_lines")).withColumn("false_negatives", F.col("num_gt_lines") - F.col("num_matched_lines"))
    return rates(out)


def page_metrics(gt: DataFrame, predicted: DataFrame, matches: DataFrame, key: str = "artifact_id") -> DataFrame:
    """page_metrics_of() over rows: gt (key, gt_index, text), predicted (key, pred_index, text) and the matches (key, gt_index, pred_index or null, iou) of all of gt."""
    paired = gt.select(key, "gt_index", "text").hint("merge").join(matches.select(key, "gt_index", "pred_index", "iou"), [key, "gt_index"])
    pages = M.gather(paired, predicted.select(key, "pred_index", "text"), key, "full_outer")
    return page_metrics_of(M.found_by_index(pages), key)


def rates(df: DataFrame, strict: bool = False, prefix: str = "") -> DataFrame:
    """Micro and line rates of the counts; strict leaves a rate of a zero denominator null, else errors are over at least 1 and shares are 0."""
    share = (lambda a, b: F.try_divide(a, b)) if strict else (lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    over = (lambda a, b: F.try_divide(a, b)) if strict else (lambda a, b: a / F.greatest(F.lit(1), b))
    c = F.col
    out = df.withColumn(prefix + "micro_cer", over(c("char_errors"), c("gt_char_count"))).withColumn(prefix + "micro_wer", over(c("word_errors"), c("gt_word_count")))
    out = out.withColumn(prefix + "line_precision", share(c("num_matched_lines"), c("num_predicted_lines"))).withColumn(prefix + "line_recall", share(c("num_matched_lines"), c("num_gt_lines")))
    p, r = c(prefix + "line_precision"), c(prefix + "line_recall")
    f = f1(p, r)
    return out.withColumn(prefix + "line_f1", F.when(p.isNull() | r.isNull(), None).otherwise(f) if strict else f)


def pooled(pages: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """Sums of the counts for each group, and rates of the sums; all rates are null where a count is missing in any row."""
    missing = F.bool_or(sum((F.col(c).isNull().cast("int") for c in COUNTS), F.lit(0)) > 0)
    summed = pages.groupBy(*by).agg(F.count("*").alias("num_pages"), missing.alias("_missing"), *[F.sum(c).alias(c) for c in COUNTS])
    rated = rates(summed, strict)
    return rated.select(*by, "num_pages", *COUNTS, *[F.when(~F.col("_missing"), F.col(c)).alias(c) for c in ("micro_cer", "micro_wer", "line_precision", "line_recall", "line_f1")])
