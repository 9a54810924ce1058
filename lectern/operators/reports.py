"""Grouped reports: summaries, chart series, calibration curves, run and inventory summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import quality as Q

CURVES = {"micro_cer": ("char_errors", "gt_char_count"), "micro_wer": ("word_errors", "gt_word_count"), "line_precision": ("num_matched_lines", "num_predicted_lines"), "line_recall": ("num_matched_lines", "num_gt_lines")}


def summary(pages: DataFrame, by: list[str], means: list[str], distinct: str, strict: bool = False) -> DataFrame:
    """Pooled rates of each group with null-skipping means of page metrics and the number of distinct sources."""
    other = pages.groupBy(*by).agg(F.count_distinct(distinct).alias(f"num_{distinct}"), *[F.avg(c).alias(f"avg_{c}") for c in means])
    return Q.pooled(pages, by, strict).join(other, by)


def chart_series(pages: DataFrame, dimension: str, series: str, metrics: list[str]) -> DataFrame:
    """Long rows (panel, x, series, y): the mean of each metric over the pages of each pair of values."""
    wide = pages.groupBy(dimension, series).agg(*[F.avg(m).alias(m) for m in metrics])
    return wide.unpivot([dimension, series], metrics, "panel", "y").select("panel", F.col(dimension).alias("x"), F.col(series).alias("series"), "y")


def preferred_rank(value: Column, first: list[str]) -> Column:
    """Sort key that puts the given values first, in their order."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for i, v in enumerate(first) for x in (F.lit(v), F.lit(i))]), value), F.lit(len(first)))


def pair_conditions(pages: DataFrame, conditions: DataFrame, results: DataFrame, page: str = "page_id", clean: str = "clean") -> DataFrame:
    """Every page under every condition (condition, operation, level) beside its clean result; paired where both have counts.

    The conditions are a plan's list, a few rows, so pages times conditions is what is asked for.
    """
    grid = pages.select("*", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in conditions.collect()])).alias("_c")).select(*pages.columns, "_c.*")
    have = results.select(page, "profile", F.struct(*Q.COUNTS).alias("m"))
    noisy = have.withColumnRenamed("profile", "condition").withColumnRenamed("m", "noisy")
    base = have.where(F.col("profile") == clean).select(page, F.col("m").alias("clean"))
    return grid.join(noisy, [page, "condition"], "left").join(base, page, "left").withColumn("paired", F.col("noisy").isNotNull() & F.col("clean").isNotNull())


def unequal_denominators(pairs: DataFrame, page: str = "page_id") -> DataFrame:
    """Pairs whose ground truth differs between clean and noisy: there should be none."""
    return pairs.where("paired").where("noisy.gt_char_count <> clean.gt_char_count OR noisy.gt_word_count <> clean.gt_word_count OR noisy.num_gt_lines <> clean.num_gt_lines").select(page, "condition")


def complete_cohort(pairs: DataFrame, page: str = "page_id") -> DataFrame:
    """Pairs of those pages that are paired under all conditions of an operation."""
    return pairs.withColumn("complete", F.bool_and("paired").over(W.partitionBy("operation", page))).where("complete")


def calibration_curves(pairs: DataFrame, page: str = "page_id") -> DataFrame:
    """Clean, noisy and delta of the pooled metrics for (operation, level), overall, by language and by template, over complete cohorts."""
    cohort = complete_cohort(pairs, page)
    sums = [F.sum(f"{side}.{c}").alias(f"{side}_{c}") for side in ("clean", "noisy") for c in Q.COUNTS]
    sets = [["operation", "level"], ["operation", "level", "language"], ["operation", "level", "template"]]
    every = ["operation", "level", "language", "template"]
    out = cohort.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.grouping_id().alias("g"), F.count("*").alias("num_pairs"), *sums)
    out = out.withColumn("scope", F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, F.concat(F.lit("language:"), "language")).otherwise(F.concat(F.lit("template:"), "template")))
    shown = []
    for name, (a, b) in CURVES.items():
        c, n = F.try_divide(f"clean_{a}", f"clean_{b}"), F.try_divide(f"noisy_{a}", f"noisy_{b}")
        shown += [c.alias(f"clean_{name}"), n.alias(f"noisy_{name}"), (n - c).alias(f"delta_{name}")]
    return out.select("scope", "operation", "level", "num_pairs", *shown)


def run_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Of a ledger (status, phase, inference_seconds, total_seconds): statuses, success rate, throughput, and times of later successful calls."""
    ok = F.col("status") == "success"
    later = F.when(ok & (F.col("phase") == "subsequent_call"), F.col("inference_seconds"))
    statuses = ["success", "failed", "timeout", "worker_failed", "not_run"]
    out = results.groupBy(*by).agg(F.count("*").alias("planned"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses], F.avg(later).alias("mean_later"), F.median(later).alias("median_later"), F.max(F.when(F.col("phase") == "first_call", F.col("inference_seconds"))).alias("first_call"), F.sum("total_seconds").alias("seconds"))
    return out.withColumn("success_rate", F.try_divide("n_success", "planned")).withColumn("per_minute", F.try_divide(60 * F.col("n_success"), F.col("seconds")))


def inventory_summary(records: DataFrame, columns: list[str], gaps: str = "gaps") -> DataFrame:
    """Counters (dimension, value, n) over several columns and the exploded list of gaps, from one scan."""
    pairs = F.concat(*[F.array(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))) for c in columns], F.transform(F.coalesce(F.col(gaps), F.array().cast("array<string>")), lambda g: F.struct(F.lit("gap").alias("dimension"), g.alias("value"))))
    return records.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def audit_rollup(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Errors and warnings, review statuses, and the share of defects among the reviewed, null if none is."""
    f = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.max("error_px").alias("max_error"))
    r = reviews.agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "defect").alias("defects"), F.count_if(F.col("status") == "pending").alias("pending"))
    return f.join(r, F.lit(True)).withColumn("defect_rate", F.try_divide("defects", F.col("accepted") + F.col("defects")))
