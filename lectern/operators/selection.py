"""Plans: stratified selection, splits, ledgers, integrity of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_rank(seed: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


def round_robin(pages: DataFrame, strata: list[str], rank: Column, most: int | None = None) -> DataFrame:
    """Pages in the order in which taking one of each stratum in turn finds them; position from 1."""
    placed = pages.withColumn("_h", rank).withColumn("turn", F.row_number().over(W.partitionBy(*strata).orderBy("_h")))
    if most is None:
        return placed.drop("_h")
    # a later turn has `most` pages of its own stratum before it; the limit on turns is applied before the shuffle
    return placed.where(F.col("turn") <= most).orderBy("turn", *strata, "_h").limit(most).drop("_h")


def cycle(pages: DataFrame, language: str, template: str, language_index: Column, template_index: Column, n_templates: int, rank: Column, per_language: int) -> DataFrame:
    """The first pages of each language, templates in turn, each language starting with another template."""
    placed = pages.withColumn("_h", rank).withColumn("turn", F.row_number().over(W.partitionBy(language, template).orderBy("_h"))).where(F.col("turn") <= per_language)
    inner = W.partitionBy(language).orderBy("turn", F.pmod(template_index - language_index, F.lit(n_templates)), "_h")
    return placed.withColumn("pick", F.row_number().over(inner)).where(F.col("pick") <= per_language).drop("_h")


def first_per(pages: DataFrame, by: list[str], order: list[str], k: int = 1) -> DataFrame:
    return pages.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def split_families(families: DataFrame, seed: str, share: float, family: str = "family") -> DataFrame:
    """dev for the first families by hash, at least one and not all; test for the others. A family is one row, so the windows hold a catalogue, not documents."""
    whole = W.partitionBy(F.lit(1))
    ranked = families.withColumn("_r", F.row_number().over(whole.orderBy(hash_rank(seed, family), family))).withColumn("_n", F.count("*").over(whole))
    n_dev = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.ceil(F.col("_n") * share)))
    return ranked.withColumn("split", F.when(F.col("_r") <= n_dev, "dev").otherwise("test")).drop("_r", "_n")


def leaking_signals(members: DataFrame, family: str, signals: list[str]) -> DataFrame:
    """Signals that more than one family owns: (signal, value, families). Blank and null ones do not count."""
    long = members.select(family, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("string").alias("value")) for s in signals])).alias("s"))
    return long.where("s.value IS NOT NULL AND s.value <> ''").groupBy("s.signal", "s.value").agg(F.count_distinct(family).alias("families")).where("families > 1")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def verify_fingerprints(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, problem): recorded (path, sha256, size) that are missing or differ among the observed. Equal records are checked once."""
    want = recorded.select("path", "sha256", "size").distinct()
    have = observed.select("path", F.col("sha256").alias("found_sha"), F.col("size").alias("found_size"))
    problem = F.when(F.col("found_sha").isNull(), "missing").when(F.col("found_size") != F.col("size"), "size").when(F.col("found_sha") != F.col("sha256"), "sha256")
    return want.join(have, "path", "left").withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")


def membership(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): missing ones of the expected, extra ones of the actual."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, keys, "left_anti").withColumn("side", F.lit("extra")))


def gap_algebra(records: DataFrame, all_gaps: list[str], closed: str = "closed", added: str = "added") -> DataFrame:
    """gaps: all, without the closed ones, with the added ones, sorted."""
    start = F.array(*map(F.lit, all_gaps))
    return records.withColumn("gaps", F.array_sort(F.array_union(F.array_except(start, F.col(closed)), F.col(added))))


def ledger(selection: DataFrame, starts: DataFrame, results: DataFrame, worker_timed_out: DataFrame, key: str = "artifact_id", run: str = "run_id") -> DataFrame:
    """One row for each selected artifact: its last result's status, else timeout or worker_failed if it was started, else not_run."""
    last = results.groupBy(run, key).agg(F.max_by(F.struct("status", "inference_seconds", "total_seconds", "phase"), "ord").alias("r"))
    began = starts.select(run, key).distinct().withColumn("began", F.lit(True))
    late = worker_timed_out.select(run).distinct().withColumn("late", F.lit(True))
    joined = selection.join(last, [run, key], "left").join(began, [run, key], "left").join(late, run, "left")
    status = F.coalesce("r.status", F.when(F.col("began").isNull(), "not_run").when(F.col("late"), "timeout").otherwise("worker_failed"))
    return joined.select(*selection.columns, status.alias("status"), "r.inference_seconds", "r.total_seconds", "r.phase")


def call_phase(events: DataFrame, session: str, order: str) -> DataFrame:
    first = F.row_number().over(W.partitionBy(session).orderBy(order)) == 1
    return events.withColumn("phase", F.when(first, "first_call").otherwise("subsequent_call"))


def conditions(sweeps: DataFrame, repeated: str = "sensor_noise") -> DataFrame:
    """Sweeps (operation, levels, repeats) as conditions cal_{operation}_l{level}_r{repeat}; only sensor noise is repeated."""
    n = F.when(F.col("operation") == repeated, F.col("repeats")).otherwise(1)
    long = sweeps.select("operation", F.posexplode("levels").alias("i", "value"), n.alias("n")).select("operation", (F.col("i") + 1).alias("level"), "value", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("repeat"))
    return long.withColumn("condition", F.format_string("cal_%s_l%d_r%d", "operation", "level", "repeat"))


def sweep_problems(sweeps: DataFrame, descending: list[str]) -> DataFrame:
    """(operation, problem) of sweeps whose levels are not 2 to 7, repeat, or do not get stronger."""
    down = F.col("operation").isin(descending)
    steps = F.zip_with(F.slice("levels", 1, F.size("levels") - 1), F.slice("levels", 2, F.size("levels")), lambda a, b: b - a)
    bad = F.array(
        F.when(~F.size("levels").between(2, 7), "level_count"),
        F.when(F.size(F.array_distinct("levels")) < F.size("levels"), "repeated_level"),
        F.when(F.exists(steps, lambda d: F.when(down, d >= 0).otherwise(d <= 0)), "level_order"),
    )
    return sweeps.select("operation", F.explode(F.array_compact(bad)).alias("problem"))


def table_slots(cells: DataFrame, key: list[str]) -> DataFrame:
    """Slots of a table that more than one cell covers: cells (key, id, row, col, rowspan, colspan)."""
    rows = F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)
    slots = cells.select(*key, "id", F.explode(rows).alias("r"), cols.alias("cs")).select(*key, "id", "r", F.explode("cs").alias("c"))
    return slots.groupBy(*key, "r", "c").agg(F.count("*").alias("n")).where("n > 1")


def excerpt(items: DataFrame, doc: str, most_chars: int, most_items: int, kinds: list[str]) -> DataFrame:
    """The first text items of each document that are not blank, cut to so many characters at the last space."""
    from ..functions.text import normalize_text

    real = items.where(F.col("type").isin(kinds) & (normalize_text(F.col("text")) != ""))
    ranked = real.withColumn("n", F.row_number().over(W.partitionBy(doc).orderBy("pos"))).where(F.col("n") <= most_items)
    cut = F.when(F.length("text") > most_chars, F.regexp_replace(F.substring("text", 1, most_chars), " [^ ]*$", "")).otherwise(F.col("text"))
    return ranked.select(doc, "n", "pos", cut.alias("text"))
