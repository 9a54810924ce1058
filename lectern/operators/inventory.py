"""Inventory of artifacts: record rules, consistency, families, paired pages, plans and reviews, as rows of problems or results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a development review must decide on.
REVIEW_CATEGORIES = ["source_rights", "source_families", "font_asset_rights", "evaluation_protocol", "noise_severity"]


def _codes(*rules: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds; a null condition does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), code) for when, code in rules]))


def safe_path(path: Column) -> Column:
    """Whether a path is relative, stays inside its root and has neither backslashes nor colons."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.coalesce(~path.startswith("/") & ~path.contains("\\") & ~path.contains(":") & (F.size(steps) > 0) & ~F.array_contains(steps, ".."), F.lit(False))


def record_problems(records: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(key, problem) of inventory records that may not be accepted.

    records: profile and variant of the file name and of the metadata (profile, variant, meta_profile, meta_variant), unit, origin,
    n_pages, page_number, transform, whether the source page is in the page's ground truth (source_page), and sizes as
    struct<width, height>: image, coordinates, declared, page.
    """
    image = F.col("image")
    sizes = F.lit(False)
    for name in ("coordinates", "declared", "page"):
        sizes = sizes | ~image.eqNullSafe(F.col(name))
    c = F.col
    found = _codes(
        (c("profile").isNull() | (c("profile") == "") | c("variant").isNull(), "file_name"),
        (~c("profile").eqNullSafe(c("meta_profile")) | ~c("variant").eqNullSafe(c("meta_variant")), "profile_variant"),
        (~c("source_page"), "source_page"),
        (~c("unit").eqNullSafe(F.lit("pixels")) | ~c("origin").eqNullSafe(F.lit("top-left")), "coordinates"),
        (~c("n_pages").eqNullSafe(F.lit(1)) | ~c("page_number").eqNullSafe(F.lit(1)), "single_page"),
        (sizes, "image_size"),
        (~c("transform").eqNullSafe(F.lit("affine")), "transform"),
    )
    return records.select(key, F.explode(found).alias("problem"))


def manifest_problems(records: DataFrame, issues: DataFrame, discovered: int, plan: DataFrame | None = None) -> DataFrame:
    """(artifact_id or null, problem): discovered is not accepted plus rejected, ids repeat, or records disagree with the split plan.

    records (artifact_id, language, article_id, source_sha256, source_family, split, family_assignment); plan (language,
    article_id, source_sha256, family_id, split). Without a plan every record is unassigned.
    """
    none = F.lit(None).cast("string").alias("artifact_id")
    counted = records.select(F.lit(1).alias("n")).unionAll(issues.select(F.lit(1).alias("n"))).agg(F.count("*").alias("n"))
    out = counted.where(F.col("n") != discovered).select(none, F.lit("discovery_count").alias("problem"))
    twice = records.groupBy("artifact_id").agg(F.count("*").alias("n")).where("n > 1").select("artifact_id", F.lit("duplicate_artifact").alias("problem"))
    if plan is None:
        wrong = records.where("split <> 'unassigned' OR family_assignment <> 'inferred_from_article_id'").select("artifact_id", F.lit("assignment_without_plan").alias("problem"))
    else:
        wanted = plan.select("language", "article_id", "source_sha256", F.col("family_id").alias("_family"), F.col("split").alias("_split"))
        same = F.col("source_family").eqNullSafe(F.col("_family")) & F.col("split").eqNullSafe(F.col("_split")) & (F.col("family_assignment") == "reviewed_catalog")
        wrong = records.join(wanted, ["language", "article_id", "source_sha256"], "left").where(~same).select("artifact_id", F.lit("split_plan").alias("problem"))
    return out.unionByName(twice).unionByName(wrong)


def family_catalogue(records: DataFrame) -> DataFrame:
    """(family_id, n_members, members): distinct sources (language, article_id, source_sha256) of each article, in order."""
    member = F.struct("language", "article_id", "source_sha256")
    return records.groupBy(F.col("article_id").alias("family_id")).agg(F.sort_array(F.collect_set(member)).alias("members")).select("family_id", F.size("members").cast("long").alias("n_members"), "members")


def complete_groups(records: DataFrame, page: list[str], profiles: list[str], variant: int = 0) -> DataFrame:
    """(page..., complete): base pages and whether they have each of the profiles exactly once at the variant; one that lacks some is never silently used."""
    chosen = records.where((F.col("variant") == variant) & F.col("profile").isin(profiles))
    wanted = F.array(*map(F.lit, sorted(profiles)))
    return chosen.groupBy(*page).agg((F.sort_array(F.collect_list("profile")) == wanted).alias("complete"))


def review_problems(decisions: DataFrame) -> DataFrame:
    """(category, unit_id, problem) of review decisions (category, unit_id, status): missing categories, repeated units, and what is not accepted."""
    none = F.lit(None).cast("string").alias("unit_id")
    wanted = decisions.sparkSession.createDataFrame([(c,) for c in REVIEW_CATEGORIES], "category string")
    missing = wanted.join(decisions.select("category").distinct(), "category", "left_anti").select("category", none, F.lit("category_missing").alias("problem"))
    unknown = decisions.where(~F.col("category").isin(REVIEW_CATEGORIES)).select("category", "unit_id", F.lit("category_unknown").alias("problem"))
    twice = decisions.groupBy("category", "unit_id").agg(F.count("*").alias("n")).where("n > 1").select("category", "unit_id", F.lit("duplicate_unit").alias("problem"))
    open_ = decisions.where("status IS NULL OR status <> 'accepted'").select("category", "unit_id", F.lit("not_accepted").alias("problem"))
    return missing.unionByName(unknown).unionByName(twice).unionByName(open_)


def disagreeing_dependencies(uses: DataFrame) -> DataFrame:
    """Paths that several artifacts share (path, sha256) with different contents."""
    return uses.groupBy("path").agg(F.count_distinct("sha256").alias("versions")).where("versions > 1")


def reusable(pages: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """pages (key, sha256 of the input) against cached results (key, sha256, status): whether a result may be used again, and why not."""
    have = cached.select(*key, F.col("sha256").alias("_sha"), F.col("status").alias("_status"))
    why = F.when(F.col("_status").isNull(), "not_cached").when(F.col("_status") != "success", "not_successful").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "input_changed")
    return pages.join(have, key, "left").select(*key, why.isNull().alias("reusable"), why.alias("reason"))


def page_scope(n_pages: Column, scope: Column) -> Column:
    """Pages of a document for the scopes first, half (rounded up, at least one) and all."""
    last = F.when(scope == "first", F.lit(1)).when(scope == "half", F.greatest(F.lit(1), F.expr("1") * F.floor((n_pages + 1) / 2).cast("int"))).when(scope == "all", n_pages)
    return F.when(n_pages >= 1, F.sequence(F.lit(1), F.least(last, n_pages))).otherwise(F.array().cast("array<int>"))


def condition_grid(profiles: Column, variants: Column, clean: str = "clean") -> Column:
    """Array of (profile, variant) that are asked for: the clean profile has one variant."""
    return F.flatten(F.transform(profiles, lambda p: F.transform(F.sequence(F.lit(0), F.when(p == clean, 0).otherwise(F.greatest(F.lit(1), variants) - 1)), lambda v: F.struct(p.alias("profile"), v.alias("variant")))))


def target_counts(specs: DataFrame) -> DataFrame:
    """Of specs (languages, articles_per_language, templates, pages_per_document, conditions, variants_per_noisy_condition): how much they ask for."""
    clean = F.array_contains("conditions", "clean").cast("int")
    noisy = F.size("conditions") - clean
    out = specs.withColumn("source_documents", F.size("languages") * F.col("articles_per_language"))
    out = out.withColumn("rendered_documents", F.col("source_documents") * F.size("templates"))
    out = out.withColumn("base_pages", F.col("rendered_documents") * F.col("pages_per_document"))
    return out.withColumn("images", F.col("base_pages") * (clean + noisy * F.col("variants_per_noisy_condition")))


def repool_differences(saved: DataFrame, pages: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """(by, column, saved, pooled) where saved sums differ from the sums of the pages they were made from; groups of one side only differ too."""
    again = pages.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    both = saved.select(*by, *counts).join(again, by, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("saved"), F.col(f"_{c}").cast("long").alias("pooled")) for c in counts])
    return both.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").where(~F.col("saved").eqNullSafe(F.col("pooled")))


def top_tables(tables: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n richest tables: most merged cells, then rows, then columns, then in order of the other columns."""
    return tables.orderBy(F.desc("merged_cells"), F.desc("rows"), F.desc("columns"), *by).limit(n)
