"""Ground truth, inventories and logs from files: declared schemas, checks as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import BOX

ELEMENT = f"struct<id:string,type:string,content:string,bbox:struct<x:double,y:double,width:double,height:double,page:int>,polygon:array<array<double>>,metadata:struct<role:string,parent_id:string,owner_id:string,owner_type:string,line_index:int,reading_order:int,source_index:int>>"
GT = f"struct<schema_version:string,reading_order:struct<blocks:array<string>,lines:array<string>>,pages:array<struct<page_number:int,width:double,height:double,containers:array<struct<id:string,type:string,bbox:{BOX},element_count:int,elements:array<{ELEMENT}>>>>>,elements:array<{ELEMENT}>>"
EVENT = "event string, run_id string, artifact_id string, engine string, phase string, started_at string, status string, failed_stage string, error_type string, inference_seconds double, evaluation_seconds double, total_seconds double, metrics string"


def read_gt(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw VARIANT, gt): each file is one document; unknown fields stay in raw. Files that are not JSON have a null raw."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("raw"), F.from_json("value", GT).alias("gt"))


def gt_problems(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, problem): documents that are not JSON, have no pages, or pages without a number or size. A missing version counts as 0.1."""
    page_bad = F.exists(F.coalesce("gt.pages", F.array()), lambda p: p["page_number"].isNull() | (p["width"] <= 0) | (p["height"] <= 0) | p["width"].isNull() | p["height"].isNull())
    version = F.coalesce("gt.schema_version", F.lit("0.1"))
    bad = F.array(F.when(F.col("raw").isNull(), "not_json"), F.when(F.col("raw").isNotNull() & F.col("gt.pages").isNull(), "schema_invalid"), F.when(page_bad, "page_size"), F.when(~version.isin("0.1", "0.2"), "schema_version"))
    return docs.select(key, F.explode(F.array_compact(bad)).alias("problem"))


def text_lines(docs: DataFrame, key: str = "path", page_number: int = 1) -> DataFrame:
    """Text lines of a page in container order: with a box on the page; blank ones and those of table cells stay."""
    pages = docs.select(key, F.explode("gt.pages").alias("p")).where(F.col("p.page_number") == page_number)
    boxes = pages.select(key, F.posexplode("p.containers").alias("c", "container"))
    els = boxes.select(key, "c", F.col("container.id").alias("container_id"), F.posexplode("container.elements").alias("e", "el"))
    lines = els.where((F.col("el.type") == "text_line") & F.col("el.bbox").isNotNull() & (F.coalesce("el.bbox.page", F.lit(page_number)) == page_number))
    from pyspark.sql import Window as W

    return lines.select(key, (F.row_number().over(W.partitionBy(key).orderBy("c", "e")) - 1).alias("gt_index"), F.coalesce("el.id", F.lit("")).alias("id"), "container_id", F.coalesce("el.content", F.lit("")).alias("text"), F.struct(*[F.col(f"el.bbox.{n}").alias(n) for n in ("x", "y", "width", "height")]).alias("bbox"), "el.metadata")


def flat_elements(docs: DataFrame, key: str = "path") -> DataFrame:
    """The flat copy of all elements, for audits."""
    return docs.select(key, F.posexplode("gt.elements").alias("ord", "e")).select(key, "ord", "e.id", "e.type", F.col("e.content").alias("text"), "e.metadata.role", "e.metadata.parent_id", "e.metadata.owner_id", "e.metadata.line_index", "e.metadata.reading_order", F.col("e.bbox.page").alias("page_number"), F.struct(*[F.col(f"e.bbox.{n}").alias(n) for n in ("x", "y", "width", "height")]).alias("bbox"))


def discover(spark: SparkSession, root: str, **only: list[str]) -> DataFrame:
    """Scans under root/language/article/template/noisy/page_N/name_gt.json: path parts as columns, filtered before any file is opened. only: allowed values by column."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_gt.json").load(root).select("path")
    shape = r"([^/]+)/([^/]+)/([^/]+)/noisy/page_(\d+)/([^/]+)_gt\.json$"
    part = lambda i: F.regexp_extract("path", shape, i)
    stem = part(5)
    variant = r"^(.*)_(-?\d+)$"
    out = names.where(F.col("path").rlike(shape)).select("path", part(1).alias("language"), part(2).alias("article"), part(3).alias("template"), part(4).cast("int").alias("page"), F.when(stem.rlike(variant), F.regexp_extract(stem, variant, 1)).otherwise(stem).alias("profile"), F.when(stem.rlike(variant), F.regexp_extract(stem, variant, 2).cast("int")).otherwise(0).alias("variant"))
    for column, values in only.items():
        if values:
            out = out.where(F.col(column).isin(list(values)))
    return out


def image_pairs(spark: SparkSession, artifacts: DataFrame, root: str) -> DataFrame:
    """artifacts with image_path, and a problem where there is none or more than one image beside the ground truth."""
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").where(r"path RLIKE '\\.(png|jpe?g)$'").select(F.regexp_replace("path", r"\.[^.]+$", "").alias("stem"), F.col("path").alias("image_path"))
    found = images.groupBy("stem").agg(F.min("image_path").alias("image_path"), F.count("*").alias("n"))
    joined = artifacts.withColumn("stem", F.regexp_replace("path", r"_gt\.json$", "")).join(found, "stem", "left")
    return joined.withColumn("problem", F.when(F.col("n").isNull(), "image_missing").when(F.col("n") > 1, "image_ambiguous")).drop("stem", "n")


def read_ledger(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
