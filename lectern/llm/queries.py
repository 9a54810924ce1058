"""The queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of op1: verdict, host and path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: A supplied table of op1: labels of host names that seed distrust. Another corpus brings its own (see url_graph.judge's blocklist).
BLOCKED_LABELS = ["casino-win", "free-bets", "spam-farm", "ads-track", "cheap-pills", "adult-x"]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of trust are hosts with a page that a rule allows. Seeds of distrust are hosts of which rules block every page
    and those of pages or links with one of BLOCKED_LABELS among their labels, subdomains included.

    The labels are the six hyphenated ones of the page hosts at sf0.1: gambling, bets, spam, advertising, pills and adult
    content. Other hosts of the kind are found by their links only.
    """
    from . import url_graph

    blocked = F.col("barred") | F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, BLOCKED_LABELS)))
    found = url_graph.judge(_table(spark, sf_dir, "pages"), URL_RULES, F.col("ruled"), blocked)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    folder = media.store(_table(spark, sf_dir, "documents"))
    return media.features(media.load(spark, folder))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_lm

    return ngram_lm.fit_and_score(_table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.round("dice", 6).alias("dice"), F.array_join("licences", ",").alias("licences"), F.size("units").cast("long").alias("n_units"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    found = quality.quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wordpiece

    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    records = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", F.length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_media_columns, op3_simhash_near_dedup, op4_lm_scoring, op5_license_scans, op6_source_mixing, op7_quality_rules, op8_packing, op9_token_counts, op10_warc_derivatives, pipeline)}
ORACLES: dict[str, str] = {}
