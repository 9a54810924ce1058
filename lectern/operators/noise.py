"""Noise as tables: seeds of artifacts and of their operations, maps that operations add up to, and rules for traces and recipes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What the identity of a seed begins with, so that different makers' seeds differ; to check another maker's traces, pass theirs.
DOMAIN = "lectern-noise-v1"
#: Operations with the numbers that a recipe may state, and their bounds.
PARAMETERS = {
    "reduce_resolution": {"scale": (0.0, 1.0)}, "random_affine": {"angle_degrees": (-45.0, 45.0), "shear": (-1.0, 1.0)}, "illumination_gradient": {"strength": (0.0, 1.0)}, "ink_morphology": {"kernel": (1.0, 15.0)},
    "jpeg_artifacts": {"quality": (1.0, 100.0)}, "defocus_blur": {"radius": (0.0, 50.0)}, "motion_blur": {"length": (1.0, 99.0), "angle_degrees": (-180.0, 180.0)}, "sensor_noise": {"sigma": (0.0, 255.0)},
    "faded_ink": {"strength": (0.0, 1.0)}, "local_shadow": {"strength": (0.0, 1.0)}, "bleed_through": {"strength": (0.0, 1.0)},
}


def seed_of(parts: Column, domain: str = DOMAIN) -> Column:
    """SHA-256 of the JSON array of the domain and of values that are given as their JSON."""
    return F.sha2(F.concat(F.lit("[" + json.dumps(domain) + ","), F.array_join(parts, ","), F.lit("]")), 256)


def json_text(value: Column) -> Column:
    """A number or an ASCII text as JSON."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def operation_seeds(traces: DataFrame, key: str = "artifact_id", domain: str = DOMAIN) -> DataFrame:
    """Of artifacts (key, artifact_seed, operations: array of names in order): (key, pos, name, occurrence, seed). Equal names are told apart by how often they came before."""
    each = traces.select(key, "artifact_seed", F.posexplode("operations").alias("pos", "name"))
    counted = each.withColumn("occurrence", F.row_number().over(W.partitionBy(key, "name").orderBy("pos")) - 1)
    return counted.select(key, "pos", "name", "occurrence", seed_of(F.array(json_text(F.col("artifact_seed")), json_text(F.col("name")), F.col("occurrence").cast("string")), domain).alias("seed"))


def cumulative_matrix(matrices: Column) -> Column:
    """Product of maps (arrays of six numbers, applied in order)."""
    g = lambda m, i: F.get(m, F.lit(i))
    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])

    def after(a: Column, b: Column) -> Column:  # b applied to what a gives
        row = lambda i: [g(b, i) * g(a, 0) + g(b, i + 1) * g(a, 3), g(b, i) * g(a, 1) + g(b, i + 1) * g(a, 4), g(b, i) * g(a, 2) + g(b, i + 1) * g(a, 5) + g(b, i + 2)]
        return F.array(*row(0), *row(3))

    return F.aggregate(matrices, one, after)


def trace_problems(traces: DataFrame, profiles: DataFrame, key: str = "artifact_id", clean: str = "clean", domain: str = DOMAIN) -> DataFrame:
    """(key, problem) of noise traces.

    traces (key, master_seed, identity: array of JSON texts, artifact_seed, profile, variant, encoding, raster_sha256,
    processed_sha256, operations: array<struct<name, seed>>); profiles (profile, expected: names in order, expected_encoding).
    """
    known = profiles.select("profile", "expected", "expected_encoding")
    t = traces.join(known, "profile", "left")
    own = seed_of(F.concat(F.array(json_text(F.col("master_seed"))), F.col("identity")), domain)
    names = F.transform("operations", lambda o: o["name"])
    seeded = operation_seeds(traces.select(key, "artifact_seed", names.alias("operations")), key, domain)
    stated = traces.select(key, F.posexplode("operations").alias("pos", "o")).select(key, "pos", F.col("o.seed").alias("stated"))
    off = seeded.join(stated, [key, "pos"]).where(~F.col("seed").eqNullSafe(F.col("stated"))).select(key, F.lit("operation_seed").alias("problem")).distinct()
    untouched = (F.col("variant") == 0) & (F.col("encoding") == "PNG") & F.col("processed_sha256").eqNullSafe(F.col("raster_sha256"))
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), name)
    is_clean = F.col("profile") == clean
    rules = F.array(
        code(F.col("expected").isNull(), "unknown_profile"), code(~F.col("own").eqNullSafe(F.col("artifact_seed")), "artifact_seed"), code(F.col("expected").isNotNull() & (names != F.col("expected")), "operations"),
        code(is_clean & ~untouched, "clean_control"), code(~is_clean & F.col("expected_encoding").isNotNull() & (F.col("encoding") != F.col("expected_encoding")), "encoding"),
    )
    return t.withColumn("own", own).select(key, F.explode(F.array_compact(rules)).alias("problem")).unionByName(off)


def recipe_problems(steps: DataFrame, built_in: list[str]) -> DataFrame:
    """(profile, problem) of recipes, rows (profile, name, parameters as map<string, double>): unsafe or built-in names, unknown operations and parameters, values out of bounds."""
    bounds = F.create_map(*[F.lit(x) for op, ps in PARAMETERS.items() for p, (lo, hi) in ps.items() for x in (f"{op}.{p}", f"{lo}:{hi}")])
    known = F.col("name").isin(list(PARAMETERS))
    of = lambda k: F.try_element_at(bounds, F.concat("name", F.lit("."), k))
    given = F.coalesce(F.map_entries("parameters"), F.array().cast("array<struct<key:string,value:double>>"))
    stranger = F.exists(given, lambda e: of(e["key"]).isNull())
    outside = F.exists(given, lambda e: F.coalesce(~e["value"].between(F.split(of(e["key"]), ":")[0].cast("double"), F.split(of(e["key"]), ":")[1].cast("double")), of(e["key"]).isNotNull()))
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), name)
    rules = F.array(code(~F.col("profile").rlike("^[a-z][a-z0-9_]{0,63}$"), "profile_name"), code(F.col("profile").isin(built_in), "built_in_profile"), code(~known, "unknown_operation"), code(known & stranger, "unknown_parameter"), code(known & outside, "parameter_bounds"))
    return steps.select("profile", F.explode(F.array_compact(rules)).alias("problem")).distinct()
