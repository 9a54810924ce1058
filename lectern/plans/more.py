"""Queries over structure, scoped evaluation, inventories, noise traces, pages, tables, parsers and sinks, with their SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import audit as A
from ..operators import inventory as I
from ..operators import matching as M
from ..operators import noise as N
from ..operators import ordering as O
from ..operators import pages as P
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import scope as V
from ..operators import structure as X
from ..sources import documents, ground_truth, html_items, predictions, sinks
from ..sources.derived import gt_lines, lines, table
from ..tables import fresh_path
from . import registry as B
from .registry import query, rounded


def _d() -> Column:
    return F.col("doc_id")


def _pick(n: Column, *values) -> Column:
    """One of the values, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(n: str, *values) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({n} % {len(values)} AS INT) + 1]"


# structure

_KINDS = ("paragraph", "heading1", "figure", "caption")
_BLOCK = "n, " + _pick_sql("n", *_KINDS) + " AS type, CASE WHEN n % 2 = 0 THEN n * 10 END AS ro, 1 + (3 * n) // 40 AS page_number"
_STRUCT = f"""WITH {B.ELEMENTS}, ns AS (SELECT DISTINCT artifact_id, CAST(substr(parent_id, 2) AS BIGINT) AS n FROM el WHERE parent_id LIKE 'b%'), bk AS (SELECT artifact_id, 'b' || n AS id, {_BLOCK} FROM ns UNION ALL SELECT artifact_id, 'i' || n AS id, {_BLOCK} FROM ns WHERE n % 4 = 2),
 tl AS (SELECT artifact_id, page_number, coalesce(parent_id, id) AS id, string_agg(trim(text), ' ' ORDER BY line_index, reading_order, pos) AS text, min(reading_order) AS o, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, count(*) AS n_lines FROM el WHERE owner_type IS NULL GROUP BY 1, 2, 3),
 lab AS (SELECT *, CASE type WHEN 'heading1' THEN 'heading' WHEN 'figure' THEN 'image' ELSE type END AS label FROM bk)
 SELECT t.artifact_id, t.page_number, t.id, coalesce(b.label, 'paragraph') AS type, text, coalesce(b.ro, t.o) AS reading_order, x, y, width, height, n_lines FROM tl t LEFT JOIN lab b USING (artifact_id, page_number, id)
 UNION ALL SELECT b.artifact_id, b.page_number, b.id, label, '', coalesce(ro, 1000000000), 50.0, n, 100.0, 20.0, 0 FROM lab b WHERE label = 'image' AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.artifact_id = b.artifact_id AND tl.page_number = b.page_number AND tl.id = b.id)"""


@query(_STRUCT)
def structure_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and figures of each page with the blocks they belong to; a figure that has lines is listed once."""
    e = B._line_elements(spark, sf).withColumn("type", F.lit("text_line"))
    n = F.col("n")
    ns = e.where("parent_id LIKE 'b%'").select("artifact_id", F.expr("CAST(substring(parent_id, 2) AS BIGINT)").alias("n")).distinct()
    block = lambda d, mark: d.select("artifact_id", (1 + F.expr("(3 * n) div 40")).cast("int").alias("page_number"), F.concat(F.lit(mark), n).alias("id"), _pick(n, *_KINDS).alias("type"), F.lit("").alias("text"), G.box(50.0, n.cast("double"), 100.0, 20.0).alias("bbox"), F.when(n % 2 == 0, n * 10).cast("int").alias("reading_order"))
    blocks = block(ns, "b").unionByName(block(ns.where("n % 4 = 2"), "i"))
    none = F.lit(None)
    figures = blocks.where("type = 'figure'").select("artifact_id", "page_number", "id", "type", "text", none.cast("string").alias("parent_id"), none.cast("string").alias("owner_type"), none.cast("int").alias("line_index"), "reading_order", "bbox", F.lit(0).alias("ord"))
    seen = e.select(*figures.columns).unionByName(figures)
    return rounded(X.structure_elements(seen, blocks, ["artifact_id", "page_number"], unique_blocks=True))


_SAID = B.TURNS + ", said AS (SELECT artifact_id, conv_id, id, text || ' #' || id AS text FROM turns), grp AS (SELECT s.artifact_id, q.grp AS pred_index, string_agg(s.text, ' ' ORDER BY s.id) AS text, min(s.id) AS first, count(*) AS span FROM said s JOIN seq q USING (artifact_id, id) GROUP BY 1, 2)"


def _said(spark: SparkSession, sf: str):
    """Turns as blocks with a number, so that no two are alike, and as predictions: merged in pairs, swapped in pairs or left."""
    t = B._turns(spark, sf).withColumn("text", F.concat("text", F.lit(" #"), "id"))
    none = F.lit(None).cast(G.BOX)
    gt = t.select("artifact_id", F.col("id").alias("gt_index"), "text", none.alias("bbox"))
    joined = t.groupBy("artifact_id", "group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), " ").alias("text"))
    return gt, joined.select("artifact_id", F.col("group").cast("int").alias("pred_index"), "text", none.alias("bbox"))


@query(f"WITH {_SAID} SELECT artifact_id, pred_index, first, span, 1.0::DOUBLE AS similarity, 1.0::DOUBLE AS score FROM grp")
def semantic_span_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every prediction spells a run of one or two blocks."""
    return rounded(M.semantic_match(*_said(spark, sf)))


_TOK = "list_filter(string_split_regex(lower(t), '[ \\n]+'), lambda q: q <> '')"


@query(f"""WITH {_SAID}, g AS (SELECT artifact_id, string_agg(trim(text), chr(10) ORDER BY id) AS t, count(*) AS n FROM said GROUP BY 1), p AS (SELECT artifact_id, string_agg(trim(text), chr(10) ORDER BY pred_index) AS t, count(*) AS n FROM grp GROUP BY 1),
 st AS ({B.STATS}), j AS (SELECT artifact_id, lower(trim(regexp_replace(g.t, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(p.t, '\\s+', ' ', 'g'))) AS b, g.n AS gn, p.n AS pn FROM g JOIN p USING (artifact_id))
 SELECT artifact_id, gn AS num_gt_blocks, pn AS num_predicted_blocks, gn AS num_matched_gt_blocks, concordant, discordant, unresolved, round({B._lev('a', 'b')} / length(a), 6) AS ordered_cer, 1.0::DOUBLE AS token_f1, kendall_tau, pairwise_accuracy, coverage, 1.0::DOUBLE AS matched_block_ratio, 1.0::DOUBLE AS matched_prediction_ratio FROM j JOIN st USING (artifact_id)""")
def semantic_ordering(spark: SparkSession, sf: str) -> DataFrame:
    """Without ordered_wer, for which DuckDB has no distance of words; tests have it."""
    out = X.semantic_ordering(*_said(spark, sf))
    return rounded(out.select("artifact_id", "num_gt_blocks", "num_predicted_blocks", "num_matched_gt_blocks", "concordant", "discordant", "unresolved", "ordered_cer", "token_f1", "kendall_tau", "pairwise_accuracy", "coverage", "matched_block_ratio", "matched_prediction_ratio"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS seal, sha256('[\"seed\",\"' || event_id || '\"]') AS seed FROM events")
def canonical_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hash seals of the events' properties and of derived seeds, in Arrow batches."""
    from ..functions import text as T

    return table(spark, sf, "events").select("event_id", T.canonical_json_sha256(F.col("props")).alias("seal"), T.derived_seed(F.array(F.lit("seed"), F.col("event_id").cast("string"))).alias("seed"))


# scoped evaluation


@query("SELECT page_id, p AS problem FROM (SELECT page_id, unnest(list_filter([CASE WHEN page_id % 5 = 0 THEN 'coordinates' END, CASE WHEN page_id % 7 = 0 THEN 'canvas_size' END, CASE WHEN page_id % 3 = 0 THEN 'page_size' END, CASE WHEN page_id % 11 = 0 THEN 'audit' END, CASE WHEN page_id % 13 = 0 THEN 'polygon_missing' END, CASE WHEN page_id % 4 = 3 THEN 'envelope' END, CASE WHEN page_id % 17 = 0 THEN 'visibility_facts' END], lambda x: x IS NOT NULL)) AS p FROM pages)")
def scope_preconditions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    images = table(spark, sf, "pages").select("page_id", F.lit(1).alias("n_pages"), F.lit(1).alias("page_number"), F.when(i % 5 == 0, "points").otherwise("pixels").alias("unit"), F.lit("top-left").alias("origin"), F.when(i % 7 == 0, float("inf")).otherwise(600.0).alias("image_width"), F.lit(800.0).alias("image_height"), F.when(i % 7 == 0, float("inf")).otherwise(600.0).alias("page_width"), (800.0 + F.when(i % 3 == 0, 1).otherwise(0)).alias("page_height"), (i % 11 == 0).cast("int").alias("audit_errors"), (i % 13 == 0).cast("int").alias("missing_polygons"), F.when(i % 4 == 3, 0.2).otherwise(0.01).alias("envelope_error"), (i % 17 == 0).cast("int").alias("wrong_facts"))
    return V.preconditions(images, "page_id")


_TYPES = ("paragraph", "image", "table", "formula", "heading1")


def _regions_sql(task: str, kinds: list[str]) -> str:
    own = "ordering" if task == "line_ordering" else task
    drawn = f"SELECT '{task}' AS task, doc_id, 'manual:r' || doc_id AS region, 'manual:stamp' AS reason FROM documents WHERE doc_id % 3 = 0 AND ('{own}' = 'quality' OR ('{own}' = 'ordering' AND doc_id % 2 = 0))"
    return drawn + (f" UNION ALL SELECT '{task}', doc_id, 'unannotated:e' || doc_id, 'unannotated_' || t FROM (SELECT doc_id, {_pick_sql('doc_id', *_TYPES)} AS t FROM documents) WHERE t IN ({', '.join(map(repr, kinds))})" if kinds else "")


@query(" UNION ALL ".join(_regions_sql(t, k) for t, k in V.IGNORED_KINDS.items()))
def scope_regions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    manual = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("r"), "doc_id").alias("id"), F.when(_d() % 2 == 0, F.array(F.lit("quality"), F.lit("ordering"))).otherwise(F.array(F.lit("quality"))).alias("tasks"), F.lit("stamp").alias("reason"))
    blocks = d.select("doc_id", F.concat(F.lit("e"), "doc_id").alias("id"), _pick(_d(), *_TYPES).alias("type"))
    every = [V.ignore_regions(manual, blocks, t, "doc_id").withColumn("task", F.lit(t)) for t in V.IGNORED_KINDS]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


@query(f"WITH {B.ELEMENTS}, bl AS (SELECT artifact_id, coalesce(parent_id, id) AS id, min(reading_order) AS ro, min(pos) AS f FROM el WHERE owner_type IS NULL GROUP BY 1, 2) SELECT 'quality' AS task, artifact_id, 'l' || pos AS id, row_number() OVER (PARTITION BY artifact_id ORDER BY pos) AS rank FROM el UNION ALL SELECT 'line_ordering', artifact_id, 'l' || pos, row_number() OVER (PARTITION BY artifact_id ORDER BY pos DESC) FROM el WHERE pos % 5 <> 1 UNION ALL SELECT 'ordering', artifact_id, id, row_number() OVER (PARTITION BY artifact_id ORDER BY ro, f) FROM bl UNION ALL SELECT 'structure', artifact_id, id, row_number() OVER (PARTITION BY artifact_id ORDER BY ro, id) FROM bl")
def scope_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = B._line_elements(spark, sf)
    own = e.select("artifact_id", F.concat(F.lit("l"), "ord").alias("id"), F.col("ord").alias("gt_index"))
    blocks = X.text_blocks(e)
    elements = blocks.select("artifact_id", F.col("block_id").alias("id"), "reading_order")
    order = own.where("gt_index % 5 <> 1").select("artifact_id", "id", (-F.col("gt_index")).alias("pos"))
    out = None
    for task in ("quality", "line_ordering", "ordering", "structure"):
        one = V.candidates(task, own, blocks, elements, order).withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_TAIL = B.PAGE[len(B.PAIRS) :]
for _old, _new in (("gt", "egt"), ("pr", "epr"), ("cand", "ecand")):
    _TAIL = re.sub(rf"\b{_old}\b(?! \* )", _new, _TAIL)
_SCOPED = B._FILTER + f", egt AS (SELECT gt.* FROM gt JOIN e USING (artifact_id, gt_index) WHERE e.reason IS NULL), epr AS (SELECT pr.* FROM pr JOIN fl USING (artifact_id, pred_index) WHERE fl.reason <> 'inside_ignore_regions'), ecand AS (SELECT cand.* FROM cand SEMI JOIN egt USING (artifact_id, gt_index) SEMI JOIN epr USING (artifact_id, pred_index)){_TAIL}, sc AS (SELECT artifact_id, count(*) AS input_gt, count(*) FILTER (WHERE reason IS NULL) AS eligible_gt FROM e GROUP BY 1)"


@query(_SCOPED + " SELECT artifact_id, input_gt, eligible_gt, CAST(num_matched_lines AS BIGINT) AS num_matched_lines, CAST(char_errors AS BIGINT) AS char_errors, round(mean_iou, 6) AS mean_iou, round(char_errors / greatest(1, gt_char_count), 6) AS micro_cer, '0.3' AS evaluation_protocol_version FROM sc LEFT JOIN page USING (artifact_id) WHERE eligible_gt > 0 UNION ALL SELECT artifact_id, input_gt, 0, NULL, NULL, NULL, NULL, '0.3' FROM sc WHERE eligible_gt = 0")
def scoped_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Page metrics over eligible lines and the predictions that count; a page without eligible lines has no scores. Its counts are those of its predictions, which the SQL leaves out."""
    pages = B._judged(spark, sf)
    gt = F.filter("gt", lambda _, i: F.get("units.reason", i).isNull())
    kept = F.filter("predicted", lambda _, i: F.get("reasons", i) != "inside_ignore_regions")
    # generators of one row, so that arrays are made once and not in each use
    scoped = pages.select("artifact_id", F.size("units").alias("input_gt"), F.explode(F.array(gt)).alias("gt"), "predicted", "reasons").select("artifact_id", "input_gt", F.size("gt").alias("eligible_gt"), "gt", F.explode(F.array(kept)).alias("predicted"))
    metrics = Q.page_metrics_of(M.match_pages(scoped), "artifact_id", "input_gt", "eligible_gt")
    out = V.scored_of(metrics, ["mean_cer", "mean_wer", "mean_iou", "micro_cer", "micro_wer", "line_precision", "line_recall", "line_f1"])
    empty = F.col("eligible_gt") == 0
    return rounded(out.select("artifact_id", "input_gt", "eligible_gt", *[F.when(~empty, F.col(c)).alias(c) for c in ("num_matched_lines", "char_errors")], "mean_iou", "micro_cer", "evaluation_protocol_version"))


_SUM_SQL = ", ".join(f"CAST(sum((doc_id * {i + 3}) % {i + 7}) AS BIGINT) AS {c}" for i, c in enumerate(V.SUMS))


@query(f"SELECT *, round(eligible_gt / nullif(input_gt, 0), 6) AS eligible_gt_fraction, round(ignored_area_pixels / nullif(canvas_area_pixels, 0), 6) AS ignored_area_fraction FROM (SELECT lang AS language, {_SUM_SQL} FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1)")
def scope_totals(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.when(_d() % 10 == 0, "0.2").otherwise("0.3").alias("evaluation_protocol_version"), *[((_d() * (i + 3)) % (i + 7)).alias(c) for i, c in enumerate(V.SUMS)])
    return rounded(V.scope_totals(pages, ["language"]))


@query("SELECT doc_id, pred, CASE WHEN pred = 0 THEN 'inside_ignore_regions' WHEN pred = 1 THEN 'scorable' WHEN pred = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'eligible_gt_overlap' ELSE 'inside_ignore_regions' END ELSE 'no_geometry' END AS reason, NOT (pred = 0 OR (pred = 2 AND doc_id % 2 = 1)) AS kept FROM documents, (SELECT unnest([0, 1, 2, 3]) AS pred)")
def polygon_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Two regions side by side cover what lies across both; a third of a prediction outside of them counts."""
    d = table(spark, sf, "documents").select("doc_id")
    square = lambda x0, y0, x1, y1: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    ignored = d.select("doc_id", F.explode(F.array(square(0, 0, 10, 10), square(10, 0, 20, 10))).alias("polygon"))
    eligible = d.where("doc_id % 2 = 0").select("doc_id", square(2, 2, 4, 4).alias("polygon"))
    none = F.lit(None).cast("array<array<double>>")
    predicted = d.select("doc_id", F.posexplode(F.array(square(8, 6, 12, 9), square(15, 0, 30, 10), square(1, 1, 5, 5), none)).alias("pred_index", "polygon"))
    out = V.filter_polygons(predicted, eligible, ignored, "doc_id")
    return rounded(out.select("doc_id", F.col("pred_index").alias("pred"), "reason", "kept"))


# images of pages


_IMG = f"""WITH {B.ELEMENTS}, px AS (SELECT artifact_id, id, pos, x * 2 AS x0, (842 - y - h) * 2 AS y0, w * 2 AS w2, h * 2 AS h2, x AS sx FROM el WHERE page_number = 1), q AS (SELECT *, unnest([x0, x0 + w2, x0 + w2, x0]) AS cx, unnest([y0, y0, y0 + h2, y0 + h2]) AS cy FROM px), a AS (SELECT *, cx + 0.05 * cy - 3.0 AS tx, -0.02 * cx + cy + 7.0 AS ty FROM q), b AS (SELECT artifact_id, id, pos, any_value(sx) AS source_x, min(tx) AS a0, max(tx) AS a1, min(ty) AS b0, max(ty) AS b1 FROM a GROUP BY 1, 2, 3)"""


@query(_IMG + " SELECT artifact_id, id, pos AS ord, round(greatest(0, least(a0, 700)), 6) AS x, round(greatest(0, least(b0, 1684)), 6) AS y, round(greatest(0, least(a1, 700)) - greatest(0, least(a0, 700)), 6) AS width, round(greatest(0, least(b1, 1684)) - greatest(0, least(b0, 1684)), 6) AS height, source_x FROM b")
def image_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the first page on a canvas of 700 by 1684 pixels."""
    e = B._line_elements(spark, sf).select("artifact_id", "id", "ord", "page_number", "bbox")
    matrix = F.array(*[F.lit(v) for v in (1.0, 0.05, -3.0, -0.02, 1.0, 7.0)])
    images = e.select("artifact_id").distinct().select("artifact_id", F.lit(1).alias("source_page"), F.lit(842.0).alias("page_height"), F.lit(2.0).alias("zoom"), matrix.alias("matrix"), F.lit(700.0).alias("width"), F.lit(1684.0).alias("height"))
    out = P.image_elements(e, images)
    return rounded(out.select("artifact_id", "id", "ord", "bbox.x", "bbox.y", "bbox.width", "bbox.height", F.col("source_bbox.x").alias("source_x")))


@query(f"WITH {B.ELEMENTS}, o AS (SELECT artifact_id, 'n' || pos AS id, pos FROM el) SELECT artifact_id, 'lines' AS kind, id, row_number() OVER (PARTITION BY artifact_id ORDER BY pos DESC) - 1 AS pos FROM o WHERE pos % 3 <> 0")
def visible_order(spark: SparkSession, sf: str) -> DataFrame:
    e = B._line_elements(spark, sf).select("artifact_id", F.concat(F.lit("n"), "ord").alias("id"), "ord")
    order = e.select("artifact_id", F.lit("lines").alias("kind"), (-F.col("ord")).alias("pos"), "id")
    return rounded(P.visible_order(order, e.where("ord % 3 <> 0")).select("artifact_id", "kind", "id", "pos"))


@query(f"WITH {B.GT} SELECT artifact_id, gt_index, row_number() OVER (PARTITION BY artifact_id ORDER BY 'c' || (gt_index % 2), -y, x, gt_index) AS rank FROM gt")
def gt_order(spark: SparkSession, sf: str) -> DataFrame:
    g = gt_lines(spark, sf).withColumn("container_id", F.concat(F.lit("c"), F.col("gt_index") % 2))
    return rounded(O.gt_sequence(g).select("artifact_id", "gt_index", "rank"))


@query("SELECT DISTINCT lang AS language, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS rank FROM documents")
def preferred_first(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("language")).distinct()
    return rounded(d.select("language", R.preferred_rank(F.col("language"), ["fr", "en"]).alias("rank")))


# inventory


@query("SELECT doc_id, s AS scope, unnest(range(1, 1 + CASE s WHEN 'first' THEN 1 WHEN 'half' THEN greatest(1, (n + 1) // 2) ELSE n END)) AS page FROM (SELECT doc_id, 1 + doc_id % 5 AS n FROM documents), (SELECT unnest(['first', 'half', 'all']) AS s)")
def page_scope(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (1 + _d() % 5).cast("int").alias("n"), F.explode(F.array(*map(F.lit, ("first", "half", "all")))).alias("scope"))
    return rounded(d.select("doc_id", "scope", F.explode(I.page_scope(F.col("n"), F.col("scope"))).alias("page")))


@query("SELECT doc_id, p AS profile, unnest(range(0, CASE WHEN p = 'clean' THEN 1 ELSE 1 + doc_id % 3 END)) AS variant FROM documents, (SELECT unnest(['clean', 'heavy_scan']) AS p)")
def requested_conditions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (1 + _d() % 3).cast("int").alias("n"))
    grid = I.condition_grid(F.array(F.lit("clean"), F.lit("heavy_scan")), F.col("n"))
    return rounded(d.select("doc_id", F.explode(grid).alias("c")).select("doc_id", "c.profile", "c.variant"))


_PATHS = ("a/b.json", "/etc/x", "a/../b", "c:\\x", "", "./a//b", "..", ".")


@query(f"SELECT doc_id, path, list_contains(['a/b.json', './a//b'], path) AS safe FROM (SELECT doc_id, {_pick_sql('doc_id', *_PATHS)} AS path FROM documents)".replace("\\\\", "\\"))
def path_safety(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", _pick(_d(), *_PATHS).alias("path"))
    return d.select("doc_id", "path", I.safe_path(F.col("path")).alias("safe"))


@query("SELECT doc_id, l * a AS source_documents, l * a * 3 AS rendered_documents, l * a * 3 * p AS base_pages, l * a * 3 * p * (CASE WHEN doc_id % 2 = 0 THEN 1 + 2 * v ELSE 2 * v END) AS images FROM (SELECT doc_id, 1 + doc_id % 2 AS l, 1 + doc_id % 7 AS a, 1 + doc_id % 3 AS p, 1 + doc_id % 4 AS v FROM documents)")
def target_counts(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c, a, b: F.when(c, F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b)))
    specs = table(spark, sf, "documents").select("doc_id", some(_d() % 2 == 0, ["en"], ["en", "de"]).alias("languages"), (1 + _d() % 7).alias("articles_per_language"), F.array(*map(F.lit, "abc")).alias("templates"), (1 + _d() % 3).alias("pages_per_document"), some(_d() % 2 == 0, ["clean", "x", "y"], ["x", "y"]).alias("conditions"), (1 + _d() % 4).alias("variants_per_noisy_condition"))
    return rounded(I.target_counts(specs).select("doc_id", "source_documents", "rendered_documents", "base_pages", "images"))


@query("SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'file_name' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'profile_variant' END, CASE WHEN doc_id % 13 = 0 THEN 'source_page' END, CASE WHEN doc_id % 7 = 0 THEN 'coordinates' END, CASE WHEN doc_id % 9 = 0 THEN 'single_page' END, CASE WHEN doc_id % 4 = 0 THEN 'image_size' END, CASE WHEN doc_id % 6 = 0 THEN 'transform' END], lambda x: x IS NOT NULL)) AS problem FROM documents")
def record_problems(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda w: F.struct(w.cast("int").alias("width"), F.lit(9).alias("height"))
    same = F.lit(5)
    r = table(spark, sf, "documents").select("doc_id", F.when(_d() % 11 == 0, "").otherwise("light_scan").alias("profile"), F.lit(1).alias("variant"), F.lit("light_scan").alias("meta_profile"), F.when(_d() % 5 == 0, 2).otherwise(1).alias("meta_variant"), (_d() % 13 != 0).alias("source_page"), F.when(_d() % 7 == 0, "points").otherwise("pixels").alias("unit"), F.lit("top-left").alias("origin"), F.when(_d() % 9 == 0, 2).otherwise(1).alias("n_pages"), F.lit(1).alias("page_number"), F.when(_d() % 6 != 0, "affine").alias("transform"), size(same).alias("image"), size(same).alias("coordinates"), size(F.when(_d() % 4 == 0, 6).otherwise(5)).alias("declared"), size(same).alias("page"))
    return I.record_problems(r, "doc_id")


_RECORDS = "r AS (SELECT CASE WHEN doc_id % 50 = 1 THEN 'a0' ELSE 'a' || doc_id END AS artifact_id, lang AS language, source AS article_id, sha256(source || lang) AS sha, CASE WHEN doc_id % 40 = 3 THEN 'other' ELSE source END AS source_family, CASE WHEN doc_id % 30 = 7 THEN 'test' ELSE 'dev' END AS split FROM documents)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.when(_d() % 50 == 1, "a0").otherwise(F.concat(F.lit("a"), "doc_id")).alias("artifact_id"), F.col("lang").alias("language"), F.col("source").alias("article_id"), F.sha2(F.concat("source", "lang"), 256).alias("source_sha256"), F.when(_d() % 40 == 3, "other").otherwise(F.col("source")).alias("source_family"), F.when(_d() % 30 == 7, "test").otherwise("dev").alias("split"), F.lit("reviewed_catalog").alias("family_assignment"))


@query(f"WITH {_RECORDS} SELECT NULL AS artifact_id, 'discovery_count' AS problem UNION ALL SELECT artifact_id, 'duplicate_artifact' FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT artifact_id, 'split_plan' FROM r WHERE source_family = 'other' OR split = 'test'")
def manifest_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Of a plan in which every source is in dev; one artifact more was discovered than records and issues have."""
    r = _records(spark, sf)
    plan = r.select("language", "article_id", "source_sha256", F.col("article_id").alias("family_id"), F.lit("dev").alias("split")).distinct()
    issues = r.where("artifact_id = 'none'").select("artifact_id")
    return I.manifest_problems(r, issues, r.count() + 1, plan)


@query(f"WITH {_RECORDS} SELECT article_id AS family_id, count(DISTINCT (language, sha)) AS n_members, min(language) AS first_language FROM r GROUP BY 1")
def family_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.family_catalogue(_records(spark, sf)).select("family_id", "n_members", F.col("members")[0]["language"].alias("first_language")))


@query("SELECT doc_id, doc_id % 6 <> 0 AND doc_id % 8 <> 0 AS complete FROM documents")
def complete_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Base pages with their profiles: some lack one, some have one twice."""
    names = F.when(_d() % 6 == 0, F.array(F.lit("clean"))).when(_d() % 8 == 0, F.array(*map(F.lit, ("clean", "light_scan", "clean")))).otherwise(F.array(*map(F.lit, ("light_scan", "clean", "odd"))))
    r = table(spark, sf, "documents").select("doc_id", F.explode(names).alias("profile"), F.lit(0).alias("variant"))
    return I.complete_groups(r, ["doc_id"], ["clean", "light_scan"])


@query("WITH d AS (SELECT ['source_rights', 'source_families', 'noise_severity', 'taste'][CAST(doc_id % 4 AS INT) + 1] AS category, 'u' || (doc_id // 8) AS unit_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM documents) SELECT c AS category, NULL AS unit_id, 'category_missing' AS problem FROM (SELECT unnest(['font_asset_rights', 'evaluation_protocol']) AS c) UNION ALL SELECT category, unit_id, 'category_unknown' FROM d WHERE category = 'taste' UNION ALL SELECT category, unit_id, 'duplicate_unit' FROM d GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT category, unit_id, 'not_accepted' FROM d WHERE status IS NULL OR status <> 'accepted'")
def review_problems(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(_pick(_d(), "source_rights", "source_families", "noise_severity", "taste").alias("category"), F.concat(F.lit("u"), F.expr("doc_id div 8")).alias("unit_id"), F.when(_d() % 3 == 1, "accepted").when(_d() % 3 == 2, "rejected").alias("status"))
    return I.review_problems(d)


@query("SELECT source AS path, count(DISTINCT sha256(lang)) AS versions FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(lang)) > 1")
def shared_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.disagreeing_dependencies(table(spark, sf, "documents").select(F.col("source").alias("path"), F.sha2("lang", 256).alias("sha256"))))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AND quality = 1 AND d.doc_id % 4 <> 0 AS reusable, CASE WHEN l.doc_id IS NULL THEN 'not_cached' WHEN quality <> 1 THEN 'not_successful' WHEN d.doc_id % 4 = 0 THEN 'input_changed' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def reuse_check(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select("doc_id", F.when(_d() % 4 == 0, "new").otherwise("old").alias("sha256"))
    cached = table(spark, sf, "labels").select("doc_id", F.lit("old").alias("sha256"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return I.reusable(pages, cached, ["doc_id"])


@query("WITH p AS (SELECT lang AS language, sum(n_chars) AS c, count(*) AS n FROM documents GROUP BY 1) SELECT language, 'chars' AS \"column\", CAST(c + 1 AS BIGINT) AS saved, CAST(c AS BIGINT) AS pooled FROM p WHERE language = 'de' UNION ALL SELECT 'xx', k, 7, NULL FROM (SELECT unnest(['chars', 'docs']) AS k)")
def repool_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Saved sums of which one is off, and a group that no page has."""
    pages = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("chars"), F.lit(1).alias("docs"))
    saved = pages.groupBy("language").agg((F.sum("chars") + F.when(F.col("language") == "de", 1).otherwise(0)).alias("chars"), F.sum("docs").alias("docs"))
    extra = saved.sparkSession.createDataFrame([("xx", 7, 7)], "language string, chars long, docs long")
    return I.repool_differences(saved.unionByName(extra), pages, ["language"], ["chars", "docs"])


# tables and pages


@query("SELECT l_orderkey AS t, count(*) FILTER (WHERE l_quantity > 40) AS merged_cells, count(*) AS rows, 1 + l_orderkey % 5 AS columns FROM lineitem GROUP BY l_orderkey ORDER BY merged_cells DESC, rows DESC, columns DESC, t LIMIT 20")
def top_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("t")).agg(F.count_if(F.col("l_quantity") > 40).alias("merged_cells"), F.count("*").alias("rows")).withColumn("columns", 1 + F.col("t") % 5)
    return rounded(I.top_tables(t, ["t"], 20))


@query("WITH t AS (SELECT p_partkey AS k, ['single_column', 'two_column', 'three_column', 'magazine'][CAST(p_partkey % 4 AS INT) + 1] AS l, CASE WHEN p_partkey % 9 = 0 THEN 300.0 ELSE 50.0 END AS m, CASE WHEN p_partkey % 10 = 0 THEN -1.0 ELSE 20.0 END AS g FROM part), n AS (SELECT *, CASE l WHEN 'two_column' THEN 2 WHEN 'three_column' THEN 3 ELSE 1 END AS n, CASE WHEN g < 0 OR m > 100 THEN 'no_room' END AS p FROM t) SELECT k, CASE WHEN p IS NULL THEN CASE WHEN n = 1 THEN 'main_content' ELSE 'column_' || (i + 1) END END AS container_id, CASE WHEN p IS NULL THEN round(m + i * ((595.0 - 2 * m - g * (n - 1)) / n + g), 6) END AS x, CASE WHEN p IS NULL THEN 40.0::DOUBLE END AS y, CASE WHEN p IS NULL THEN round((595.0 - 2 * m - g * (n - 1)) / n, 6) END AS width, CASE WHEN p IS NULL THEN 752.0::DOUBLE END AS height, p AS problem FROM (SELECT *, unnest(range(0, CASE WHEN p IS NULL THEN n ELSE 1 END)) AS i FROM n)")
def page_columns(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    side = F.when(k % 9 == 0, 300.0).otherwise(50.0)
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k")).select("k", F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), _pick(k, "single_column", "two_column", "three_column", "magazine").alias("layout_type"), F.when(k % 10 == 0, -1.0).otherwise(20.0).alias("gutter"), F.lit(50.0).alias("top"), F.lit(40.0).alias("bottom"), side.alias("left"), side.alias("right"))
    return rounded(P.page_columns(t, "k"))


#: A table of four rows: (row, pos, rowspan, colspan, header, text, scope) and the columns that its cells come to lie in.
_CELLS = [(0, 0, 2, 1, True, "a", None), (0, 1, 1, 2, True, "b", None), (1, 0, 1, 1, True, "c", "col"), (1, 1, 1, 1, False, "", None), (2, 0, 1, 1, False, "d", None), (2, 1, 2, 2, False, "e", None), (3, 0, 1, 1, True, "f", "row")]
_AT = [0, 1, 1, 2, 0, 1, 0]


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """The table for each order; every third one has a cell that reaches too far down, every fifth one that runs into another."""
    o = F.col("o_orderkey")
    cell = F.explode(F.array(*[F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in zip(("row_index", "pos", "rowspan", "colspan", "is_header", "text", "scope"), c, strict=True)]) for c in _CELLS]))
    d = table(spark, sf, "orders").select("o_orderkey", cell.alias("c")).select("o_orderkey", "c.*")
    tall = (o % 3 == 0) & (F.col("row_index") == 3)
    wide = (o % 5 == 0) & (F.col("row_index") == 1) & (F.col("pos") == 0)
    return d.withColumn("rowspan", F.when(tall, 2).otherwise(F.col("rowspan"))).withColumn("colspan", F.when(wide, 2).otherwise(F.col("colspan")))


_PLACE = "WITH c(row_index, pos, place) AS (VALUES " + ", ".join(f"({c[0]}, {c[1]}, {a})" for c, a in zip(_CELLS, _AT, strict=True)) + ")"


@query(_PLACE + " SELECT o_orderkey, row_index, pos, CASE WHEN o_orderkey % 5 = 0 AND row_index = 1 AND pos = 1 THEN 3 ELSE place END AS column_index, CASE WHEN o_orderkey % 3 = 0 AND row_index = 3 THEN 'rowspan' END AS problem FROM orders, c")
def cell_places(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.place_cells(_cells(spark, sf), ["o_orderkey"]))


@query("SELECT o_orderkey, 4 AS rows, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END AS columns, 7 AS cells, 3 + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT AS merged_cells, 2 AS header_rows, CASE WHEN o_orderkey % 3 = 0 THEN 'rowspan' END AS problem FROM orders")
def table_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.audit_of(P.placed_cells(_cells(spark, sf), ["o_orderkey"]), ["o_orderkey"]))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber % 3 = 0) AS missing, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber % 2 = 0) AS extra FROM lineitem GROUP BY 1")
def cell_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    source = table(spark, sf, "lineitem").select("l_orderkey", F.lit("t1").alias("table_id"), n.cast("int").alias("row_index"), F.lit(0).alias("column_index"))
    other = source.where("row_index % 2 = 0").withColumn("column_index", F.lit(1))
    return rounded(P.cell_coverage(source, source.where("row_index % 3 <> 0").unionByName(other), ["l_orderkey"]))


@query("SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, list_transform(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\S(?:.{0,38}\\S)?(?: |$)|\\S{40}'), lambda x: rtrim(x)) AS ls FROM documents)")
def line_breaking(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts in lines of 40 characters."""
    return rounded(table(spark, sf, "documents").select("doc_id", F.posexplode(P.break_lines(F.col("text"), 40)).alias("n", "line")))


# noise

_OPS = ["faded_ink", "sensor_noise", "faded_ink"]
_SEEDS = f"s AS (SELECT event_id, 'seed' || (event_id % 7) AS a, unnest({_OPS}) AS name, unnest([0, 1, 2]) AS pos, unnest([0, 0, 1]) AS occurrence FROM events), k AS (SELECT *, sha256('[\"{N.DOMAIN}\",\"' || a || '\",\"' || name || '\",' || occurrence || ']') AS seed FROM s)"


@query(f"WITH {_SEEDS} SELECT event_id, pos, name, occurrence, seed FROM k")
def operation_seeds(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("event_id", F.concat(F.lit("seed"), F.col("event_id") % 7).alias("artifact_seed"), F.array(*map(F.lit, _OPS)).alias("operations"))
    return rounded(N.operation_seeds(t, "event_id"))


@query("SELECT event_id, unnest(list_filter([CASE WHEN event_id % 7 = 0 THEN 'artifact_seed' END, CASE WHEN event_id % 5 = 0 THEN 'operations' END, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'clean_control' END, CASE WHEN event_id % 2 = 1 AND event_id % 11 = 0 THEN 'encoding' END, CASE WHEN event_id % 13 = 0 AND event_id % 2 = 1 THEN 'operation_seed' END], lambda x: x IS NOT NULL)) AS problem FROM events WHERE event_id % 17 <> 0 UNION ALL SELECT event_id, unnest(list_filter(['unknown_profile', CASE WHEN event_id % 7 = 0 THEN 'artifact_seed' END, CASE WHEN event_id % 13 = 0 AND event_id % 2 = 1 THEN 'operation_seed' END], lambda x: x IS NOT NULL)) FROM events WHERE event_id % 17 = 0")
def trace_problems(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    profile = F.when(i % 17 == 0, "made_up").when(i % 2 == 0, "clean").otherwise("light_scan")
    identity = F.array(N.json_text(i))
    e = table(spark, sf, "events").select("event_id", F.lit(42).alias("master_seed"), identity.alias("identity"), profile.alias("profile"))
    e = e.withColumn("artifact_seed", F.when(i % 7 == 0, "wrong").otherwise(N.seed_of(F.concat(F.array(N.json_text(F.col("master_seed"))), "identity"))))
    ops = F.when(i % 2 == 0, F.when(i % 5 == 0, F.array(F.lit("faded_ink"))).otherwise(F.array().cast("array<string>"))).otherwise(F.when(i % 5 == 0, F.array(F.lit("faded_ink"))).otherwise(F.array(F.lit("faded_ink"), F.lit("faded_ink"))))
    e = e.withColumn("names", ops)
    seeded = N.operation_seeds(e.select("event_id", "artifact_seed", F.col("names").alias("operations")), "event_id")
    held = seeded.withColumn("seed", F.when((i % 13 == 0) & (i % 2 == 1) & (F.col("pos") == 0), "wrong").otherwise(F.col("seed"))).groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "seed"))), lambda r: F.struct(r["name"].alias("name"), r["seed"].alias("seed"))).alias("operations"))
    none = F.array().cast("array<struct<name:string,seed:string>>")
    t = e.drop("names").join(held, "event_id", "left").withColumn("operations", F.coalesce("operations", none)).select("*", F.lit(0).alias("variant"), F.when((i % 2 == 1) & (i % 11 == 0), "PNG").when(i % 2 == 0, "PNG").otherwise("JPEG-quality-95").alias("encoding"), F.lit("r").alias("raster_sha256"), F.when(i % 3 == 0, "x").otherwise("r").alias("processed_sha256"))
    known = spark.createDataFrame([("clean", [], "PNG"), ("light_scan", ["faded_ink", "faded_ink"], "JPEG-quality-95")], "profile string, expected array<string>, expected_encoding string")
    return N.trace_problems(t, known, "event_id")


@query("SELECT 'p' || doc_id AS profile, unnest(list_filter([CASE doc_id % 4 WHEN 0 THEN 'unknown_operation' WHEN 1 THEN 'unknown_parameter' WHEN 2 THEN 'parameter_bounds' END], lambda x: x IS NOT NULL)) AS problem FROM documents UNION ALL SELECT 'Bad Name', 'profile_name' UNION ALL SELECT 'clean', 'built_in_profile'")
def recipe_problems(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("profile"), F.when(_d() % 4 == 0, "melting").otherwise("sensor_noise").alias("name"), F.create_map(F.when(_d() % 4 == 1, "size").otherwise("sigma"), F.when(_d() % 4 == 2, 300.0).otherwise(5.0)).alias("parameters"))
    more = spark.createDataFrame([("Bad Name", "faded_ink", {"strength": 0.5}), ("clean", "faded_ink", {"strength": 0.5})], "profile string, name string, parameters map<string,double>")
    return N.recipe_problems(steps.unionByName(more), ["clean", "light_scan"])


@query("SELECT event_id, round(c - s * 0.5, 6) AS a, round(s + c * 0.5, 6) AS b, round(10 * c, 6) AS x FROM (SELECT event_id, (event_id % 3)::DOUBLE AS s, (1 + event_id % 2)::DOUBLE AS c FROM events)")
def cumulative_maps(spark: SparkSession, sf: str) -> DataFrame:
    """A shear and a shift, then a turn: rows of the product."""
    i = F.col("event_id")
    c, s = (1 + i % 2).cast("double"), (i % 3).cast("double")
    six = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])
    m = N.cumulative_matrix(F.array(six(1, 0.5, 10, -0.5, 1, 0), six(c, s, 0, -s, c, 0)))
    return rounded(table(spark, sf, "events").select("event_id", m.alias("m")).select("event_id", F.get("m", F.lit(0)).alias("a"), F.get("m", F.lit(1)).alias("b"), F.get("m", F.lit(2)).alias("x")))


# audit of pages, cells, sources and images


@query("SELECT CAST(page_id AS VARCHAR) AS artifact_id, CASE WHEN page_id % 7 = 0 THEN 'empty_gt' WHEN page_id % 5 = 0 THEN 'duplicate_page' WHEN page_id % 3 = 0 THEN 'page_size' ELSE 'page_number' END AS code FROM pages WHERE page_id % 7 = 0 OR page_id % 5 = 0 OR page_id % 3 = 0 OR page_id % 2 = 0")
def audit_pages(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    p = table(spark, sf, "pages").select(i.cast("string").alias("artifact_id"), "page_id")
    fault = F.when(i % 7 == 0, "none").when(i % 5 == 0, "twice").when(i % 3 == 0, "size").when(i % 2 == 0, "number").otherwise("")
    pages = p.withColumn("f", fault).where("f <> 'none'").select("artifact_id", F.when(F.col("f") == "number", 0).otherwise(1).alias("page_number"), F.when(F.col("f") == "size", 0.0).otherwise(5.0).alias("width"), F.lit(5.0).alias("height"), F.explode(F.when(F.col("f") == "twice", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")).drop("n")
    return A.page_findings(p.select("artifact_id"), pages).select("artifact_id", "code")


@query("SELECT artifact_id, element_id, code FROM (SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, unnest(CASE o_orderkey % 8 WHEN 0 THEN [('c1', 'cell_owner')] WHEN 1 THEN [('c1', 'cell_grid')] WHEN 2 THEN [('c1', 'cell_span')] WHEN 3 THEN [('c1', 'repeated_header_flag'), ('c1', 'source_cell_occurrence')] WHEN 4 THEN [('c1', 'source_cell_id')] WHEN 5 THEN [('c2', 'cell_overlap')] WHEN 6 THEN [('c1', 'source_cell_occurrence')] ELSE [] END) AS f, f[1] AS element_id, f[2] AS code FROM orders)")
def audit_cells(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    k = o % 8
    base = table(spark, sf, "orders").select(o.cast("string").alias("artifact_id"), "o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    first, n = F.col("n") == 1, F.col("n")
    cells = base.select("artifact_id", F.concat(F.lit("c"), n).alias("id"), F.when(first & (k == 0), "gone").otherwise("t").alias("parent_id"), F.lit("x").alias("text"), F.when(first & (k == 1), -1).otherwise(0).alias("row_index"), F.when(~first & (k != 5), 1).otherwise(0).alias("column_index"), F.lit(1).alias("rowspan"), F.when(first & (k == 2), 2000).otherwise(1).alias("colspan"), F.when(first & (k == 4), None).when(first | (k == 6), "s1").otherwise("s2").alias("source_cell_id"), (first & (k == 3)).alias("repeated_header"))
    tables = base.select("artifact_id").distinct().select("artifact_id", F.lit("t").alias("id"), F.array(F.lit(0)).alias("row_indexes"), F.lit(2).alias("n_columns"), F.lit(0).alias("repeated_header_rows"))
    return A.cell_findings(cells, tables).select("artifact_id", "element_id", "code")


@query("SELECT artifact_id, element_id, code FROM (SELECT CAST(doc_id AS VARCHAR) AS artifact_id, unnest(CASE doc_id % 4 WHEN 0 THEN [('b9', 'source_index'), (NULL, 'source_item_missing')] WHEN 1 THEN [('b1', 'source_text')] WHEN 2 THEN [('b1', 'source_caption')] ELSE [] END) AS f, f[1] AS element_id, f[2] AS code FROM documents)")
def audit_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(_d().cast("string").alias("artifact_id"), "doc_id", "text")
    k = _d() % 4
    items = d.select("artifact_id", F.lit(1).alias("source_index"), F.lit("paragraph").alias("type"), F.concat(F.lit("x"), F.coalesce("text", F.lit(""))).alias("text"), F.when(k == 2, "cap").alias("caption"))
    blocks = d.select("artifact_id", F.when(k == 0, "b9").otherwise("b1").alias("id"), F.lit("block").alias("role"), F.when(k == 0, 9).otherwise(1).alias("source_index"), F.lit(1).alias("page_number"), F.lit(1).alias("reading_order"), F.concat(F.lit("x - "), F.coalesce("text", F.lit("")), F.when(k == 1, "!").otherwise("")).alias("text"), F.lit("paragraph").alias("type"))
    return A.source_findings(items, blocks).select("artifact_id", "element_id", "code")


@query("SELECT artifact_id, element_id, code FROM (SELECT CAST(doc_id AS VARCHAR) AS artifact_id, unnest(CASE doc_id % 6 WHEN 0 THEN [(NULL, 'affine_matrix')] WHEN 1 THEN [('e', 'transformed_membership')] WHEN 2 THEN [('e', 'transformed_geometry')] WHEN 3 THEN [('e', 'transformed_content')] WHEN 4 THEN [('e', 'transformed_reference')] ELSE [] END) AS f, f[1] AS element_id, f[2] AS code FROM documents)")
def audit_images(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(_d().cast("string").alias("artifact_id"), "doc_id")
    k = _d() % 6
    six = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    images = d.select("artifact_id", F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.lit(1.0).alias("zoom"), F.when(k == 0, six(1, 1, 0, 1, 1, 0)).otherwise(six(1, 0, 0, 0, 1, 0)).alias("matrix"))
    sources = d.select("artifact_id", F.lit("e").alias("id"), F.lit("paragraph").alias("type"), F.lit("t").alias("text"), G.box(10.0, 60.0, 20.0, 30.0).alias("bbox"), F.lit("p").alias("parent_id"))
    made = G.box(F.when(k == 2, 11.0).otherwise(10.0), 10.0, 20.0, 30.0)
    elements = d.where(k != 1).select("artifact_id", F.lit("e").alias("id"), F.lit("paragraph").alias("type"), F.when(k == 3, "u").otherwise("t").alias("text"), made.alias("bbox"), G.polygon_of(made).alias("polygon"), F.when(k == 4, "q").otherwise("p").alias("parent_id"))
    return A.transform_findings(images, elements, sources).select("artifact_id", "element_id", "code")


# parsers and sinks


@query("SELECT page_id, pos, type, level, text, parent_pos FROM pages, (VALUES (0, 'hatnote', NULL, 'See @.', NULL), (1, 'heading', 2, 'One', NULL), (2, 'paragraph', NULL, 'Text @ of it.', 1), (3, 'heading', 3, 'Deep', 1), (4, 'list', NULL, 'a' || chr(10) || 'b', 3), (5, 'heading', 2, 'Two', NULL), (6, 'table', NULL, 'Cap', 5)) v(pos, type, level, t, parent_pos), LATERAL (SELECT replace(t, '@', CAST(page_id AS VARCHAR)) AS text)")
def article_items(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit('<div class="mw-parser-output"><div class="hatnote">See '), n, F.lit(".</div><h2>One</h2><p>Text "), n, F.lit(" of it.</p><h3>Deep</h3><ul><li>a</li><li>b</li></ul><h2>Two</h2><h2>Two</h2><table><caption>Cap</caption><tr><th>h</th><td>v</td></tr></table></div>"))
    found = html_items.hierarchy(html_items.items(table(spark, sf, "pages").select("page_id", "url", html.alias("html"))))
    w = B.W.partitionBy("page_id").orderBy("pos")
    again = found.withColumn("n", F.row_number().over(w) - 1)
    up = again.select("page_id", F.col("pos").alias("parent_pos"), F.col("n").alias("up"))
    return rounded(again.join(up, ["page_id", "parent_pos"], "left").select("page_id", F.col("n").alias("pos"), "type", "level", "text", F.col("up").alias("parent_pos")))


@query("SELECT page_id, n, type, replace(t, '@', CAST(page_id AS VARCHAR)) AS text FROM pages, (VALUES (0, 'heading2', 'One'), (1, 'paragraph', '1. a @'), (2, 'paragraph', '3. c')) v(n, type, t)")
def article_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Items for layout: a list gives a paragraph for each item that is not blank, and blank ones count."""
    detail = F.concat(F.lit('{"list_type": "ordered", "items": ["a '), F.col("page_id"), F.lit('", " ", "c"]}'))
    p = table(spark, sf, "pages")
    rows = p.select("page_id", F.lit(0).alias("pos"), F.lit("heading").alias("type"), F.lit(2).alias("level"), F.lit("One").alias("text"), F.lit("{}").alias("detail")).unionByName(p.select("page_id", F.lit(1).alias("pos"), F.lit("list").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), detail.alias("detail")))
    return rounded(html_items.flatten(rows).select("page_id", (F.col("pos") + F.col("part")).alias("n"), "type", "text"))


@query("SELECT doc_id, i AS pred_index, category, t AS text, x, problem FROM documents, (VALUES (0, 0, 'Title', 'A', 1.0, NULL), (0, 1, 'Text', 'b', NULL, 'bbox corners are not in order'), (1, 0, 'Text', 'c', NULL, NULL), (2, 0, 'Heading', '# Head', NULL, NULL), (2, 1, 'Text', 'body', NULL, NULL)) v(k, i, category, t, x, problem) WHERE k = doc_id % 3")
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    reply = _pick(_d(), '```json\n[{"category": "Title", "text": " A ", "bbox": [1, 0, 2, 1]}, {"text": "b", "bbox": [2, 0, 1, 1]}]\n```', 'Here: {"blocks": [{"text": "c"}]} ok', "# Head\n\nbody")
    out = predictions.parse_replies(table(spark, sf, "documents").select("doc_id", reply.alias("reply")), "doc_id")
    return rounded(out.select("doc_id", "pred_index", "category", "text", F.col("bbox.x").alias("x"), "problem"))


@query("SELECT doc_id, i AS pred_index, type, t AS text, x, y, h AS height FROM documents, (VALUES (0, 0, 'heading', 'T', 1.0, 10.0, 10.0), (0, 1, 'image', 'cap', 5.0, 6.0, 8.0), (1, 0, 'paragraph', 'only', 2.0, 3.0, 5.0)) v(k, i, type, t, x, y, h) WHERE k = doc_id % 2")
def layout_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = _pick(_d(), '{"texts": [{"self_ref": "#/1", "label": "Section-header", "text": "T", "prov": [{"page_no": 1, "bbox": {"l": 1, "r": 3, "t": 90, "b": 80, "coord_origin": "BOTTOMLEFT"}}]}, {"label": "text", "text": "other page", "prov": [{"page_no": 2, "bbox": {"l": 1, "r": 3, "t": 2, "b": 4}}]}], "pictures": [{"caption_text": "cap", "reading_order": 7, "bbox": {"x": 5, "y": 6, "width": 7, "height": 8}}], "pages": {"1": {"page_no": 1, "size": {"height": 100}}}}', '{"elements": [{"type": "Text", "orig": "only", "bbox": {"left": 2, "top": 3, "right": 4, "bottom": 8}}]}')
    out = predictions.parse_layouts(table(spark, sf, "documents").select("doc_id", text.alias("json")), "doc_id")
    return rounded(out.select("doc_id", "pred_index", "type", "text", "bbox.x", "bbox.y", "bbox.height"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Ground-truth documents in JSON, one for each document; some are broken."""
    line = lambda i, kind, page: F.concat(F.lit(f'{{"id": "e{i}", "type": "{kind}", "content": "w'), "doc_id", F.lit(f'", "bbox": {{"x": {i}.0, "y": 1.0, "width": 2.0, "height": 3.0, "page": {page}}}, "metadata": {{"parent_id": "p"}}}}'))
    page = lambda n, *es: F.concat(F.lit(f'{{"page_number": {n}, "width": 10, "height": 10, "containers": [{{"id": "c{n}", "elements": ['), F.concat_ws(", ", *es), F.lit("]}]}"))
    good = F.concat(F.lit('{"schema_version": "0.1", "pages": ['), F.concat_ws(", ", page(1, line(1, "text_line", 1), line(2, "image", 1), line(3, "text_line", 1), line(4, "text_line", 2)), page(2, line(5, "text_line", 2))), F.lit('], "elements": ['), F.concat_ws(", ", line(1, "text_line", 1), line(2, "image", 1)), F.lit("]}"))
    text = F.when(_d() % 10 == 0, "no json").when(_d() % 10 == 1, '{"pages": [{"page_number": 1, "width": 0, "height": 5}]}').when(_d() % 10 == 2, '{"schema_version": "9", "pages": []}').otherwise(good)
    return table(spark, sf, "documents").select("doc_id", text.alias("value")).select("doc_id", F.try_parse_json("value").alias("raw"), F.from_json("value", ground_truth.GT).alias("gt"))


@query("SELECT doc_id, i AS gt_index, 'e' || e AS id, 'c1' AS container_id, 'w' || doc_id AS text, e::DOUBLE AS x FROM documents, (VALUES (0, 1), (1, 3)) v(i, e) WHERE doc_id % 10 > 2")
def ground_truth_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ground_truth.text_lines(_truth(spark, sf), "doc_id").select("doc_id", "gt_index", "id", "container_id", "text", "bbox.x"))


@query("SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'not_json' WHEN 1 THEN 'page_size' ELSE 'schema_version' END AS problem FROM documents WHERE doc_id % 10 < 3")
def ground_truth_problems(spark: SparkSession, sf: str) -> DataFrame:
    return ground_truth.gt_problems(_truth(spark, sf), "doc_id")


@query("SELECT doc_id, e - 1 AS ord, 'e' || e AS id, CASE e WHEN 1 THEN 'text_line' ELSE 'image' END AS type, 'p' AS parent_id, 1 AS page_number FROM documents, (VALUES (1), (2)) v(e) WHERE doc_id % 10 > 2")
def ground_truth_elements(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ground_truth.flat_elements(_truth(spark, sf), "doc_id").select("doc_id", "ord", "id", "type", "parent_id", "page_number"))


@query("SELECT lang AS language, count(*) AS n, max(CASE WHEN doc_id % 2 = 0 THEN n_chars END) AS most FROM documents GROUP BY 1")
def ledger_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines, which never overwrites, and read by a declared schema."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.when(_d() % 2 == 0, F.col("n_chars")).alias("n_chars"))
    path = fresh_path(spark, "ledger")
    sinks.write_json_lines(d, path)
    back = ground_truth.read_ledger(spark, path, "doc_id long, language string, n_chars long")
    return back.groupBy("language").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1, 2")
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts of a log that is tailed: what the stream has after all files there are."""
    from ..streaming import events as S

    path, done = fresh_path(spark, "run-log"), f"progress_{abs(hash((sf, id(spark)))) % 10**9}"
    e = B._run_events(spark, sf).select("event", "run_id", "artifact_id", "status")
    sinks.write_json_lines(e, path)
    stream = S.progress(S.read_events(spark, path))
    checkpoint = fresh_path(spark, "run-log-state")
    out = fresh_path(spark, "run-progress")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:06d}")

    stream.writeStream.queryName(done).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    seen = spark.read.schema("run_id string, status string, n long, batch int").parquet(f"{out}/*")
    return seen.groupBy("run_id", "status").agg(F.max_by("n", "batch").alias("n"))


@query(f"WITH {B.LINES} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY 1")
def line_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars")))



@query("SELECT doc_id, CAST(i AS INTEGER) AS pos, ty AS type, replace(tx, '@', CAST(doc_id AS VARCHAR)) AS text, problem FROM documents, (VALUES (0, 0, 'heading2', 'One @', NULL), (0, 1, 'paragraph', 'note', NULL), (0, 2, 'paragraph', '1. a', NULL), (0, 3, 'paragraph', '3. c', NULL), (0, 4, 'table', '', NULL), (1, 0, 'paragraph', 'flat @', NULL), (2, NULL, NULL, NULL, 'not_json'), (3, NULL, NULL, NULL, 'no_content'), (4, NULL, NULL, NULL, 'schema_invalid')) v(k, i, ty, tx, problem) WHERE k = doc_id % 5")
def source_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Content trees, flat elements, and documents that can't be read."""
    n = _d().cast("string")
    tree = F.concat(F.lit('{"elements": [], "content": [{"type": "heading", "level": 2, "content": "One '), n, F.lit('", "children": [{"type": "hatnote", "content": "note"}, {"type": "list", "list_type": "ordered", "items": ["a", " ", "c"]}]}, {"type": "table"}]}'))
    flat = F.concat(F.lit('{"elements": [{"type": "paragraph", "content": "flat '), n, F.lit('"}]}'))
    value = F.when(_d() % 5 == 0, tree).when(_d() % 5 == 1, flat).when(_d() % 5 == 2, "{").when(_d() % 5 == 3, "{}").otherwise("[1]")
    return documents.source_items(table(spark, sf, "documents").select("doc_id", value.alias("value")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '9' WHEN doc_id % 2 = 0 THEN '7' ELSE '5' END AS size FROM documents")
def layered_settings(spark: SparkSession, sf: str) -> DataFrame:
    """A null in a layer falls through to the next."""
    own = F.when(_d() % 3 == 0, '{"font": {"size": 9}}').when(_d() % 3 == 1, '{"font": {"size": null}}')
    shared = F.when(_d() % 2 == 0, '{"font": {"size": 7}}').otherwise('{"font": {}}')
    return table(spark, sf, "documents").select("doc_id", documents.setting([own, shared, F.lit('{"font": {"size": 5}}')], "font.size").alias("size"))


@query("""WITH ce AS (SELECT l_orderkey AS table_id, l_linenumber % 3 AS ci, CASE WHEN l_partkey % 7 = 0 THEN 2 ELSE 1 END AS cs, CAST(l_partkey % 190 AS DOUBLE) AS tw, CAST(l_partkey % 97 AS DOUBLE) AS ww, CAST(CASE WHEN l_partkey % 50 = 0 THEN 150 ELSE 8 END AS DOUBLE) AS cw, l_linenumber <= 3 AS h FROM lineitem),
 sp AS (SELECT *, ci + u AS column_index FROM ce, (VALUES (0), (1)) v(u) WHERE u < cs),
 b AS (SELECT table_id, column_index, list_sort(list(tw + 8) FILTER (WHERE cs = 1)) AS sizes, max(tw + 8) FILTER (WHERE cs = 1 AND h) AS header, greatest(16.0, max(cw + 8) FILTER (WHERE cs = 1)) AS l, max(least(ww, 48.0) + 8) FILTER (WHERE cs = 1) AS wd FROM sp GROUP BY 1, 2),
 c AS (SELECT *, greatest(l, wd) AS w, sizes[CAST(floor((len(sizes) - 1) * 0.75) AS INT) + 1] AS typical FROM b),
 d AS (SELECT *, sum(l) OVER t AS sl, sum(w) OVER t AS sw FROM c WINDOW t AS (PARTITION BY table_id)),
 e AS (SELECT *, CASE WHEN sw > 200 THEN l + (200 - sl) / (sw - sl) * (w - l) ELSE w END AS base FROM d),
 f AS (SELECT *, greatest(base, least(110.0, greatest(coalesce(typical, base), header))) AS wish FROM e),
 g AS (SELECT *, sum(base) OVER t AS sb, sum(wish) OVER t AS sq FROM f WINDOW t AS (PARTITION BY table_id))
 SELECT table_id, CAST(column_index AS INT) AS column_index, CASE WHEN sl <= 200 THEN round(CASE WHEN sq - sb > greatest(0.0, 200 - sb) THEN base + greatest(0.0, 200 - sb) * ((wish - base) / (sq - sb)) ELSE wish * 200 / sq END, 4) END AS width, CASE WHEN sl > 200 THEN 'no_room' END AS problem FROM g""")
def column_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as cells, dealt to three columns, some over two."""
    n = F.col("l_partkey")
    wide = lambda k: (n % k).cast("double")
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") % 3).cast("int").alias("column_index"), F.when(n % 7 == 0, 2).otherwise(1).alias("colspan"), wide(190).alias("text_width"), wide(97).alias("word_width"), F.when(n % 50 == 0, 150.0).otherwise(8.0).alias("character_width"), (F.col("l_linenumber") <= 3).alias("is_header"))
    return P.column_widths(cells, ["table_id"], 200.0, 8.0, 4.0).withColumn("width", F.round("width", 4))


@query("""WITH f AS (SELECT p_partkey, CAST(p_partkey % 900 AS DOUBLE) AS nw, CAST(1 + p_partkey % 701 AS DOUBLE) AS nh, CAST(10 * (p_partkey % 71) AS DOUBLE) AS ch FROM part),
 g AS (SELECT *, ch + CASE WHEN ch > 0 THEN 6 ELSE 0 END AS below FROM f), h AS (SELECT *, CASE WHEN nw <= 0 THEN 'figure_size' WHEN below >= 700 THEN 'caption_height' END AS problem FROM g),
 s AS (SELECT *, CASE WHEN problem IS NULL THEN least(300 / nw, 350 / nh, 240 / nw, (700 - below) / nh) END AS k FROM h)
 SELECT p_partkey, round(k * nw, 4) AS drawn_width, round(k * nh, 4) AS drawn_height, round(k * nh + below, 4) AS total_height, round(50 + (240 - k * nw) / 2, 4) AS x, problem FROM s""")
def figure_fit(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    figures = table(spark, sf, "part").select("p_partkey", (n % 900).cast("double").alias("native_width"), (1 + n % 701).cast("double").alias("native_height"), F.lit(300.0).alias("frame_width"), F.lit(350.0).alias("frame_height"), F.lit(50.0).alias("column_x"), F.lit(240.0).alias("column_width"), F.lit(700.0).alias("page_height"), (10 * (n % 71)).cast("double").alias("caption_height"))
    out = P.fit_figures(figures)
    return out.select("p_partkey", *[F.round(x, 4).alias(x) for x in ("drawn_width", "drawn_height", "total_height", "x")], "problem")


_CARD_ROOM = "CAST(30 + doc_id % 60 AS DOUBLE)"


@query(f"""WITH {B.LINES}, r0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS row_index, CAST(10 + length(text) % 15 AS DOUBLE) AS height, length(text) % 4 = 0 AS joins FROM lines),
 r AS (SELECT *, row_index = max(row_index) OVER (PARTITION BY doc_id) AS last FROM r0),
 e AS (SELECT *, CASE WHEN last OR (NOT joins AND row_index >= 1) THEN 1 ELSE 0 END AS ends FROM r),
 p AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY row_index) - ends AS part FROM e),
 g AS (SELECT doc_id, part, min(row_index) AS first, count(*) AS n, sum(height) AS h FROM p GROUP BY 1, 2),
 hd AS (SELECT doc_id, height AS head FROM r WHERE row_index = 0),
 t AS (SELECT *, CAST(doc_id % 3 * 8 AS DOUBLE) AS cap, {_CARD_ROOM} AS fr, 400.0::DOUBLE AS room FROM hd),
 bad AS (SELECT DISTINCT doc_id FROM g JOIN t USING (doc_id) WHERE h + CASE WHEN first = 0 THEN cap ELSE head END > room),
 x AS (SELECT g.*, cap, fr, room, head FROM g JOIN t USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
 k AS (SELECT doc_id, list_reduce(list([struct_pack(f := CASE WHEN part > 0 THEN -1 WHEN cap + h <= fr THEN 0 ELSE 1 END, s := first, n := n, h := CASE WHEN part = 0 THEN cap + h ELSE h END, fr := fr, room := room, head := head)] ORDER BY part),
  lambda a, b: CASE WHEN a[-1].h + b[1].h <= CASE WHEN a[-1].f = 0 THEN b[1].fr ELSE b[1].room END THEN list_concat(a[1:-2], [struct_pack(f := a[-1].f, s := a[-1].s, n := a[-1].n + b[1].n, h := a[-1].h + b[1].h, fr := b[1].fr, room := b[1].room, head := b[1].head)]) ELSE list_concat(a, [struct_pack(f := a[-1].f + 1, s := b[1].s, n := b[1].n, h := b[1].head + b[1].h, fr := b[1].fr, room := b[1].room, head := b[1].head)]) END) AS fs FROM x GROUP BY 1)
 SELECT doc_id, CAST(i AS INT) AS fragment_index, CAST(q.f AS INT) AS frame_index, CAST(q.s AS INT) AS first_row, CAST(q.n AS BIGINT) AS rows, CASE WHEN q.s > 0 THEN 1 ELSE 0 END AS repeated_header_rows, q.h AS height, NULL AS problem FROM (SELECT doc_id, unnest(fs) AS q, unnest(range(len(fs))) AS i FROM k)
 UNION ALL SELECT doc_id, 0, NULL, NULL, NULL, NULL, NULL, 'row_height' FROM bad""")
def table_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document as a table's row, some joined to the next; the first is the header."""
    at = B.W.partitionBy("doc_id").orderBy("pos")
    r = lines(spark, sf).select("doc_id", (F.row_number().over(at) - 1).alias("row_index"), F.length("text").alias("k"))
    r = r.select("doc_id", "row_index", (10 + F.col("k") % 15).cast("double").alias("height"), (F.col("row_index") + F.when(F.col("k") % 4 == 0, 2).otherwise(1)).alias("reach"))
    t = r.select("doc_id").distinct().select("doc_id", F.lit(1).alias("header_rows"), (_d() % 3 * 8).cast("double").alias("caption_height"), (30 + _d() % 60).cast("double").alias("first_room"), F.lit(400.0).alias("room"))
    return P.table_fragments(r, t, ["doc_id"])


#: Columns that a list or VALUES gives DuckDB as narrower numbers than Spark has.
_LONGS = {
    "article_flow": ["n"], "article_items": ["pos", "level", "parent_pos"], "cell_places": ["row_index", "pos", "column_index"], "ground_truth_elements": ["ord", "page_number"], "ground_truth_lines": ["gt_index"],
    "operation_seeds": ["pos", "occurrence"], "polygon_filter": ["pred"], "preferred_first": ["rank"], "table_audit": ["rows", "columns", "cells", "merged_cells", "header_rows"], "layout_documents": ["pred_index"], "model_replies": ["pred_index"],
}
_DOUBLES = {"layout_documents": ["x", "y", "height"], "model_replies": ["x"]}
for _name in _LONGS:
    _casts = [f"CAST({c} AS BIGINT) AS {c}" for c in _LONGS[_name]] + [f"CAST({c} AS DOUBLE) AS {c}" for c in _DOUBLES.get(_name, [])]
    B.ORACLES[_name] = f"SELECT * REPLACE ({', '.join(_casts)}) FROM ({B.ORACLES[_name]})"
