"""Ground-truth audit: each finding is a row (artifact_id, code, severity, element_id).

Rules over one element or an element and its parent are evaluated together, after one join of the elements with
themselves; rules over groups take one aggregation each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..tables import discard, materialise

KEY = "artifact_id"
TOLERANCE_PDF, TOLERANCE_IMAGE = 0.01, 0.05
#: Types of text annotations.
TEXT_TYPES = ("paragraph", "text_line", "caption", "table_cell")
WARNINGS = {"fully_clipped", "partially_clipped", "legacy_trace", "layout_warnings"}


def _within(b: Column, x0: Column, y0: Column, x1: Column, y1: Column, eps: float) -> Column:
    return (b["x"] >= x0 - eps) & (b["y"] >= y0 - eps) & (b["x"] + b["width"] <= x1 + eps) & (b["y"] + b["height"] <= y1 + eps)


def _finite(b: Column) -> Column:
    ok = F.lit(True)
    for n in ("x", "y", "width", "height"):
        v = b[n]
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))


def _is_text(kind: Column) -> Column:
    return kind.isin(*TEXT_TYPES) | kind.startswith("heading")


def _by_id(elements: DataFrame, *columns: Column) -> DataFrame:
    """One row for each id; of elements that share one, the last in order counts."""
    if "ord" in elements.columns:
        elements = elements.withColumn("_n", F.row_number().over(W.partitionBy(KEY, "id").orderBy(F.desc("ord")))).where("_n = 1")
    return elements.dropDuplicates([KEY, "id"]).select(KEY, *columns)


def findings(elements: DataFrame, pages: DataFrame, image: bool = False, eps: float = TOLERANCE_PDF) -> DataFrame:
    """elements (artifact_id, id, type, role, parent_id, owner_id, page_number, bbox, text, line_index, reading_order, maybe ord); pages (artifact_id, page_number, width, height).

    An artifact with text annotations without text gets only these findings. Rules on boxes pass over boxes that
    are missing or not finite, which is a finding of its own.
    """
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    untyped = elements.where(_is_text(F.col("type")) & F.col("text").isNull())
    sound = elements.join(untyped.select(KEY).distinct(), KEY, "left_anti")
    parents = _by_id(sound, F.col("id").alias("parent_id"), F.col("page_number").alias("p_page"), F.col("bbox").alias("p_box"), F.col("type").alias("p_type"))
    owners = parents.select(KEY, F.col("parent_id").alias("owner_id"), F.col("p_page").alias("o_page"), F.col("p_box").alias("o_box"), F.col("p_type").alias("o_type"))
    size = pages.select(KEY, "page_number", F.col("width").alias("pw"), F.col("height").alias("ph")).dropDuplicates([KEY, "page_number"])
    e = sound.withColumn("parent_id", F.nullif("parent_id", F.lit(""))).join(parents, [KEY, "parent_id"], "left").join(owners, [KEY, "owner_id"], "left").join(size, [KEY, "page_number"], "left")
    b, pb, page = F.col("bbox"), F.col("p_box"), F.col("page_number")
    zero = F.lit(0.0)
    empty = (b["width"] < 0) | (b["height"] < 0) if image else (b["width"] <= 0) | (b["height"] <= 0)
    valid, same = _finite(b), F.col("p_page").eqNullSafe(page)
    caption, owned = F.col("type") == "caption", F.coalesce(F.col("o_type").isin("image", "table"), F.lit(False))
    rules = F.array(
        code(~valid, "bbox_invalid"),
        code(valid & empty, "bbox_extent"),
        code(valid & F.col("pw").isNull(), "element_page"),
        code(valid & ~_within(b, zero, zero, F.col("pw"), F.col("ph"), eps), "bbox_outside_page"),
        code(valid & F.col("p_type").isNull() & (F.col("parent_id").isNotNull() | F.col("role").isin("line", "cell")), "parent_missing"),
        code(valid & _finite(pb) & ~same, "parent_page"),
        code(valid & _finite(pb) & same & ~_within(b, pb["x"], pb["y"], pb["x"] + pb["width"], pb["y"] + pb["height"], eps), "parent_bounds"),
        code(valid & caption & ~owned, "caption_owner"),
        code(valid & caption & owned & _finite(F.col("o_box")) & ~F.col("o_page").eqNullSafe(page), "caption_page"),
    )
    one = e.select(KEY, F.col("id").alias("element_id"), F.explode(F.array_compact(rules)).alias("code"))
    halted = untyped.select(KEY, F.col("id").alias("element_id"), F.lit("text_content_type").alias("code"))
    twice = sound.groupBy(KEY, "id").agg(F.count("*").alias("n")).where("n > 1").select(KEY, F.col("id").alias("element_id"), F.lit("duplicate_id").alias("code"))
    order = W.partitionBy(KEY, "role").orderBy("reading_order")
    back = sound.where("reading_order IS NOT NULL").withColumn("before", F.lag("page_number").over(order)).where("page_number < before").select(KEY, F.col("id").alias("element_id"), F.lit("reading_order_page").alias("code"))
    return with_severity(one.unionByName(halted).unionByName(twice).unionByName(back).unionByName(parent_text(sound)))


def with_severity(found: DataFrame) -> DataFrame:
    return found.withColumn("severity", F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error"))


def parent_text(elements: DataFrame) -> DataFrame:
    """Text blocks without lines, and elements whose lines do not spell their text (white space and hyphens aside)."""
    lines = elements.where("type = 'text_line' AND parent_id IS NOT NULL").groupBy(KEY, F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("line_index", F.lit(0)).alias("line_index"), "id", F.coalesce("text", F.lit("")).alias("t")))), lambda r: r["t"]), "").alias("spelled"))
    texts = elements.where("text IS NOT NULL").withColumn("_sign", T.text_signature(F.col("text")))
    both = texts.join(lines, [KEY, "id"], "left")
    needs = _is_text(F.col("type")) & (F.col("type") != "text_line") & (F.col("_sign") != "")
    code = F.when(F.col("spelled").isNull() & needs, "missing_text_lines").when(F.col("spelled").isNotNull() & (T.text_signature(F.col("spelled")) != F.col("_sign")), "parent_text")
    return both.select(KEY, F.col("id").alias("element_id"), code.alias("code")).where("code IS NOT NULL")


def page_findings(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(artifact_id, element_id null, code): no elements or pages, page numbers that repeat or are not positive, page sizes that are not."""
    none = F.lit(None).cast("string")
    every = elements.select(KEY).distinct().withColumn("e", F.lit(1)).join(pages.select(KEY).distinct().withColumn("p", F.lit(1)), KEY, "full_outer")
    out = every.where("e IS NULL OR p IS NULL").select(KEY, none.alias("element_id"), F.lit("empty_gt").alias("code"))
    twice = pages.groupBy(KEY, "page_number").agg(F.count("*").alias("n")).where("n > 1").select(KEY).distinct().select(KEY, none.alias("element_id"), F.lit("duplicate_page").alias("code"))
    good = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    code = F.when(~(good("width") & good("height")), "page_size").when(F.col("page_number") < 1, "page_number")
    return out.unionByName(twice).unionByName(pages.select(KEY, none.alias("element_id"), code.alias("code")).where("code IS NOT NULL"))


def container_findings(nested: DataFrame, containers: DataFrame, elements: DataFrame, eps: float = TOLERANCE_PDF) -> DataFrame:
    """nested: elements as containers hold them (artifact_id, page_number of the enclosing page, container_id, id, type, text, bbox, element_page); containers (artifact_id, page_number, container_id, element_count, bbox or null, bbox_page).

    The flat copy and the container's must agree; lines and cells lie in exactly one container.
    """
    flat = _by_id(elements, F.col("id"), F.lit(True).alias("known"), F.col("type").alias("f_type"), F.col("text").alias("f_text"), F.col("bbox").alias("f_box"))
    home = [KEY, "page_number", "container_id"]
    around = containers.select(*home, F.col("bbox").alias("c_box")).dropDuplicates(home)
    n = nested.join(flat, [KEY, "id"], "left").join(around, home, "left")
    b, cb = F.col("bbox"), F.col("c_box")
    known = F.col("known").isNotNull()
    same = F.col("type").eqNullSafe(F.col("f_type")) & F.col("text").eqNullSafe(F.col("f_text")) & b.eqNullSafe(F.col("f_box"))
    inside = _within(b, cb["x"], cb["y"], cb["x"] + cb["width"], cb["y"] + cb["height"], eps)
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    rules = F.array(code(~known, "container_orphan"), code(known & ~same, "container_copy"), code(~F.col("element_page").eqNullSafe(F.col("page_number")), "container_page"), code(_finite(cb) & _finite(b) & ~inside, "container_bounds"))
    out = n.select(KEY, F.col("id").alias("element_id"), F.explode(F.array_compact(rules)).alias("code"))
    held = nested.groupBy(KEY, "id").agg(F.count("*").alias("n"))
    counted = elements.where(_finite(F.col("bbox"))).join(held, [KEY, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    places = F.array(code(F.col("n") > 1, "multiple_containers"), code(F.col("role").isin("line", "cell") & (F.col("n") != 1), "container_missing"))
    out = out.unionByName(counted.select(KEY, F.col("id").alias("element_id"), F.explode(F.array_compact(places)).alias("code")))
    in_each = nested.groupBy(*home).agg(F.count("*").alias("n"))
    c = containers.join(in_each, home, "left")
    odd = F.array(code(~F.col("element_count").eqNullSafe(F.coalesce("n", F.lit(0))), "container_count"), code(_finite(F.col("bbox")) & ~F.col("bbox_page").eqNullSafe(F.col("page_number")), "container_bbox_page"))
    out = out.unionByName(c.select(KEY, F.col("container_id").alias("element_id"), F.explode(F.array_compact(odd)).alias("code")))
    twice = containers.groupBy(*home).agg(F.count("*").alias("n")).where("n > 1").select(KEY, F.lit(None).cast("string").alias("element_id"), F.lit("duplicate_container").alias("code"))
    return out.unionByName(twice.distinct())


def cell_findings(cells: DataFrame, tables: DataFrame, image: bool = False) -> DataFrame:
    """cells (artifact_id, id, parent_id, text, row_index, column_index, rowspan, colspan, source_cell_id, repeated_header); tables, the fragments (artifact_id, id, row_indexes, n_columns, repeated_header_rows)."""
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    of = tables.select(KEY, F.col("id").alias("parent_id"), F.lit(True).alias("owner"), F.coalesce("row_indexes", F.array().cast("array<int>")).alias("rows"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("repeated_header_rows", F.lit(0)).alias("heads"))
    c = cells.join(of, [KEY, "parent_id"], "left")
    row, col, down, right = (F.col(n) for n in ("row_index", "column_index", "rowspan", "colspan"))
    owned = F.col("owner").isNotNull()
    grid = F.coalesce((row >= 0) & (col >= 0) & (down >= 1) & (right >= 1), F.lit(False))
    covered = F.when(grid, F.size(F.array_except(F.sequence(row, row + down - 1), "rows")) == 0).otherwise(True)
    real = owned & grid
    head = F.array_contains(F.slice("rows", 1, F.col("heads")), row)
    named = F.col("source_cell_id").isNotNull() & (F.col("source_cell_id") != "")
    rules = F.array(
        code(~owned, "cell_owner"), code(owned & ~grid, "cell_grid"), code(real & (~covered | (col + right > F.col("n_columns"))), "cell_span"),
        code(real & ~F.col("repeated_header").eqNullSafe(head), "repeated_header_flag"), code(real & ~named, "source_cell_id"),
    )
    out = c.select(KEY, F.col("id").alias("element_id"), F.explode(F.array_compact(rules)).alias("code"))
    by_source = c.where(real & named).groupBy(KEY, "source_cell_id").agg(F.min("id").alias("element_id"), F.count_if(~F.coalesce("repeated_header", F.lit(False))).alias("first"), F.count_distinct(F.coalesce("text", F.lit("\0"))).alias("texts"))
    amiss = F.col("first") > 1 if image else F.col("first") != 1
    seen = F.array(code(amiss, "source_cell_occurrence"), code(F.col("texts") > 1, "repeated_header_text"))
    out = out.unionByName(by_source.select(KEY, "element_id", F.explode(F.array_compact(seen)).alias("code")))
    slots = c.where(real & (down <= F.size("rows")) & (right <= F.col("n_columns"))).select(KEY, "parent_id", "id", F.explode(F.sequence(row, row + down - 1)).alias("r"), F.sequence(col, col + right - 1).alias("cs")).select(KEY, "parent_id", "id", "r", F.explode("cs").alias("c"))
    later = slots.withColumn("before", F.row_number().over(W.partitionBy(KEY, "parent_id", "r", "c").orderBy("id"))).where("before > 1")
    return out.unionByName(later.select(KEY, F.col("id").alias("element_id"), F.lit("cell_overlap").alias("code")).distinct())


def source_findings(items: DataFrame, elements: DataFrame) -> DataFrame:
    """items (artifact_id, source_index from 1, type, text, caption or null) against the blocks made from them; elements also has source_index and page_number."""
    blocks = elements.where("role = 'block'")
    known = items.select(KEY, "source_index", F.lit(True).alias("known"))
    stray = blocks.join(known, [KEY, "source_index"], "left").where("known IS NULL").select(KEY, F.col("id").alias("element_id"), F.lit("source_index").alias("code"))
    part = F.struct("page_number", F.coalesce("reading_order", F.lit(0)).alias("o"), "id", F.coalesce("text", F.lit("")).alias("t"), "type")
    own = blocks.groupBy(KEY, "source_index").agg(F.min("id").alias("element_id"), F.sort_array(F.collect_list(part)).alias("parts"))
    i = items.join(own, [KEY, "source_index"], "left")
    kind = F.col("type")
    textual = kind.isin("paragraph", "text", "text_line") | kind.startswith("heading")
    spelled = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == kind), lambda p: p["t"]), " ")
    captioned = F.exists("parts", lambda p: (p["type"] == "caption") & (p["t"] == F.col("caption")))
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    here = F.col("parts").isNotNull()
    rules = F.array(code(~here, "source_item_missing"), code(here & (F.coalesce("caption", F.lit("")) != "") & ~captioned, "source_caption"), code(here & textual & (T.text_signature(F.col("text")) != T.text_signature(spelled)), "source_text"))
    return stray.unionByName(i.select(KEY, "element_id", F.explode(F.array_compact(rules)).alias("code")))


def transform_findings(images: DataFrame, elements: DataFrame, sources: DataFrame, eps: float = TOLERANCE_IMAGE) -> DataFrame:
    """Elements of image ground truth against those of the page they were made from, by the map stated for the image: (artifact_id, element_id, code, error_px).

    images (artifact_id, width, height, zoom, matrix of six numbers); elements and sources (artifact_id, id, type,
    text, bbox, parent_id), elements also polygon. Boxes go to pixels, through the map, and are cut at the canvas.
    """
    from ..functions import geometry as G

    m = F.col("matrix")
    usable = F.coalesce((F.size(m) == 6) & ~F.exists(m, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    whole = F.when(usable, F.abs(F.get(m, F.lit(0)) * F.get(m, F.lit(4)) - F.get(m, F.lit(1)) * F.get(m, F.lit(3))) >= 1e-12).otherwise(False)
    none = F.lit(None).cast("string")
    bad = images.where(~whole).select(KEY, none.alias("element_id"), F.lit("affine_matrix").alias("code"), F.lit(None).cast("double").alias("error_px"))
    good = images.where(whole).select(KEY, "width", "height", "zoom", "matrix")
    s = sources.select(KEY, "id", F.col("bbox").alias("s_box"), F.col("type").alias("s_type"), F.col("text").alias("s_text"), F.col("parent_id").alias("s_parent"), F.lit(True).alias("wanted"))
    t = elements.select(KEY, "id", "bbox", "polygon", "type", "text", "parent_id", F.lit(True).alias("made"))
    both = s.join(t, [KEY, "id"], "full_outer").join(good, KEY)
    expected = G.apply_affine(G.polygon_of(G.to_pixels(F.col("s_box"), F.col("height") / F.col("zoom"), F.col("zoom"))), [F.get("matrix", F.lit(k)) for k in range(6)])
    both = both.withColumn("expected", F.when(_finite(F.col("s_box")), expected))
    both = both.withColumn("envelope", G.envelope(F.col("expected"), F.col("width"), F.col("height")))
    shaped = F.coalesce((F.size("polygon") == 4) & F.forall("polygon", lambda p: (F.size(p) == 2) & ~F.exists(p, lambda v: v.isNull() | F.isnan(v))) & _finite(F.col("bbox")), F.lit(False))
    off = F.array_max(F.flatten(F.zip_with("polygon", "expected", lambda p, q: F.zip_with(p, q, lambda a, b: F.abs(a - b)))))
    boxed = F.greatest(*[F.abs(F.col(f"bbox.{k}") - F.col(f"envelope.{k}")) for k in ("x", "y", "width", "height")])
    paired = F.col("wanted").isNotNull() & F.col("made").isNotNull()
    both = both.withColumn("error_px", F.when(paired & shaped & F.col("expected").isNotNull(), F.greatest(off, boxed)))
    seen = G.visible_fraction(G.envelope(F.col("expected")), F.col("width"), F.col("height"))
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    rules = F.array(
        code(~paired, "transformed_membership"), code(paired & ~_finite(F.col("s_box")), "source_bbox_invalid"), code(paired & _finite(F.col("s_box")) & ~shaped, "polygon_invalid"),
        code(F.col("error_px") > eps, "transformed_geometry"), code(paired & ~(F.col("type").eqNullSafe(F.col("s_type")) & F.col("text").eqNullSafe(F.col("s_text"))), "transformed_content"),
        code(paired & ~F.col("parent_id").eqNullSafe(F.col("s_parent")), "transformed_reference"),
        code(paired & (seen < 1e-9), "fully_clipped"), code(paired & (seen >= 1e-9) & (seen < 1 - 1e-9), "partially_clipped"),
    )
    return bad.unionByName(both.select(KEY, F.col("id").alias("element_id"), F.explode(F.array_compact(rules)).alias("code"), "error_px"))


def order_coverage(elements: DataFrame, listed: DataFrame) -> DataFrame:
    """Elements that the order list (artifact_id, kind, id) leaves out, and ids in it that do not exist."""
    have = elements.select(KEY, F.col("role").alias("kind"), "id").where("kind IN ('block', 'line')").distinct()
    named = listed.select(KEY, "kind", "id").distinct()
    a = have.join(named, [KEY, "kind", "id"], "left_anti").withColumn("side", F.lit("unlisted"))
    return a.unionByName(named.join(have, [KEY, "kind", "id"], "left_anti").withColumn("side", F.lit("unknown")))


def parent_cycles(elements: DataFrame) -> DataFrame:
    """Elements on or below a cycle of parents.

    Pointer doubling: who still has an ancestor after as many steps as the largest artifact has elements never comes to
    an end. It stops sooner, where nobody has an ancestor left.
    """
    up = elements.select(KEY, "id", F.col("parent_id").alias("at")).where("at IS NOT NULL").dropDuplicates([KEY, "id"])
    up = materialise(up, "parents")
    most = up.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps <= most:
        nxt = up.select(KEY, F.col("id").alias("at"), F.col("at").alias("further"))
        before, up = up, materialise(up.join(nxt, [KEY, "at"]).select(KEY, "id", F.col("further").alias("at")), "parents")
        discard(before)
        if up.isEmpty():
            break
        steps *= 2
    return up.select(KEY, F.col("id").alias("element_id"), F.lit("parent_cycle").alias("code"))


def verdict(found: DataFrame) -> DataFrame:
    """Of each artifact with findings: errors and warnings; it passes without errors."""
    return found.groupBy(KEY).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)
