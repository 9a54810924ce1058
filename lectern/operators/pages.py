"""Pages and tables: columns of a page, places of table cells, and ground truth of page images."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import geometry as G

#: Columns by layout type; others have one.
COLUMNS = {"two_column": 2, "three_column": 3}


def page_columns(templates: DataFrame, key: str = "template") -> DataFrame:
    """(key, container_id, x, y, width, height, problem) of templates (key, page_width, page_height, layout_type, gutter, top, bottom, left, right).

    A template without room, or with sizes that are not finite and positive or margins below zero, has one row with its problem.
    """
    n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLUMNS.items() for x in kv]), F.col("layout_type")), F.lit(1))
    finite = lambda *cs: F.forall(F.array(*cs), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    c = F.col
    margins = [c("top"), c("bottom"), c("left"), c("right")]
    wide, high = c("page_width") - c("left") - c("right") - c("gutter") * (n - 1), c("page_height") - c("top") - c("bottom")
    problem = F.when(~finite(c("page_width"), c("page_height")) | (c("page_width") <= 0) | (c("page_height") <= 0), "page_size").when(~finite(*margins) | (F.least(*margins) < 0), "margins").when(~finite(c("gutter")) | (c("gutter") < 0) | (wide <= 0) | (high <= 0), "no_room")
    out = templates.withColumn("problem", problem).withColumn("n", n).withColumn("w", wide / n).withColumn("h", high)
    each = out.withColumn("i", F.explode(F.when(c("problem").isNotNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), c("n") - 1))))
    good = lambda v: F.when(c("problem").isNull(), v)
    name = F.when(c("n") == 1, "main_content").otherwise(F.concat(F.lit("column_"), c("i") + 1))
    return each.select(key, good(name).alias("container_id"), good(c("left") + c("i") * (c("w") + c("gutter"))).alias("x"), good(c("bottom")).alias("y"), good(c("w")).alias("width"), good(c("h")).alias("height"), "problem")


def place_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, row_index, pos, column_index, problem) of cells (key, row_index, pos, rowspan, colspan), row by row from the left into what earlier cells leave free.

    problem: overlap where a cell's right part meets one that reaches down from above, rowspan where it goes below the last
    row. A table is one group, bounded by nature; only the columns that cells above still hold are kept in memory.
    """
    return placed_cells(cells.select(*key, "row_index", "pos", "rowspan", "colspan"), key).select(*key, "row_index", "pos", "column_index", "problem")


@F.arrow_udf(ArrayType(StructType([StructField("column_index", IntegerType()), StructField("problem", StringType())])))
def _places(row: pa.Array, down: pa.Array, right: pa.Array) -> pa.Array:
    """Where the cells of each table lie, its cells in order of row and place."""
    columns, problems, ends = [], [], [0]
    for rows, downs, rights in zip(row.to_pylist(), down.to_pylist(), right.to_pylist(), strict=True):
        last = rows[-1] if rows else 0
        until: dict[int, int] = {}  # column: the row at which it is free again
        at, column = None, 0
        for r, d, w in zip(rows, downs, rights, strict=True):
            if r != at:
                at, column = r, 0
            while until.get(column, 0) > r:
                column += 1
            span = range(column, column + w)
            clash = any(until.get(x, 0) > r for x in span)
            columns.append(column)
            problems.append("overlap" if clash else "rowspan" if r + d > last + 1 else None)
            until.update(dict.fromkeys(span, r + d))
            column += w
        ends.append(len(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(columns, pa.int32()), pa.array(problems, pa.string())], names=["column_index", "problem"]))


def placed_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """cells with column_index and problem, as of place_cells(), dealt out by key."""
    one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))).cast("int")
    cell = F.struct(F.col("row_index").cast("int").alias("_row"), F.col("pos").cast("int").alias("_pos"), one(F.col("rowspan")).alias("_down"), one(F.col("colspan")).alias("_right"), *[c for c in cells.columns if c not in key])
    tables = cells.groupBy(*key).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    placed = tables.withColumn("places", _places("cells._row", "cells._down", "cells._right"))
    each = placed.select(*key, F.inline(F.arrays_zip("cells", "places"))).select(*key, "cells.*", "places.*")
    return each.withColumn("row_index", F.col("_row")).withColumn("pos", F.col("_pos")).drop("_row", "_pos", "_down", "_right")


def table_audit(cells: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
    """audit_of() of cells and where place_cells() puts them."""
    return audit_of(cells.join(placed, [*key, "row_index", "pos"]), key)


def audit_of(placed: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows, columns, cells, merged_cells, header_rows, problem) of each table of placed_cells(). header_rows: the rows from the top on in which all cells with text are headers, at least one of them not a row's own, and what their cells reach down to."""
    heads = F.count_if("is_header")
    head = (heads > 0) & (F.count_if(~F.col("is_header") & (F.btrim("text") != "")) == 0) & (F.count_if(F.col("is_header") & ~F.coalesce(F.col("scope").isin("row", "rowgroup"), F.lit(False))) > 0)
    by_row = placed.groupBy(*key, "row_index").agg(head.alias("head"), F.max(F.col("row_index") + F.col("rowspan")).alias("reach"), F.max(F.col("column_index") + F.col("colspan")).alias("right"), F.count("*").alias("n"), F.count_if((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("merged"), F.min("problem").alias("problem"))
    whole = by_row.groupBy(*key).agg((F.max("row_index") + 1).alias("rows"), F.max("right").alias("columns"), F.sum("n").alias("cells"), F.sum("merged").alias("merged_cells"), F.min("problem").alias("problem"), F.sort_array(F.collect_list(F.struct("row_index", "head", "reach"))).alias("_rows"))
    other = F.array_position(F.col("_rows.head"), F.lit(False)).cast("int")
    first = F.when(other == 0, F.size("_rows")).otherwise(other - 1)
    # rows that a header's cells reach down to belong to the header
    grown = F.aggregate("_rows", first, lambda s, r: F.when(r["row_index"] < s, F.greatest(s, r["reach"])).otherwise(s))
    return whole.select(*key, "rows", "columns", "cells", "merged_cells", "problem", grown.alias("header_rows"))


def cell_coverage(source: DataFrame, made: DataFrame, key: list[str]) -> DataFrame:
    """(key, missing, extra): cells (key, table_id, row_index, column_index) of the source that ground truth lacks, and the reverse; repeated ones count once."""
    cell = [*key, "table_id", "row_index", "column_index"]
    a, b = source.select(*cell).distinct().withColumn("a", F.lit(1)), made.select(*cell).distinct().withColumn("b", F.lit(1))
    return a.join(b, cell, "full_outer").groupBy(*key).agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


def image_elements(elements: DataFrame, images: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Elements of a page as those of its image: (key, id, ..., bbox and polygon in pixels, source_bbox, visibility).

    elements (key, id, page_number or null for any, bbox in points from the page's foot); images (key, source_page, page_height,
    zoom, matrix of six numbers, width, height). Elements of other pages and without a box are left out.
    """
    i = images.select(key, "source_page", "page_height", "zoom", "matrix", F.col("width").alias("_w"), F.col("height").alias("_h"))
    here = elements.join(i, key).where(F.col("bbox").isNotNull() & (F.coalesce("page_number", "source_page") == F.col("source_page")))
    corners = G.apply_affine(G.polygon_of(F.col("_px")), [F.get("matrix", F.lit(k)) for k in range(6)])
    moved = here.withColumn("_px", G.to_pixels(F.col("bbox"), F.col("page_height"), F.col("zoom"))).withColumn("polygon", corners)
    moved = moved.withColumn("source_bbox", F.col("bbox")).withColumn("bbox", G.envelope(F.col("polygon"), F.col("_w"), F.col("_h")))
    seen = G.box_visibility(G.envelope(F.col("polygon")), F.col("_w"), F.col("_h"))
    return moved.withColumn("visibility", seen).withColumn("page_number", F.lit(1)).drop("_px", "_w", "_h", "matrix", "zoom", "page_height", "source_page")


def visible_order(order: DataFrame, elements: DataFrame, key: str = "artifact_id") -> DataFrame:
    """An order list (key, kind, pos, id) restricted to the ids of elements, its order kept: pos counts anew from 0."""
    kept = order.join(elements.select(key, "id").distinct(), [key, "id"], "left_semi")
    return kept.withColumn("pos", F.row_number().over(W.partitionBy(key, "kind").orderBy("pos")) - 1)


def break_lines(text: Column, width: Column | int) -> Column:
    """Array of lines of at most width characters (2 or more), filled greedily at spaces; a longer word is cut to fill lines.

    Each match takes as many whole words as fit, or else width characters of one word, so the text is read once.
    """
    n = width if isinstance(width, Column) else F.lit(width)
    words = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    line = F.format_string(r"\S(?:.{0,%d}\S)?(?: |$)|\S{%d}", n - 2, n)
    return F.transform(F.regexp_extract_all(words, line, F.lit(0)), lambda x: F.rtrim(x))


#: What a word may ask of its column at most (font sizes), the share of a table that a column may ask for, and the rank of its typical cell.
WORD_SIZES, MOST_SHARE, TYPICAL = 6.0, 0.55, 0.75


def column_widths(cells: DataFrame, key: list[str], width: float, font_size: float, padding: float) -> DataFrame:
    """(key, column_index, width, problem) of tables whose columns share a width by what their cells need.

    cells (key, column_index, colspan, text_width, word_width and character_width of the widest, is_header). Cells over several
    columns only say which columns there are. A table whose characters alone don't fit has no widths and the problem no_room.
    """
    c, pad = F.col, 2.0 * padding
    own = lambda v: F.when(c("colspan") == 1, v)
    spread = cells.withColumn("column_index", F.explode(F.sequence(c("column_index"), c("column_index") + c("colspan") - 1)))
    sizes = F.sort_array(F.collect_list(own(c("text_width") + pad)))
    by = spread.groupBy(*key, "column_index").agg(
        sizes.alias("sizes"), F.max(own(F.when(c("is_header"), c("text_width") + pad))).alias("header"),
        F.greatest(F.lit(pad + font_size), F.max(own(c("character_width") + pad))).alias("least"),
        F.max(own(F.least(c("word_width"), F.lit(WORD_SIZES * font_size)) + pad)).alias("word"),
    )
    rank = F.floor((F.size("sizes") - 1) * TYPICAL).cast("int")
    by = by.withColumn("word", F.greatest("least", "word")).withColumn("typical", F.when(F.size("sizes") > 0, F.get("sizes", rank)))
    every = W.partitionBy(*key)
    total = lambda v: F.sum(v).over(every)
    by = by.withColumn("_least", total(c("least"))).withColumn("_word", total(c("word")))
    share = F.try_divide(width - c("_least"), c("_word") - c("_least"))
    by = by.withColumn("base", F.when(c("_word") > width, c("least") + share * (c("word") - c("least"))).otherwise(c("word")))
    by = by.withColumn("wish", F.greatest("base", F.least(F.lit(MOST_SHARE * width), F.greatest(F.coalesce("typical", "base"), "header"))))
    by = by.withColumn("_base", total(c("base"))).withColumn("_wish", total(c("wish")))
    spare, asked = F.greatest(F.lit(0.0), width - c("_base")), c("_wish") - c("_base")
    given = F.when(asked > spare, c("base") + spare * F.try_divide(c("wish") - c("base"), asked)).otherwise(c("wish") * width / c("_wish"))
    fits = c("_least") <= width
    return by.select(*key, "column_index", F.when(fits, given).alias("width"), F.when(~fits, "no_room").alias("problem"))


def fit_figures(figures: DataFrame, gap: float = 6.0) -> DataFrame:
    """figures with drawn_width, drawn_height, total_height (with caption and gap), x and problem: scaled in proportion into their frame, centred in the column.

    figures (native_width, native_height, frame_width, frame_height, column_x, column_width, page_height, caption_height, 0 for none).
    """
    c = F.col
    sizes = F.array("native_width", "native_height", "frame_width", "frame_height")
    below = c("caption_height") + F.when(c("caption_height") > 0, gap).otherwise(0.0)
    bad = F.when(F.coalesce(F.exists(sizes, lambda v: v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))), F.lit(True)), "figure_size").when(below >= c("page_height"), "caption_height")
    ratio = lambda v, of: F.try_divide(v, c(of))
    frame = F.least(ratio(c("frame_width"), "native_width"), ratio(c("frame_height"), "native_height"), ratio(c("column_width"), "native_width"))
    scale = F.when(bad.isNull(), F.least(frame, ratio(c("page_height") - below, "native_height")))
    wide = scale * c("native_width")
    return figures.select("*", wide.alias("drawn_width"), (scale * c("native_height")).alias("drawn_height"), (scale * c("native_height") + below).alias("total_height"), (c("column_x") + (c("column_width") - wide) / 2).alias("x"), bad.alias("problem"))


def table_fragments(rows: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """(key, fragment_index, frame_index, first_row, rows, repeated_header_rows, height, problem): tables cut to fit frames, header rows repeated.

    rows (key, row_index from 0, height, reach: the row below the lowest that its cells go down to); tables (key, header_rows,
    caption_height, first_room of the frame begun already, room of all others). Rows that cells join, and the header with what
    follows it, stay together; each fragment takes all that fits. A group taller than a frame gives its table one row, with
    the problem row_height. A table is one group, bounded by nature, and is folded in the JVM.
    """
    c, at = F.col, W.partitionBy(*key).orderBy("row_index")
    known = rows.join(tables.select(*key, "header_rows"), key)
    last = c("row_index") == F.max("row_index").over(W.partitionBy(*key))
    ends = (F.max("reach").over(at) <= c("row_index") + 1) & (c("row_index") >= c("header_rows")) | last
    parts = known.withColumn("_ends", ends.cast("int")).withColumn("_part", F.sum("_ends").over(at) - c("_ends"))
    head = F.sum(F.when(c("row_index") < c("header_rows"), c("height")).otherwise(0.0))
    sums = parts.groupBy(*key, "_part").agg(F.min("row_index").alias("first"), F.count("*").alias("n"), F.sum("height").alias("h"), head.alias("head"))
    whole = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "n", "h"))).alias("parts"), F.sum("head").alias("head")).join(tables, key)
    kind = "array<struct<frame:int,first:int,n:bigint,height:double>>"
    taller = F.exists("parts", lambda g: g["h"] + F.when(g["first"] == 0, c("caption_height")).otherwise(c("head")) > c("room"))

    def step(done: Column, g: Column) -> Column:
        now = F.element_at(done, -1)
        room = F.when(now["frame"] == 0, c("first_room")).otherwise(c("room"))
        grown = F.struct(now["frame"].alias("frame"), now["first"].alias("first"), (now["n"] + g["n"]).alias("n"), (now["height"] + g["h"]).alias("height"))
        fresh = F.struct((now["frame"] + 1).alias("frame"), g["first"].cast("int").alias("first"), g["n"].alias("n"), (c("head") + g["h"]).alias("height"))
        before = F.slice(done, 1, F.size(done) - 1)
        return F.when(now["height"] + g["h"] <= room, F.concat(before, F.array(grown))).otherwise(F.concat(done, F.array(fresh))).cast(kind)

    top = F.get("parts", F.lit(0))
    high = c("caption_height") + top["h"]
    begin = F.array(F.struct(F.when(high <= c("first_room"), 0).otherwise(1).alias("frame"), top["first"].cast("int").alias("first"), top["n"].alias("n"), high.alias("height"))).cast(kind)
    cut = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), begin, step)
    none = F.array(F.struct(*[F.lit(None).alias(x) for x in ("frame", "first", "n", "height")])).cast(kind)
    out = whole.withColumn("problem", F.when(taller, "row_height")).select(*key, "header_rows", "problem", F.posexplode(F.when(c("problem").isNull(), cut).otherwise(none)).alias("i", "f"))
    repeated = F.when(c("f.first").isNotNull(), F.when(c("f.first") > 0, c("header_rows")).otherwise(0)).cast("int")
    return out.select(*key, c("i").alias("fragment_index"), c("f.frame").alias("frame_index"), c("f.first").alias("first_row"), c("f.n").alias("rows"), repeated.alias("repeated_header_rows"), c("f.height").alias("height"), "problem")
