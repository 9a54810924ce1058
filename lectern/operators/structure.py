"""Layout elements: labels, visible blocks, and structure metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import text as T

#: Other names of element types.
ALIASES = {**dict.fromkeys(["section_header", "section-header", "heading1", "heading2", "heading3", "title"], "heading"), **dict.fromkeys(["text", "text_line", "list_item"], "paragraph"), **dict.fromkeys(["picture", "figure"], "image"), **dict.fromkeys(["formula", "equation"], "formula")}
LATE = 1_000_000_000


def normalize_label(label: Column) -> Column:
    plain = F.replace(F.lower(F.btrim(F.when(label.isNull() | (label == ""), "unknown").otherwise(label))), F.lit(" "), F.lit("_"))
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, plain), plain)


def text_blocks(lines: DataFrame, parents: DataFrame | None = None, key: str = "artifact_id") -> DataFrame:
    """Lines (id, parent_id, line_index, reading_order, owner_type, text, bbox, ord) joined into blocks.

    Lines of tables and blank ones are left out. A block's text joins its lines by line_index, then reading_order; its box
    surrounds them; its reading order is its parent's (parents: key, id, reading_order), else the least of its lines.
    """
    seen = lines.where((F.coalesce("owner_type", F.lit("")) != "table") & (F.btrim(F.coalesce("text", F.lit(""))) != ""))
    late = lambda c: F.coalesce(c, F.lit(LATE))
    row = F.struct(late("line_index").alias("a"), late("reading_order").alias("b"), F.col("ord"), F.col("text"))
    box = {n: F.col(f"bbox.{n}") for n in ("x", "y", "width", "height")}
    flat = seen.select(key, F.coalesce("parent_id", "id").alias("block_id"), row.alias("row"), "reading_order", "ord", *[c.alias(n) for n, c in box.items()])
    out = flat.groupBy(key, "block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["text"]), " ").alias("text"), F.count("*").alias("n_lines"), F.min("reading_order").alias("line_order"), F.min("ord").alias("first_ord"), *G.union_of())
    if parents is None:
        return out.withColumnRenamed("line_order", "reading_order")
    own = parents.select(key, F.col("id").alias("block_id"), F.col("reading_order").alias("own_order"))
    return out.join(own, [key, "block_id"], "left").withColumn("reading_order", F.coalesce("own_order", "line_order")).drop("own_order", "line_order")


def structure_metrics(matches: DataFrame, predicted: DataFrame, key: str = "artifact_id") -> DataFrame:
    """matches (key, gt_index, gt_type, pred_index, pred_type, iou) of all of gt, against all predictions: detection, types and the weighted score. Zero, not null, without matches."""
    right = F.col("gt_type") == F.col("pred_type")
    by_gt = matches.groupBy(key).agg(F.count("*").alias("num_gt"), F.count("pred_index").alias("num_matched"), F.count_if(F.col("pred_index").isNotNull() & right).alias("type_correct"), F.avg(F.when(F.col("pred_index").isNotNull(), F.col("iou"))).alias("mean_matched_iou"))
    whole = by_gt.join(predicted.groupBy(key).agg(F.count("*").alias("num_predicted")), key, "full_outer").fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    f1 = lambda p, r: F.coalesce(F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r)), F.lit(0.0))
    out = whole.withColumn("precision", share("num_matched", "num_predicted")).withColumn("recall", share("num_matched", "num_gt")).withColumn("f1", f1("precision", "recall")).withColumn("type_accuracy", share("type_correct", "num_matched"))
    out = out.withColumn("type_precision", share("type_correct", "num_predicted")).withColumn("type_recall", share("type_correct", "num_gt")).withColumn("type_f1", f1("type_precision", "type_recall"))
    return out.withColumn("structure_score", 0.4 * F.col("f1") + 0.3 * F.col("mean_matched_iou") + 0.3 * F.col("type_accuracy"))


def per_type_metrics(matches: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Long rows (key, type, n_gt, n_predicted, n_correct, precision, recall, f1) over the types of either side; predicted has pred_type."""
    gt = matches.groupBy(*key, F.col("gt_type").alias("type")).agg(F.count("*").alias("n_gt"), F.count_if(F.col("pred_index").isNotNull() & (F.col("gt_type") == F.col("pred_type"))).alias("n_correct"))
    pr = predicted.groupBy(*key, F.col("pred_type").alias("type")).agg(F.count("*").alias("n_predicted"))
    out = gt.join(pr, [*key, "type"], "full_outer").fillna(0).withColumn("type", F.replace("type", F.lit("-"), F.lit("_")))
    p, r = F.coalesce(F.try_divide("n_correct", "n_predicted"), F.lit(0.0)), F.coalesce(F.try_divide("n_correct", "n_gt"), F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def words_to_lines(words: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Recognised words (level, block_num, par_num, line_num, ord, left, top, width, height, conf, text) joined into lines.

    Words are of level 5 and not blank; a line's confidence is the mean of its positive ones, or 0.
    """
    real = words.where((F.col("level") == 5) & (F.btrim("text") != ""))
    row = F.struct("ord", F.btrim("text").alias("t"))
    out = real.groupBy(key, "block_num", "par_num", "line_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["t"]), " ").alias("text"), F.min("ord").alias("first_ord"), F.round(F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)), 2).alias("confidence"), *G.union_of("left", "top"))
    return out.withColumn("id", F.concat(F.lit("ocr_line_"), F.row_number().over(W.partitionBy(key).orderBy("first_ord")) - 1)).withColumnRenamed("x", "left").withColumnRenamed("y", "top")


def structure_elements(visible: DataFrame, blocks: DataFrame, key: list[str], unique_blocks: bool = False) -> DataFrame:
    """(key, id, type, text, reading_order, x, y, width, height, n_lines) of what a page shows.

    visible: elements that containers of the page hold (key, id, type, text, parent_id, owner_type, line_index, reading_order, bbox,
    ord); blocks (key, id, type, text, bbox, reading_order), the page's flat ones of role block. Lines with text make up the block
    they belong to; a block that is no text counts once something of it is seen. What tables own is left out. With
    unique_blocks a block that has lines is not listed a second time.
    """
    late = lambda c: F.coalesce(c, F.lit(LATE))
    owner = F.coalesce(F.nullif("parent_id", F.lit("")), "id")
    seen = visible.where(~F.col("owner_type").eqNullSafe(F.lit("table"))).withColumn("block_id", owner)
    is_line = (F.lower("type") == "text_line") & (F.btrim(F.coalesce("text", F.lit(""))) != "")
    row = F.struct(late("line_index").alias("a"), late("reading_order").alias("b"), F.col("ord"), F.btrim("text").alias("t"))
    flat = seen.where(is_line).select(*key, "block_id", row.alias("row"), late("reading_order").alias("_o"), *[F.col(f"bbox.{n}").alias(n) for n in ("x", "y", "width", "height")])
    joined = flat.groupBy(*key, "block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["t"]), " ").alias("text"), F.min("_o").alias("_o"), F.count("*").alias("n_lines"), *G.union_of())
    b = blocks.select(*key, F.col("id").alias("block_id"), F.col("type").alias("b_type"), F.col("text").alias("b_text"), F.col("bbox").alias("b_box"), F.col("reading_order").alias("b_order"))
    texts = joined.join(b, [*key, "block_id"], "left").select(*key, "block_id", normalize_label(F.coalesce("b_type", F.lit("paragraph"))).alias("type"), "text", F.coalesce("b_order", "_o").alias("reading_order"), "x", "y", "width", "height", "n_lines")
    other = seen.where(~is_line & F.col("bbox").isNotNull() & (F.col("block_id") != "")).select(*key, "block_id").distinct()
    shown = b.where(F.col("b_box").isNotNull() & ~normalize_label(F.col("b_type")).isin("paragraph", "heading")).join(other, [*key, "block_id"], "left_semi")
    if unique_blocks:
        shown = shown.join(joined.select(*key, "block_id"), [*key, "block_id"], "left_anti")
    rest = shown.select(*key, "block_id", normalize_label(F.col("b_type")).alias("type"), F.coalesce("b_text", F.lit("")).alias("text"), late("b_order").alias("reading_order"), *[F.col(f"b_box.{n}").alias(n) for n in ("x", "y", "width", "height")], F.lit(0).cast("long").alias("n_lines"))
    return texts.unionByName(rest).withColumnRenamed("block_id", "id")


def semantic_ordering(gt: DataFrame, predicted: DataFrame, key: str = "artifact_id", least: float = 0.3, most_span: int = 3) -> DataFrame:
    """A row for each page of gt blocks (key, gt_index, text, bbox) and predicted ones (key, pred_index, text, bbox), in reading order: rates of the joined texts, token bags, pair order and matched shares."""
    from . import matching as M
    from . import ordering as O

    joined = lambda d, i, name: d.groupBy(key).agg(T.join_ordered(F.transform(F.sort_array(F.collect_list(F.struct(i, "text"))), lambda r: F.coalesce(r["text"], F.lit("")))).alias(name), F.count("*").alias(f"n_{name}"))
    texts = joined(gt, "gt_index", "gt_text").join(joined(predicted, "pred_index", "predicted_text"), key, "full_outer").fillna("", ["gt_text", "predicted_text"]).fillna(0, ["n_gt_text", "n_predicted_text"])
    rated = texts.withColumn("ordered_cer", T.cer(F.col("gt_text"), F.col("predicted_text"))).withColumn("ordered_wer", T.wer(F.col("gt_text"), F.col("predicted_text")))
    bags = O.token_bags(texts, F.col("gt_text"), F.col("predicted_text"), key).select(key, "token_precision", "token_recall", "token_f1")
    found = M.semantic_match(gt, predicted, least, most_span, key=key)
    ranked = gt.select(key, "gt_index", F.row_number().over(W.partitionBy(key).orderBy("gt_index")).alias("rank"))
    first = found.join(ranked.withColumnRenamed("gt_index", "first"), [key, "first"])
    units = first.select(key, F.col("pred_index").alias("group"), F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("span") - 1)).alias("rank"))
    pairs = O.pair_counts(units, key)
    shares = found.groupBy(key).agg(F.sum("span").alias("num_matched_gt_blocks"), F.count("*").alias("num_matched"))
    out = rated.join(bags, key, "left").join(shares, key, "left").join(pairs.drop("units"), key, "left").fillna(0, ["num_matched_gt_blocks", "num_matched", "concordant", "discordant", "unresolved", "token_precision", "token_recall", "token_f1"])
    out = O.order_statistics(out.withColumn("units", F.col("n_gt_text")))
    one = F.lit(1)
    out = out.withColumn("matched_block_ratio", F.col("num_matched_gt_blocks") / F.greatest(one, "n_gt_text")).withColumn("matched_prediction_ratio", F.col("num_matched") / F.greatest(one, "n_predicted_text"))
    return out.withColumnRenamed("n_gt_text", "num_gt_blocks").withColumnRenamed("n_predicted_text", "num_predicted_blocks").drop("gt_text", "predicted_text", "num_matched")
