"""Small cases whose answers are known beforehand."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.operators import audit as A
from lectern.operators import matching as M
from lectern.operators import ordering as O
from lectern.operators import quality as Q
from lectern.operators import reports as R
from lectern.operators import structure as X

LINE = f"artifact_id string, gt_index int, text string, bbox {G.BOX}"
PREDICTED = f"artifact_id string, pred_index int, text string, bbox {G.BOX}"
BOX = (0.0, 0.0, 10.0, 10.0)


def page(spark, gt, predicted):
    g = spark.createDataFrame([("p", i, t, b) for i, (t, b) in enumerate(gt)], LINE)
    p = spark.createDataFrame([("p", i, t, b) for i, (t, b) in enumerate(predicted)], PREDICTED)
    return Q.page_metrics(g, p, M.line_match(g, p)).first().asDict()


def test_scalars(spark):
    row = spark.range(1).select(
        G.iou(G.box(0.0, 0.0, 10.0, 10.0), G.box(5.0, 5.0, 10.0, 10.0)).alias("iou"), T.cer(F.lit("abc"), F.lit("axc")).alias("cer"), T.wer(F.lit("hello world"), F.lit("hello")).alias("wer"),
        G.rotation_shear(F.lit(90.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("m"),
    ).first()
    assert (round(row.iou, 4), round(row.cer, 4), row.wer) == (0.1429, 0.3333, 0.5)
    assert row.m == pytest.approx([0, 1, 0, -1, 0, 10], abs=1e-9)


def test_page_metrics(spark):
    far = (100.0, 0.0, 10.0, 10.0)
    m = page(spark, [("hello", BOX)], [("hello", BOX), ("extra words", far)])
    assert (m["mean_cer"], m["char_errors"], m["micro_cer"], m["micro_wer"], m["line_precision"], m["line_recall"]) == (0, 11, 2.2, 2.0, 0.5, 1.0)
    m = page(spark, [("a", BOX), ("b" * 9, far)], [("x", BOX), ("b" * 9, far)])
    assert (m["mean_cer"], m["micro_cer"]) == (0.5, 0.1)
    m = page(spark, [("hello world", BOX)], [])
    assert (m["char_errors"], m["word_errors"], m["micro_cer"]) == (11, 2, 1.0)
    m = page(spark, [], [("hello world", BOX)])
    assert (m["mean_cer"], m["micro_cer"], m["micro_wer"]) == (0, 11, 2)
    m = page(spark, [("ab", BOX)], [("ab", BOX), ("ab", BOX)])
    assert (m["num_matched_lines"], m["false_positives"], m["micro_cer"]) == (1, 1, 1.0)


def test_macro_rates_are_added_in_a_fixed_order(spark):
    """Found lines by their place, then missed ones, whatever the order of predictions and rows."""
    wrong = {0: 1, 1: None, 2: 3, 3: 5}  # of 10 letters; line 1 is missed
    at = [(0.0, 20.0 * i, 10.0, 10.0) for i in wrong]
    gt = spark.createDataFrame([("p", i, "a" * 10, at[i]) for i in wrong], LINE)
    predicted = spark.createDataFrame([("p", 3 - i, "b" * n + "a" * (10 - n), at[i]) for i, n in wrong.items() if n], PREDICTED)

    def mean(*rates):
        total = 0.0
        for r in rates:
            total += r
        return total / len(rates)

    want = mean(0.1, 0.3, 0.5, 1.0)
    assert want not in (mean(0.1, 1.0, 0.3, 0.5), mean(1.0, 0.5, 0.3, 0.1))
    for g, p in ((gt, predicted), (gt.orderBy(F.desc("gt_index")), predicted.repartition(3)), (gt.repartition(3), predicted)):
        m = Q.page_metrics(g, p, M.line_match(g, p)).first()
        assert (m["num_matched_lines"], m["char_errors"], m["mean_cer"]) == (3, 19, want)
    nulls = spark.range(1).select(Q.mean_in_order(F.lit([0.1, 0.2, 0.3])).alias("a"), Q.mean_in_order(F.array(F.lit(None).cast("double"), F.lit(0.5))).alias("b"), Q.mean_in_order(F.array().cast("array<double>")).alias("c")).first()
    assert tuple(nulls) == (mean(0.1, 0.2, 0.3), 0.5, None)


def test_order_statistics(spark):
    seq = spark.createDataFrame([("merged", 0, 2), ("merged", 0, 1), ("merged", 1, 3), ("turned", 0, 3), ("turned", 1, 1), ("turned", 1, 2)], "artifact_id string, `group` int, rank int")
    got = {r.artifact_id: r for r in O.order_statistics(O.pair_counts(seq)).collect()}
    m, t = got["merged"], got["turned"]
    assert (m.pairwise_accuracy, m.concordant + m.discordant, m.unresolved, round(m.coverage, 4)) == (1.0, 2, 1, 0.6667)
    assert (t.kendall_tau, t.concordant, t.discordant) == (-1.0, 0, 2)
    same = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "artifact_id string, id string")
    assert [tuple(r) for r in O.duplicate_ids(same).collect()] == [("p", "a", 2)]


def test_semantic_match(spark):
    gt = spark.createDataFrame([("p", 0, "first", None), ("p", 1, "second", None)], LINE)
    predicted = spark.createDataFrame([("p", 0, "First  second", None)], PREDICTED)
    (m,) = M.semantic_match(gt, predicted).collect()
    assert (m["first"], m.span, m.similarity) == (0, 2, 1.0)


def test_structure(spark):
    rows = [("p", 0, "heading", 0, "heading", 1.0), ("p", 1, "image", 1, "paragraph", 1.0)]
    matches = spark.createDataFrame(rows, "artifact_id string, gt_index int, gt_type string, pred_index int, pred_type string, iou double")
    predicted = spark.createDataFrame([("p", i, t) for i, t in enumerate(("heading", "paragraph", "table"))], "artifact_id string, pred_index int, pred_type string")
    m = X.structure_metrics(matches, predicted).first()
    assert (m.recall, round(m.precision, 4), m.type_accuracy) == (1.0, 0.6667, 0.5)


def test_calibration_pools_complete_pages(spark):
    row = lambda page, profile, errors, chars: (page, profile, errors, 0, chars, 10, 1, 1, 1)
    results = [row("a", "clean", 4, 100), row("a", "n1", 10, 100), row("b", "clean", 6, 200), row("b", "n1", 20, 200)]
    ddl = "page_id string, profile string, char_errors long, word_errors long, gt_char_count long, gt_word_count long, num_gt_lines long, num_predicted_lines long, num_matched_lines long"
    pages = spark.createDataFrame([("a", "en", "t"), ("b", "en", "t"), ("c", "en", "t")], "page_id string, language string, template string")
    conds = spark.createDataFrame([("blur", 1, "n1")], "operation string, level int, condition string")
    got = R.calibration_curves(R.pair_conditions(pages, conds, spark.createDataFrame(results, ddl))).where("scope = 'overall'").first()
    assert (got.num_pairs, round(got.clean_micro_cer, 4), round(got.noisy_micro_cer, 4), round(got.delta_micro_cer, 4)) == (2, 0.0333, 0.1, 0.0667)


ELEMENT = f"artifact_id string, ord int, id string, type string, role string, parent_id string, owner_id string, page_number int, bbox {G.BOX}, text string, line_index int, reading_order int, source_index int"
GOOD = [
    ("d", 0, "p", "paragraph", "block", None, None, 1, (10.0, 10.0, 50.0, 20.0), "Alpha beta", None, 1, 1),
    ("d", 1, "l", "text_line", "line", "p", None, 1, (10.0, 10.0, 40.0, 10.0), "Alpha be-ta", 0, 1, 1),
]


def changed(k, **new):
    names = [x.split()[0] for x in ELEMENT.replace(G.BOX, "b").split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in GOOD]
    rows[k] |= new
    return [tuple(r.values()) for r in rows]


@pytest.mark.parametrize(
    ("rows", "codes"),
    [
        (GOOD, set()),
        (changed(1, id="p"), {"duplicate_id"}),
        (changed(1, bbox=None), {"bbox_invalid"}),
        (changed(1, bbox=(10.0, 10.0, 0.0, 10.0)), {"bbox_extent"}),
        (changed(1, page_number=3), {"element_page", "parent_page"}),
        (changed(1, bbox=(10.0, 10.0, 95.0, 10.0)), {"bbox_outside_page", "parent_bounds"}),
        (changed(1, parent_id="gone"), {"parent_missing", "missing_text_lines"}),
        (changed(1, parent_id=None), {"parent_missing", "missing_text_lines"}),
        (changed(1, text="Alpha"), {"parent_text"}),
        (changed(1, text=None), {"text_content_type"}),
        (changed(0, type="caption"), {"caption_owner"}),
    ],
)
def test_audit_codes(spark, rows, codes):
    pages = spark.createDataFrame([("d", 1, 100.0, 80.0)], "artifact_id string, page_number int, width double, height double")
    found = {r.code for r in A.findings(spark.createDataFrame(rows, ELEMENT), pages).collect()}
    assert found == codes


def test_page_and_source_findings(spark):
    e = spark.createDataFrame(GOOD, ELEMENT)
    pages = spark.createDataFrame([("d", 1, 100.0, 80.0), ("d", 1, 100.0, 80.0), ("d", 0, 1.0, 1.0), ("d", 2, 0.0, 1.0), ("q", 1, 1.0, 1.0)], "artifact_id string, page_number int, width double, height double")
    assert {(r.artifact_id, r.code) for r in A.page_findings(e, pages).collect()} == {("d", "duplicate_page"), ("d", "page_number"), ("d", "page_size"), ("q", "empty_gt")}
    items = [("d", 1, "paragraph", "Alpha  beta!", "Cap"), ("d", 2, "image", None, None)]
    found = A.source_findings(spark.createDataFrame(items, "artifact_id string, source_index int, type string, text string, caption string"), e)
    assert {r.code for r in found.collect()} == {"source_text", "source_caption", "source_item_missing"}


def test_cell_findings(spark):
    cells = [("d", "a", "t", "x", 0, 0, 1, 2, "s1", False), ("d", "b", "t", "y", 0, 1, 1, 1, "s2", False), ("d", "c", "t", "z", 1, 0, 2, 1, None, False), ("d", "e", "u", "z", 0, 0, 1, 1, "s4", False), ("d", "f", "t", "z", -1, 0, 1, 1, "s5", False), ("d", "g", "t", "z", 1, 1, 1, 1, "s1", True)]
    ddl = "artifact_id string, id string, parent_id string, text string, row_index int, column_index int, rowspan int, colspan int, source_cell_id string, repeated_header boolean"
    tables = spark.createDataFrame([("d", "t", [0, 1], 2, 0)], "artifact_id string, id string, row_indexes array<int>, n_columns int, repeated_header_rows int")
    found = {(r.element_id, r.code) for r in A.cell_findings(spark.createDataFrame(cells, ddl), tables).collect()}
    assert found == {("b", "cell_overlap"), ("c", "cell_span"), ("c", "source_cell_id"), ("e", "cell_owner"), ("f", "cell_grid"), ("g", "repeated_header_flag"), ("a", "repeated_header_text")}


def test_transform_findings(spark):
    images = spark.createDataFrame([("d", 200.0, 160.0, 2.0, [1.0, 0.0, 4.0, 0.0, 1.0, 0.0]), ("bad", 1.0, 1.0, 1.0, [0.0] * 6)], "artifact_id string, width double, height double, zoom double, matrix array<double>")
    ddl = f"artifact_id string, id string, type string, text string, bbox {G.BOX}, parent_id string, polygon array<array<double>>"
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    made = [("d", "ok", "t", "x", (24.0, 100.0, 20.0, 20.0), None, box(24.0, 100.0, 20.0, 20.0)), ("d", "off", "t", "x", (25.0, 100.0, 20.0, 20.0), "q", box(25.0, 100.0, 20.0, 20.0)), ("d", "extra", "t", "x", (0.0, 0.0, 1.0, 1.0), None, None)]
    src = [("d", "ok", "t", "x", (10.0, 20.0, 10.0, 10.0), None, None), ("d", "off", "t", "y", (10.0, 20.0, 10.0, 10.0), None, None), ("d", "gone", "t", "x", (10.0, 20.0, 10.0, 10.0), None, None)]
    found = {(r.artifact_id, r.element_id, r.code) for r in A.transform_findings(images, spark.createDataFrame(made, ddl), spark.createDataFrame(src, ddl)).collect()}
    assert found == {("bad", None, "affine_matrix"), ("d", "off", "transformed_geometry"), ("d", "off", "transformed_content"), ("d", "off", "transformed_reference"), ("d", "gone", "transformed_membership"), ("d", "extra", "transformed_membership")}


def test_pairs_are_counted_as_if_made():
    import random

    import numpy as np

    from lectern.operators.ordering import _count_pairs

    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.randint(0, 6), rng.randint(0, 9)) for _ in range(rng.randint(1, 14))]
        pairs = [(a, b) for a in rows for b in rows if a[0] < b[0]]
        want = sum(a[1] < b[1] for a, b in pairs), sum(a[1] > b[1] for a, b in pairs)
        assert _count_pairs(*(np.array(x, np.int64) for x in zip(*rows, strict=True))) == want


def test_cells_are_placed_and_audited(spark):
    from lectern.operators import pages as P

    rng_rows = [("t", 0, 0, 3, 1, True, "a", None), ("t", 0, 1, 1, 1, True, "b", "col"), ("t", 1, 0, 1, 1, False, "c", None), ("t", 2, 0, 1, 2, False, "", None), ("u", 0, 0, 1, 1, False, "x", None), ("v", 0, 0, 1, 1, True, "x", "row")]
    cells = spark.createDataFrame(rng_rows, "k string, row_index int, pos int, rowspan int, colspan int, is_header boolean, text string, scope string")
    placed = P.place_cells(cells, ["k"])
    assert {(r.k, r.row_index, r.pos): (r.column_index, r.problem) for r in placed.collect()} == {("t", 0, 0): (0, None), ("t", 0, 1): (1, None), ("t", 1, 0): (1, None), ("t", 2, 0): (1, None), ("u", 0, 0): (0, None), ("v", 0, 0): (0, None)}
    audit = {r.k: (r.rows, r.columns, r.merged_cells, r.header_rows) for r in P.table_audit(cells, placed, ["k"]).collect()}
    assert audit == {"t": (3, 3, 2, 3), "u": (1, 1, 0, 0), "v": (1, 1, 0, 0)}


def test_semantic_ordering_of_swapped_blocks(spark):
    from lectern.functions import geometry as G
    from lectern.operators import structure as X

    gt = spark.createDataFrame([("a", 0, "one two", None), ("a", 1, "three", None), ("b", 0, "alone", None)], f"artifact_id string, gt_index int, text string, bbox {G.BOX}")
    predicted = spark.createDataFrame([("a", 0, "three", None), ("a", 1, "one two", None), ("c", 0, "stray", None)], f"artifact_id string, pred_index int, text string, bbox {G.BOX}")
    got = {r.artifact_id: r for r in X.semantic_ordering(gt, predicted).collect()}
    assert (got["a"].kendall_tau, got["a"].ordered_wer, got["a"].token_f1, got["a"].matched_block_ratio) == (-1.0, 2 / 3, 1.0, 1.0)
    assert (got["b"].ordered_cer, got["b"].num_predicted_blocks, got["b"].matched_prediction_ratio, got["b"].kendall_tau) == (1.0, 0, 0.0, None)
    assert got["c"].num_gt_blocks == 0 and got["c"].ordered_wer == 1.0
