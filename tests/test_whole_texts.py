"""That lines of texts are all of them, and queries over them against brute force, beside their SQL."""

from collections import Counter, defaultdict

import __spark_entry__
from lectern.plans import registry
from lectern.sources import derived

SF = "/root/testdata/sf0.001"


def _lines(spark, sf=SF):
    """(document, language, place, line): texts cut at line feeds and after 80 characters, without what is blank."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    cut = lambda t: [x[i : i + 80] for x in t.split("\n") for i in range(0, len(x), 80)]
    return [(d.doc_id, d.lang, i, t) for d in docs for i, t in enumerate(cut(d.text or "")) if t.strip()]


def _documents(spark, tmp_path, *texts):
    rows = [(i, t, "fr", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lines_are_whole(spark):
    got = derived.lines(spark, SF).select("doc_id", "pos", "text").collect()
    assert sorted(map(tuple, got)) == sorted((d, i, t) for d, _, i, t in _lines(spark))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for d, t in texts.items():
        assert "".join("".join(r.text for r in sorted(got, key=lambda r: r.pos) if r.doc_id == d).split()) == "".join(t.split())


def test_quality_counts_all_lines_and_characters(spark):
    want = defaultdict(Counter)
    for _, lang, _, t in _lines(spark):
        want[lang] += Counter(lines=1, chars=len(" ".join(t.lower().split())), words=len(t.split()))
    for r in __spark_entry__.entry(spark).collect():
        w = want[r.language]
        assert (r.num_gt_lines, r.gt_char_count, r.gt_word_count) == (w["lines"], w["chars"], w["words"])


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_long_and_accented_lines_are_scored(spark, tmp_path):
    sf = _documents(spark, tmp_path, "été à la fenêtre\n" + "le thé vert était prêt " * 300, "日本 e\n\n  \nplain e")
    got = registry.QUERIES["text_distance"](spark, sf).collect()
    texts = {(d, i): t for d, _, i, t in _lines(spark, sf)}
    seen = {tuple(map(int, r.artifact_id.split("_")[:2])) + (r.pred_index // 2,) for r in got}
    assert {(d, 40 * page + i) for d, page, i in seen} == set(texts)
    for r in got:
        d, page, profile = r.artifact_id.split("_", 2)
        i, k = r.pred_index // 2, derived.PROFILES.index(profile)
        t = texts[int(d), 40 * int(page) + i]
        changed = t.replace("e", "c") if k and (int(d) * 31 + i + 7 * k) % 3 == 0 else t
        assert r.char_errors == _distance(*(" ".join(x.lower().split()) for x in (t, changed)))


def test_word_distance_of_many_words(spark):
    from pyspark.sql import functions as F

    from lectern.functions import text as T

    words = lambda n, skip=1: F.transform(F.sequence(F.lit(1), F.lit(n), F.lit(skip)), lambda i: i.cast("string"))
    one = spark.range(1)
    got = one.select(T.word_distance(words(40_000), F.concat(F.array(F.lit("x")), words(40_000))).alias("a"), T.word_distance(words(300), words(300, 3)).alias("b"), T.word_distance(words(1), F.array().cast("array<string>")).alias("c")).first()
    assert tuple(got) == (1, 200, 1)


def _elements(spark):
    """(document, pos, id, page, line_index, text) of all lines, as _line_elements has them."""
    return [(d, p, "l1" if d % 7 == 0 and p == 2 else f"l{p}", 1 + p // 40 + (d % 4 == 0 and p == 3), 2 - p % 3, t) for d, _, p, t in _lines(spark)]


def test_texts_are_joined_whole(spark):
    want = defaultdict(list)
    for d, _, _, t in sorted(_lines(spark)):
        want[d].append(t.strip())
    assert {r.doc_id: r.joined for r in registry.QUERIES["ordered_text"](spark, SF).collect()} == {d: "\n".join(ts) for d, ts in want.items()}


def test_reading_order_of_all_documents(spark):
    groups, want = defaultdict(list), []
    for d, p, i, page, line, _ in _elements(spark):
        place = (page, float(p // 3), float(line), i) if p % 5 != 4 else (page, 50.0, -5.0 * (p % 40), i)
        groups[str(d), "cell" if p % 2 else "line"].append((place, i, p))
    for (d, role), rows in groups.items():
        want += [(d, i, role, p, n) for n, (_, i, p) in enumerate(sorted(rows), 1)]
    got = registry.QUERIES["reading_order"](spark, SF).select("artifact_id", "id", "role", "ord", "reading_order").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(d % 7 == 0 for d, *_ in _elements(spark))


def test_containers_of_all_documents(spark):
    elements, want = _elements(spark), Counter()
    last = {(d, i): (t, p) for d, p, i, _, _, t in sorted(elements)}
    held, on_second = Counter(), set()
    for d, p, i, page, _, t in elements:
        if p % 19 == 7:
            continue
        own = f"x{p}" if p % 31 == 4 else i
        for c in ("c1", "c2")[: 2 if p % 23 == 5 else 1]:
            held[d, own] += 1
            if page == 2:
                on_second.add((d, c))
            if (d, own) not in last:
                want[str(d), own, "container_orphan"] += 1
            elif p % 29 == 3 or last[d, own] != (t, p):
                want[str(d), own, "container_copy"] += 1
    for d, _, i, *_ in elements:
        want[str(d), i, "multiple_containers"] += held[d, i] > 1
        want[str(d), i, "container_missing"] += held[d, i] != 1
    want += Counter((str(d), c, "container_count") for d, c in on_second)
    got = registry.QUERIES["audit_containers"](spark, SF).select("artifact_id", "element_id", "code").collect()
    assert Counter(map(tuple, got)) == want


def test_deep_chains_of_parents_are_no_cycles(spark, tmp_path):
    sf = _documents(spark, tmp_path, *["\n".join("x" * 300)] * 10)
    got = registry.QUERIES["audit_parent_cycle"](spark, sf).collect()
    assert sorted((r.artifact_id, r.element_id) for r in got) == sorted((str(d), f"n{i}") for d in (0, 8) for i in range(300))
