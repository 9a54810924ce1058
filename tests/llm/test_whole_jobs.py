"""Small tests of what the corpus operators once left out."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import common, licences, mixing, queries, simhash, url_graph, warc, wordpiece

from . import brute

SF = "/root/testdata/sf0.001"


# token counts


def longest(text, pieces):
    at, n = 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@pytest.fixture(scope="module")
def vocabulary():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=wordpiece.default_vocabulary())
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}


def test_the_bare_mark_starts_words():
    rng = random.Random(3)
    for _ in range(300):
        pieces = lambda k: ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(k)]
        starts, rests = ["", *pieces(5)], pieces(5)
        automaton, every = wordpiece.Automaton(starts, rests), {wordpiece.MARK + s for s in starts} | set(rests)
        for _ in range(30):
            word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            assert automaton.length(word) == longest(wordpiece.MARK + word, every), (word, starts, rests)


def test_token_counts_with_the_whole_vocabulary(spark, vocabulary):
    assert wordpiece.MARK in vocabulary
    odd = [(-1, "3.5 2024 ñandú ça 中文文本没有空格 plain"), (-2, None), (-3, " ")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = []
    for d, t in odd + [tuple(r) for r in docs.collect()]:
        lengths = [longest(wordpiece.MARK + w, vocabulary) for w in brute.words(t)]
        want.append((d, len(lengths), sum(lengths) + lengths.count(0), lengths.count(0)))
    got = [*wordpiece.token_counts(spark.createDataFrame(odd, "doc_id long, text string")).collect(), *queries.op9_token_counts(spark, SF).collect()]
    assert sorted(map(tuple, got)) == sorted(want)


# URL graph


def _page(*to):
    return "".join(f"<a href='https://{h}/p'>.</a>" for h in to)


def test_hosts_that_are_only_linked_to_seed_distrust(spark):
    rows = [(1, "http://lure.org/", _page("spam-farm.net", "fine.org")), (2, "http://fine.org/", _page("good.org")), (3, "http://before.org/", _page("lure.org"))]
    got = url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [], F.lit(False), F.col("host") == "spam-farm.net", min_labels=2).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow", 3: "block"}


def test_spam_hosts_and_their_subdomains_are_blocked(spark, tmp_path):
    rows = [(i, f"http://{h}/", None) for i, h in enumerate(["cheap-pills.org", "m.adult-x.net", "pills.org"])] + [(3, "http://lure.org/", _page("www.adult-x.com"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.verdict for r in queries.op1_url_filters(spark, str(tmp_path)).collect()} == {0: "block", 1: "block", 2: "allow", 3: "block"}


def test_distrust_goes_back_more_than_twenty_links(spark):
    links = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)]
    got = url_graph.propagate(spark.createDataFrame(links, "src string, dst string, w double"), spark.createDataFrame([("h30", 0.0, 1.0)], "host string, trusted double, blocked double")).collect()
    assert {r.host for r in got if r.distrust > 0} == {f"h{i}" for i in range(31)}
    assert abs(sum(r.distrust for r in got) - (1 - 0.85**31)) < 1e-3


def test_rounds_over_hubs_take_few_jobs_of_the_driver(spark):
    links = spark.createDataFrame([("hub", f"s{i}", 1.0) for i in range(2500)] + [(f"s{i}", "hub", 1.0) for i in range(5)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("s1", 1.0, 0.0)], "host string, trusted double, blocked double")
    jobs = []
    for rounds in (2, 10):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        url_graph.propagate(links, seeds, tolerance=0, most_rounds=rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 8 * 4


def test_no_part_of_a_hub_is_hot(spark):
    rows = spark.range(40_000).selectExpr("if(id < 30000, 'hub', concat('h', id)) AS a", "id AS b")
    dealt = common.shares(rows, "a")
    parts = rows.withColumn("part", F.pmod(F.hash("b"), dealt(F.col("a")))).groupBy("a", "part").count().collect()
    assert len({r.part for r in parts if r.a == "hub"}) == 30 and max(r["count"] for r in parts) < 1250
    assert sum(r["count"] for r in parts) == 40_000 and common.shares(rows.where("id >= 30000"), "a") is None


# licences


@pytest.mark.parametrize(
    ("text", "licence", "first", "lines"),
    [
        ("x\nCopyright 2020 Foo. Licensed under the MIT License", "MIT", 1, 1),
        ("Some words before it all stand here and more\nin this text. This work is licensed under the GNU General\nPublic License, version 3, as are all the other works of the\nauthor and of friends.", "GPL-3.0", 1, 2),
        ("We ship it and it is, as you know, released under\nthe MIT License and nothing else at all will do here.", "MIT", 0, 2),
    ],
)
def test_notices_within_lines_and_paragraphs(text, licence, first, lines):
    assert [x[1:] for x in licences.Templates(licences.TEMPLATES).scan(text)] == [(licence, first, lines)]


@pytest.mark.parametrize("name", ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"])
def test_whole_bodies(name):
    known, body = licences.Templates(licences.TEMPLATES), licences.TEMPLATES[name][-1]
    for text in (body, "word " * 900 + "\n\n" + body.replace(". ", ".\n\n") + "\n\n" + "other " * 900):
        assert max(known.scan(text))[:2] == (1.0, name)


def test_windows_lose_none():
    rng = random.Random(4)
    for _ in range(300):
        known = licences.Templates({str(i): [" ".join(rng.choices("abcd", k=rng.randint(2, 9)))] for i in range(3)})
        words = rng.choices("abcde", k=rng.randint(1, 25))
        got = {}
        for d, k, _ in known.windows(words):
            got[k] = max(got.get(k, 0), d)
        want = {k: max((licences.dice(licences.bigrams(words[i : i + n + 1]), known.grams[k]) for i in range(len(words) - n)), default=0) for k, n in enumerate(known.sizes)}
        assert got == {k: d for k, d in want.items() if d >= known.threshold}


# WARC derivatives


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>whole article", "whole article"),
        ("<head><meta a=b><LINK x>\n<style>s</style><script>if (a<b) {}</script><!-- c --><div>one</div>two", "one\ntwo"),
        ("<head><title>T</title>bare text", "bare text"),
        ("<head profile=x><title>T</title></head><body>b</body>", "b"),
        ("<head><title>T</title><body>b", "b"),
        ("<head><title>T", ""),
        ("<header>h</header>", "h"),
        ("a<svg width='1>2' />b<p>c</p>", "a b\nc"),
        ("a<svg/>b<svg><path d='x'/>t</svg>c", "a b c"),
        ("a<svg>open", "a"),
    ],
)
def test_optional_and_self_closed_tags(page, text):
    assert warc.plain_text(page) == text


def test_star_rounds_write_few_files(spark, monkeypatch):
    """A table of few rows is a file, not one for each shuffle partition: executors start processes for each file."""
    files_of = {}

    def write(df, name, of=common.materialise):
        out = of(df, name)
        files_of.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "materialise", write)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = simhash.components(spark.range(300).selectExpr("id AS a", "id + 1 AS b")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(1, 301)]
    assert set(files_of) == {"star", "star-keys"} and max(map(max, files_of.values())) == 1


def test_a_partition_for_each_so_many_rows(spark):
    rows = spark.range(50_000).repartition(20)
    assert [common.in_few(rows, n).rdd.getNumPartitions() for n in (0, 1, 10_000, 10_001, 50_000, 10**9)] == [1, 1, 1, 2, 5, 20]
    assert common.in_few(rows, 50_000).count() == 50_000


def test_the_mix_starts_no_python_workers(spark, monkeypatch):
    """Its plan is built from a list on the driver, which as rows would go through Python workers on the executors."""
    docs = spark.sql("SELECT id AS doc_id, repeat('a ', 9) AS text, IF(id % 3 = 0, NULL, string(id % 3)) AS source FROM range(90)").localCheckpoint()

    def refuse(*_, **__):
        raise AssertionError("rows go through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    got = mixing.mix(docs).collect()
    assert len(got) == 90 and sum(r.taken for r in got) == 90 * 9 * 3 // 2
    assert not mixing.mix(docs.limit(0)).collect()


def test_freed_memory_goes_back():
    """160 MB that Python has freed, but the C library keeps as what lies above is in use, go back to the system."""
    import subprocess
    import sys

    code = """
import re
from lectern.llm import common
held = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
texts = [bytes(800) for _ in range(200_000)]
top = held()
last = texts[-1]
del texts
kept = held()
common.give_back()
print(top, kept, held())
"""
    top, kept, after = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert kept > top - 50 and after < top - 120


def test_near_dedup_leaves_all_its_tables_to_python_workers(spark):
    """What a JVM writes has checksums beside it, and takes processes for the files' modes."""
    import glob

    folder = f"{common.shared_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}".replace("//", "/")
    before = set(glob.glob(f"{folder}/*"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 3).otherwise(F.col("doc_id")))  # an id of many texts
    rows = more.collect()
    want = brute.components([brute.simhash(r.text) for r in rows], [r.doc_id for r in rows])
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert {r.doc_id for r in simhash.keep_first(more, tile=20).collect()} == set(want)
    made = set(glob.glob(f"{folder}/*")) - before
    assert len(made) > 10 and not [f for d in made for f in glob.glob(f"{d}/.*.crc")]


def test_tables_by_workers(spark):
    rows = spark.range(25_000).selectExpr("id", "IF(id % 3 = 0, NULL, named_struct('no_id', id % 2 = 0, 'id', cast(id AS decimal(20, 2)), 't', timestamp_millis(id))) AS s", "IF(id % 5 = 0, NULL, 'ñ' || id) AS t")
    ids = lambda batches: (b.select([0]) for b in batches)
    made = [common.by_workers(rows.repartition(3), "test"), common.materialise(common.in_few(rows, 25_000), "test"), common.by_workers(rows, "test", ids, "id long")]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(made[0]) == key(made[1]) == key(rows) and key(made[2]) == key(rows.select("id"))
    assert [len(m.inputFiles()) for m in made[:2]] == [3, min(3, rows.rdd.getNumPartitions())]
    empty = common.by_workers(rows.where("id < 0"), "test")
    assert empty.dtypes == rows.dtypes and empty.count() == 0


def test_files_of_other_attempts_are_not_read(spark):
    import os
    import shutil

    made = common.by_workers(spark.range(10), "test")
    file = made.inputFiles()[0].removeprefix("file://")
    shutil.copy(file, f"{os.path.dirname(file)}/.attempt-of-another")
    assert spark.read.parquet(os.path.dirname(file)).count() == made.count() == 10
