import random

import duckdb
import pytest

from lectern.llm import mixing, packing, queries, quality, simhash

from . import brute

SF = "/root/testdata/sf0.001"
CASES = [
    (1, "", "a"), (2, None, "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one two three", "b"), (6, "a b c a b c a", "b"), (7, "x\nx\n\nx \ny", None),
    (8, "Ünï ¢ode word " * 30, "ä"), (9, "the cat sat " * 4000, "b"), (10, "the cat sat " * 4000, "b"), (11, "# * $ % & | < >", "z"), (12, "A b C d", "z"), (12, "A b C d", "z"),
    (13, "a\x0bb\x0cc\rd", "z"), (14, "é ́x İ ΑΣ ſ <|endoftext|> <|ENDOFTEXT|>", "z"), (15, "a b a b a b a", "z"),
]
DDL = "doc_id long, text string, source string, c0 int, pattern int, size int, fp int, n_words string, kept string, p int, taken string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*x, 7, 7, 7, 7, "n", "k", 1, "t") for x in CASES], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None,) * 11, (None,) * 11, (None, "one two", None, *(None,) * 8), (1, "one two", "s", *(None,) * 8)], DDL)


def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


def test_quality_counts(spark, odd, empty, nulls):
    for rows, given in ((quality.quality(odd).collect(), [(x[0], x[1]) for x in CASES]), (queries.op7_quality_rules(spark, SF).collect(), [x[:2] for x in documents()])):
        got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == sorted((d, *(q := brute.quality(t)), q[0] < 50 or 100 * q[4] > 50 * q[0]) for d, t in given)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns
    assert quality.quality(nulls).count() == 4 and quality.keep_good(nulls).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, sf).where("NOT base_failed").collect()}
    labels = [(d, q) for d, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if d in kept]
    assert sum(kept[d] for d, q in labels if q) >= 0.99 * sum(q for _, q in labels)
    assert sum(kept[d] for d, q in labels if not q) <= 0.05 * sum(not q for _, q in labels)


def test_simhash(spark, odd, empty, nulls):
    for rows, given in ((simhash.near_duplicates(odd).collect(), [x[:2] for x in CASES]), (simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), tile=20).collect(), [x[:2] for x in documents()])):
        fps = [brute.simhash(t) for _, t in given]
        want = sorted(zip([d for d, _ in given], fps, brute.components(fps, [d for d, _ in given]), strict=True))
        assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert simhash.near_duplicates(nulls).count() == 4
    kept = simhash.keep_first(odd)
    groups = brute.components([brute.simhash(x[1]) for x in CASES], [x[0] for x in CASES])
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))
    assert sorted(r.text or "" for r in simhash.keep_first(nulls).collect()) == ["", "one two"]


def test_same_id_in_two_components(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z"), (2, "v w x y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in simhash.keep_first(docs).collect()) == [(1, "a"), (2, "v")]


def test_forest_keeps_components():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for b in base] + [base]))
    for step in (1, 7, 10**6):
        half = len(x) // 2
        edges = [simhash.forest(x[:half], None, step=step), simhash.forest(x[half:], None, step=step), simhash.forest(x[:half], x[half:], step=step)]
        root = {int(v): int(v) for v in x}

        def find(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                root[find(u)] = find(v)
        want = brute.components([int(v) for v in x], list(range(len(x))))
        got = [find(int(v)) for v in x]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (500, 100)]
    random.Random(5).shuffle(chain)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 200: 100, 300: 100, 500: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd, empty, nulls):
    for rows, given in ((mixing.mix(odd).collect(), CASES), (queries.op6_source_mixing(spark, SF).collect(), documents())):
        sizes, want = {}, {}
        for _, t, s in given:
            sizes[s] = sizes.get(s, 0) + len(brute.words(t))
        want, got, took = brute.targets(sizes), {}, {}
        for d, t, s in given:
            got.setdefault(d, []).append((len(brute.words(t)), sizes[s]))
        assert sorted((r.doc_id, r.size, r.source_size) for r in rows) == sorted((d, *x) for d, xs in got.items() for x in xs)
        of = {d: s for d, _, s in given}
        for r in rows:
            s = of[r.doc_id]
            assert abs(r.target - want[s]) <= 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
            took[s] = took.get(s, 0) + r.taken
        assert all(want[s] - 3 <= took[s] <= want[s] + 1e-6 for s in took)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mix(nulls).count() == 4
    assert mixing.mixed(odd).columns == odd.columns


def test_mixed_takes_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    took = {}
    for r in mixing.mixed(docs).collect():
        took.setdefault(r.source, []).append(len(brute.words(r.text)))
    sizes, longest = {}, {}
    for _, t, s in documents():
        n = len(brute.words(t))
        sizes[s], longest[s] = sizes.get(s, 0) + n, max(n, longest.get(s, 0))
    assert all(abs(sum(took.get(s, [])) - x) <= longest[s] for s, x in brute.targets(sizes).items())


def test_flow_of_overlapping_sources():
    got = mixing.flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 100, "b": 110})
    assert sum(got[("a",)].values()) == 100 and got[("b",)] == {"b": 10} and got[("a", "b")] == {"b": 100}  # no word is repeated
    got = mixing.flow({("a", "b"): 50, ("b",): 10}, {"a": 60, "b": 40})
    assert got[("a", "b")]["a"] == 60 and sum(x.get("b", 0) for x in got.values()) == 40
    assert mixing.flow({("a",): 5}, {"a": 100}) == {("a",): {"a": 10}}


def test_packing(spark, odd, empty, nulls):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    plain = odd.dropDuplicates(["doc_id"])
    from pyspark.sql import functions as F

    pieces = packing.pack(plain.repartition(2), chunk=9000).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset")
    assert brute.check_pieces(pieces.collect(), {x[0]: x[1] for x in CASES}, encode) == 0
    assert brute.check_pieces(queries.op8_packing(spark, SF).collect(), {d: t for d, t, _ in documents()}, encode) == 0
    assert packing.pack(empty).count() == 0
    assert sorted(r.doc_tokens for r in packing.pack(nulls).where("start = 0").collect()) == [1, 1, 3, 3]
    assert sum(r.length for r in packing.pack(odd).where("doc_id = 12").collect()) == 2 * 5


def test_word_ids_are_the_tokenizers():
    rng = random.Random(11)
    ids = packing.WordIds(packing.default_vocabulary(), kept=50)
    pool = [*"aAbB'sS.,!1²ßÄẞΣσς İıé́̀​‍ 　\u0085 \t\n\r\x0b\x0c\x1c\x1f🙂👍🏽中文 ", "'ll", "<|endoftext|>", "<|EndOfText|>", "<|", "</w>"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        want = ids.of.encode(text, add_special_tokens=False).ids
        import numpy as np

        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want, repr(text)


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randint(1, 3000) for _ in range(800)]
    spent, room = {}, {}
    for _, _, n, seq, _ in packing.assign(lengths):
        spent[seq] = spent.get(seq, 0) + packing.cost(n)
        room[seq] = room.get(seq, 0) + n
    full = [spent[s] for s, n in room.items() if n == 4096]
    assert len(full) == sum(lengths) // 4096
    mean = sum(full) / len(full)
    assert sum(abs(x - mean) for x in full) / len(full) < 0.25 * mean


def test_forest_of_a_dense_tile_in_little_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(9)
    flips = np.uint64(1) << rng.integers(0, 64, (24_000, 2), dtype=np.uint64)
    x = np.unique(np.uint64(0x0F0F33335555AAAA) ^ flips[:, 0] ^ flips[:, 1])  # at most 2,017 distinct, all within 4 bits
    wide = np.unique(np.concatenate([x ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 64, 5)]))
    tracemalloc.start()
    a, _ = simhash.forest(wide, None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(wide) > 15_000 and len(a) == len(wide) - 1 and most < 24_000_000
