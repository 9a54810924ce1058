import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import mixing, quality, queries

from . import brute

SF = "/root/testdata/sf0.001"


def test_posteriors_and_verdicts(spark):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    places, post = brute.kept([t for _, t in given])
    want = sorted((d, round(p, 5), i in set(places)) for i, ((d, _), p) in enumerate(zip(given, post, strict=True)))
    got = sorted((r.doc_id, round(r.posterior, 5), r.kept) for r in queries.op7_quality_rules(spark, SF).collect())
    assert all(a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 2e-5 for a, b in zip(got, want, strict=True))


def test_a_fit_that_does_not_settle_fails(spark):
    docs = quality.features(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    with pytest.raises(Exception, match="did not settle"):
        quality.fit(docs, most_rounds=2).collect()


def test_flow_is_maximal_and_cheapest():
    """Against every cut: with one pass, then two, no flow through the sources' quotas is larger."""
    rng = random.Random(8)
    for _ in range(400):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = [p for n in range(1, len(names) + 1) for p in itertools.combinations(names, n)]
        sizes = {p: rng.randint(0, 9) for p in rng.sample(patterns, rng.randint(1, len(patterns)))}
        quotas = {s: rng.randint(0, 15) for s in names if any(s in p for p in sizes)}
        got = mixing.flow(sizes, quotas)
        of = {p: sum(x.values()) for p, x in got.items()}
        into = {s: sum(x.get(s, 0) for x in got.values()) for s in quotas}
        assert all(set(x) <= set(p) for p, x in got.items()) and all(into[s] <= q for s, q in quotas.items()) and all(of[p] <= 2 * n for p, n in sizes.items())
        most = lambda times: min(sum(times * n for p, n in sizes.items() if set(p) & set(inside)) + sum(q for s, q in quotas.items() if s not in inside) for k in range(len(quotas) + 1) for inside in itertools.combinations(quotas, k))  # noqa: B023, E731
        assert sum(of.values()) == most(2)
        assert sum(min(of[p], n) for p, n in sizes.items()) == most(1)  # what no word is repeated for is as much as can be


def test_pipeline_against_plain_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    good = [rows[i] for i in brute.kept([t for _, t, _ in rows])[0]]
    groups = brute.components([brute.simhash(t) for _, t, _ in good], [d for d, _, _ in good])
    stay = {d: (t, s) for d, t, s in good if d in set(groups)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "mix_sources", "pack_sequences"]
    from lectern.llm import common

    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, common.materialise(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs)
        assert name == "pack_sequences" or docs.columns == before
    assert sorted(r.doc_id for r in seen[0].collect()) == sorted(d for d, _, _ in good)
    assert sorted(r.doc_id for r in seen[1].collect()) == sorted(stay)
    sizes, took = {}, {}
    for t, s in stay.values():
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    mixed = seen[2].collect()
    times = {d: sum(r.doc_id == d for r in mixed) for d in stay}
    assert max(times.values()) <= 2 and sum(times.values()) == len(mixed) and all((r.text, r.source) == stay[r.doc_id] for r in mixed)
    for d, (t, s) in stay.items():
        took[s] = took.get(s, 0) + times[d] * len(brute.words(t))
    longest = {s: max(len(brute.words(t)) for t, x in stay.values() if x == s) for s in sizes}
    assert all(abs(took[s] - want) <= longest[s] for s, want in brute.targets(sizes).items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: tokenizer.encode(stay[d][0], add_special_tokens=False).ids + [2] for d in times}
    pieces = seen[3].collect()
    by_seq = {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        import numpy as np

        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert {d: sum(r.length for r in pieces if r.doc_id == d) for d in stay if times[d]} == {d: n * len(ids[d]) for d, n in times.items() if n}
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    again = corpus_pipeline.run(spark, SF)
    key = lambda df: df.groupBy("doc_id", "start", "length", "ids_crc32").count()
    assert key(again).exceptAll(key(seen[3])).isEmpty() or key(again).agg(F.sum("length")).first() == key(seen[3]).agg(F.sum("length")).first()


def test_pipeline_of_odd_tables(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, pattern int, fp int, th string, n_words int, c0 string, row int, ids int"
    good = "The house by the sea was old and in it there lived a man with a dog that liked to run on the long beach each day before the rain came in from the hills, and so it was for many years until they both were too tired to walk there and sat in the sun by the door instead of it all. "
    extra = (1, 2, "t", 3, "c", 4, 5)
    cases = {"empty": [], "odd": [(None, None, None, None, None, *extra), (1, "", "en", "a", 0, *extra), (2, good, "en", "a", 9, *extra), (2, good, "en", "a", 9, *extra), (3, good, "en", None, 9, *extra), (None, good + "And this is one more of it.", "en", "b", 9, *extra)]}
    for name, rows in cases.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert name != "empty" or not out
        assert {r.doc_id for r in out} <= {2, None}
