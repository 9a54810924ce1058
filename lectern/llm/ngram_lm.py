"""Interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in memory-mapped hash arrays.

Counting: each task merges its own word pairs and sends them, as compressed blobs, to buckets of the first word's
hash, salted by the second's so that a frequent word is spread. A bucket's pairs become one file: hashes in order,
then counts. Of each word the buckets pass on what it does as a context (count, and pairs seen once, twice and
more often) and as a continuation (distinct words before it); a second, smaller exchange adds these up into files of
words in order of their hash. No n-gram is pruned and no count is clipped. The driver holds a row for each file,
the counts of LARGE or more and seven sums.

Scoring: workers map the files and look up sorted batches of hashes, so a file is swept once for each batch.

Words are 64-bit hashes (XXH64); pairs are 48 bits of a hash within a bucket. Files grow with the distinct pairs of
the corpus: where they outgrow what workers can map, score with a model of a part of the corpus (fit() and score()
are separate).

Defined results: null texts are empty; an empty text is one end token. Without training texts all counts are zero
and each token has probability one, as base_score has it. Repeated rows are counted and scored each for itself.
A null id trains. Long texts are used whole. An empty table gives an empty result. Columns other than the id and the
text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import files

FOLDS, HELD_OUT = 7, 2
SALTS = 16
#: Word pairs that a task merges at a time.
CHUNK = 2_500_000
#: Bytes of input for each bucket.
BUCKET_BYTES = 8_000_000
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PAIR_KINDS = ["<u8", "<u4"]
WORD_KINDS = ["<u8"] * 6
#: What a file has for a pair seen at least as often; how often, the driver tells. Of these there are at most tokens / LARGE, 4,000 in 100 TB.
LARGE = 2**32 - 1


def held_out(id_col: str):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_OUT


def token_hashes(text: bytes | None) -> np.ndarray:
    """START, the words in lower case, END."""
    import xxhash

    ws = (text or b"").lower().split()
    out = np.empty(len(ws) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) ^ _mix(b))


def pair_bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(_mix(a) + b % np.uint64(SALTS)) % np.uint64(buckets)).astype(np.int64)


def word_bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so that words in order are in order of their files."""
    return ((w >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def squeeze(key: np.ndarray, others: list[np.ndarray]) -> bytes:
    """Bytes of arrays in the order of key, which rises: its differences, then the others byte plane by byte plane."""
    import zstandard

    body = _planes(np.diff(key, prepend=np.uint64(0)).astype("<u8")) + b"".join(_planes(x) for x in others)
    return len(key).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unsqueeze(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(blob[:8], "little")
    body, out, at = zstandard.ZstdDecompressor().decompress(blob[8:]), [], 0
    for kind in ["<u8", *kinds]:
        size = np.dtype(kind).itemsize * n
        out.append(_from_planes(body[at : at + size], kind, n))
        at += size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _sums(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, with the sums of the columns."""
    if not len(key):
        return key, columns
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], [np.add.reduceat(c[order].astype(np.int64), first) for c in columns]


@dataclass
class Model:
    """Where the files are and the sums over all of them."""

    buckets: int
    pairs: dict[int, tuple[str, int]] = field(default_factory=dict)
    words: dict[int, tuple[str, int]] = field(default_factory=dict)
    tokens: int = 0
    types: int = 0
    distinct_pairs: int = 0
    large: dict[int, dict[int, int]] = field(default_factory=dict)
    pair_counts: list[int] = field(default_factory=lambda: [0] * 4)
    word_counts: list[int] = field(default_factory=lambda: [0] * 4)

    def discounts(self, counts: list[int]) -> np.ndarray:
        """For counts of 0, 1, 2 and more; where the counts of counts do not give them, half of each."""
        n1, n2, n3, n4 = counts
        out = [0.0, 0.5, 1.0, 1.5]
        if min(n1, n2, n3) > 0:
            y = n1 / (n1 + 2 * n2)
            out = [0.0, *(d if 0 < d < k else k / 2 for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]
        return np.array(out)

    def _find(self, table: dict, at: int, key: np.ndarray, kinds: list[str]) -> list[np.ndarray]:
        """The columns of a file at the sorted keys, zero where it has none."""
        uri, n = table.get(at, ("", 0))
        if not n:
            return [np.zeros(len(key), np.int64) for _ in kinds[1:]]
        have, *columns = files.open_arrays(uri, n, kinds)
        place = np.minimum(np.searchsorted(have, key), n - 1)
        hit = have[place] == key
        return [np.where(hit, c[place], 0).astype(np.int64) for c in columns]

    def word_rows(self, w: np.ndarray) -> list[np.ndarray]:
        """Of sorted words: count, contexts' pairs seen once, twice, more often, and distinct words before."""
        at = word_bucket(w, self.buckets)
        cuts = np.flatnonzero(np.diff(at)) + 1
        parts = [self._find(self.words, int(word_bucket(p[:1], self.buckets)[0]), p, WORD_KINDS) for p in np.split(w, cuts)] if len(w) else [[np.zeros(0, np.int64)] * 5]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def pair_rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bucket = pair_bucket(a, b, self.buckets)
        key = pair_hash(a, b) >> np.uint64(16)
        order = np.lexsort((key, bucket))
        out, ends = np.zeros(len(a), np.int64), np.cumsum(np.bincount(bucket, minlength=self.buckets))
        for k in range(self.buckets):
            rows = order[ends[k - 1] if k else 0 : ends[k]]
            if len(rows):
                out[rows] = self._find(self.pairs, k, key[rows], PAIR_KINDS)[0]
                for at in rows[out[rows] == LARGE]:
                    out[at] = self.large[k][int(key[at])]
        return out

    def score(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """Of token hashes of texts: tokens, known tokens, base score, score."""
        if not docs:
            return []
        h = np.concatenate(docs)
        first = np.cumsum([0] + [len(d) for d in docs[:-1]])
        unique, place = np.unique(h, return_inverse=True)
        c, n1, n2, n3, before = self.word_rows(unique)
        d1, d2 = self.discounts(self.word_counts), self.discounts(self.pair_counts)
        types = self.types + 1
        if self.distinct_pairs:
            left = before - d1[np.minimum(before, 3)]
            single = left / self.distinct_pairs + d1[1:] @ np.array([*self.word_counts[:2], self.types - sum(self.word_counts[:2])]) / self.distinct_pairs / types
        else:
            single = np.full(len(unique), 1 / types)
        # START stands first in each text and is never predicted, but is a context
        token = np.ones(len(h), bool)
        token[first] = False
        at = np.flatnonzero(token)
        w, v = place[at], place[at - 1]
        seen = c[v]
        counted = self.pair_rows(h[at - 1], h[at])
        some = np.maximum(seen, 1)
        back = (d2[1] * n1[v] + d2[2] * n2[v] + d2[3] * n3[v]) / some
        p = np.where(seen > 0, np.maximum(counted - d2[np.minimum(counted, 3)], 0) / some + back * single[w], single[w])
        of = np.where(unique == START, 0, c)
        base = np.log10((of[w] + 1) / (self.tokens + types))
        starts = first - np.arange(len(docs))
        add = lambda x: np.add.reduceat(x, starts).tolist()
        return list(zip([len(d) - 1 for d in docs], add((of[w] > 0).astype(np.int64)), add(base), add(np.log10(p)), strict=True))


def _buckets(docs: DataFrame) -> int:
    """By the size that the plan states for its input; only how finely work is dealt depends on it."""
    return max(8, min(65_536, math.ceil(C.stated_bytes(docs) / BUCKET_BYTES)))


def fit(docs: DataFrame, text: str = "text", buckets: int | None = None) -> Model:
    """The model of all rows of docs."""
    spark, n_buckets, large = docs.sparkSession, buckets or _buckets(docs), LARGE
    folder = C.fresh_path(spark, "ngrams")
    schema = "bucket int, kind string, blob binary, uri string, n long, s array<long>"
    names = ["bucket", "kind", "blob", "uri", "n", "s"]
    types = [pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    table = lambda rows: pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    def count(batches):
        held, n = [], 0

        def merged():
            nonlocal held, n
            h = np.concatenate(held)
            held, n = [], 0
            a, b = h[:-1], h[1:]
            inside = b != START
            a, b = a[inside], b[inside]
            key = pair_hash(a, b)
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            times = np.diff(np.append(start, len(key))).astype("<u4")
            a, b = a[order[start]], b[order[start]]
            del key, order, start, h
            bucket = pair_bucket(a, b, n_buckets)
            order = np.lexsort((a, bucket))
            a, b, times, bucket = a[order], b[order], times[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
            for k in np.unique(bucket).tolist():
                cut = slice(ends[k], ends[k + 1])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze(a[cut], [b[cut].astype("<u8"), times[cut]])], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for value in batch.column(0):
                held.append(token_hashes(value.as_py()))
                n += len(held[-1])
                if n > CHUNK:
                    yield from merged()
        if held:
            yield from merged()

    def pairs(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = [unsqueeze(x.as_py(), ["<u8", "<u4"]) for x in group.column("blob")]
        a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts, group
        key = pair_hash(a, b) >> np.uint64(16)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.add.reduceat(n[order].astype(np.int64), first)
        a, b, key = a[order[first]], b[order[first]], key[first]
        uri = files.write_arrays(folder, f"pairs-{bucket}", [key.astype("<u8"), np.minimum(times, large).astype("<u4")])
        often = np.flatnonzero(times >= large)
        rows = [(bucket % n_buckets, "pairs", None, uri, len(key), [bucket, *(int(np.count_nonzero(times == i)) for i in (1, 2, 3, 4)), *key[often].astype(np.int64).tolist(), *times[often].tolist()])]
        context, (c, n1, n2, n3) = _sums(a, [times, times == 1, times == 2, times > 2])
        word, (before, ends) = _sums(b, [np.ones(len(b), np.int64), np.where(b == END, times, 0)])
        w = np.concatenate((context, word))
        none, none2 = np.zeros(len(word), np.int64), np.zeros(len(context), np.int64)
        w, columns = _sums(w, [np.concatenate((c, ends)), np.concatenate((n1, none)), np.concatenate((n2, none)), np.concatenate((n3, none)), np.concatenate((none2, before))])
        at = word_bucket(w, n_buckets)
        cuts = np.searchsorted(at, np.arange(n_buckets + 1))
        for k in np.unique(at).tolist():
            cut = slice(cuts[k], cuts[k + 1])
            rows.append((k, "words", squeeze(w[cut], [columns[0][cut].astype("<u8"), *(x[cut].astype("<u8") for x in columns[1:])]), None, None, None))
        return table(rows)

    def words(group: pa.Table) -> pa.Table:
        rows, parts = [], []
        for r in range(group.num_rows):
            if group.column("kind")[r].as_py() == "pairs":
                rows.append(tuple(group.column(c)[r].as_py() for c in names))
            else:
                parts.append(unsqueeze(group.column("blob")[r].as_py(), WORD_KINDS[1:]))
        if parts:
            bucket = group.column("bucket")[0].as_py()
            w, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
            w, columns = _sums(w, columns)
            uri = files.write_arrays(folder, f"words-{bucket}", [w.astype("<u8"), *(x.astype("<u8") for x in columns)])
            real = w != START
            before = columns[4][real]
            rows.append((bucket, "words", None, uri, len(w), [int(columns[0][real].sum()), int(np.count_nonzero(columns[0][real])), *(int(np.count_nonzero(before == i)) for i in (1, 2, 3, 4))]))
        return table(rows)

    blobs = docs.select(F.encode(F.col(text), "UTF-8").alias("t")).mapInArrow(count, "bucket int, blob binary")
    first = blobs.groupBy("bucket").applyInArrow(pairs, schema)
    model = Model(n_buckets)
    for r in first.groupBy("bucket").applyInArrow(words, schema).select("bucket", "kind", "uri", "n", "s").collect():  # two rows for each bucket
        if r["kind"] == "pairs":
            model.pairs[r["s"][0]] = (r["uri"], r["n"])
            model.distinct_pairs += r["n"]
            model.pair_counts = [x + y for x, y in zip(model.pair_counts, r["s"][1:5], strict=True)]
            often = r["s"][5:]
            if often:
                model.large[r["s"][0]] = dict(zip(often[: len(often) // 2], often[len(often) // 2 :], strict=True))
        else:
            model.words[r["bucket"]] = (r["uri"], r["n"])
            model.tokens += r["s"][0]
            model.types += r["s"][1]
            model.word_counts = [x + y for x, y in zip(model.word_counts, r["s"][2:], strict=True)]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", batch_tokens: int = 1_500_000) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        keys, held, n = [], [], 0

        def scored():
            nonlocal keys, held, n
            tokens, known, base, own = zip(*model.score(held), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(keys, type_), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(keys), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=names)
            keys, held, n = [], [], 0
            return out

        for b in batches:
            type_ = b.column(0).type
            for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys.append(key)
                held.append(token_hashes(value.as_py()))
                n += len(held[-1])
                if n > batch_tokens:
                    yield scored()
        if held:
            yield scored()

    return docs.select(id_col, F.encode(F.col(text), "UTF-8").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Learns from the rows that are not held out and scores all: (id, held_out, and score()'s columns)."""
    model = fit(docs.where(~held_out(id_col)), text, buckets)
    found = score(docs, model, id_col, text)
    return found.select(id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
