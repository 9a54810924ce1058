"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n, as attention stays within a document. Documents are cut
into full sequences while they are longer than one; what remains, in descending cost, goes to the sequence of
lowest cost that still has room for it. Where none has, the piece is cut at the room of the cheapest one.

Every partition packs chunks of its own rows (a bounded number of tokens), without a shuffle: rows that are read
again after a lost executor pack alike. A chunk of t tokens opens t // 4096 full sequences; what is left opens
sequences whose lengths are powers of two, so nothing is padded.

Defined results: null texts are empty; an empty text is one end token. Repeated rows are packed each for itself.
Null ids are kept. Long texts are tokenized whole. An empty table gives no pieces.
Columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 4096
END = 2
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
#: Tokens that a chunk has before it is packed; its last document may exceed it.
CHUNK = 2_000_000
#: Pieces that go to the JVM at a time, of at most LENGTH ids each.
BATCH = 1024
#: Words whose ids a worker keeps at a time.
WORDS_KEPT = 500_000

_tokenizers: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words that fall into runs of Latin letters and of ASCII signs other than the apostrophe: the tokenizer's own cuts.
_PLAIN = re.compile("(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+)+")
_RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of whole texts, as the tokenizer gives them, found word by word.

    The tokenizer must drop white space, so that no token holds any and words do not depend on each other; ids of
    recent words and runs are kept. New words of plain runs go to the tokenizer's model run by run, lower-cased and
    in byte letters, as its own first steps would make them; if a probe shows that it cuts otherwise, and for all other words,
    the whole tokenizer is asked. Texts that hold the string of a special token go to it whole.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.most, self.ids = Tokenizer.from_file(path), kept, {}
        self.special = [t.content.lower().encode() for t in self.of.get_added_tokens_decoder().values()]
        self.model, self.letters = self.of.model, _byte_letters()
        probe = "ThaNß.,Ééÿx$$$%Öre(|ing!a-B"
        self.by_runs = self._split(probe) == self._encode([probe.encode()])[0]

    def may(self, text: bytes) -> bool:
        """Whether a special token's string may be in the text, in any case of letters."""
        low = text.lower() if b"<|" in text or any(not s.startswith(b"<|") for s in self.special) else b""
        return bool(low) and any(s in low for s in self.special)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.of.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _run(self, data: bytes) -> bytes:
        """The ids of a run in lower case."""
        found = self.ids.get(data)
        if found is None:
            text = data.decode("ascii") if data.isascii() else "".join(map(self.letters.__getitem__, data))
            ids = [t.id for t in self.model.tokenize(text)]
            found = self.ids[data] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _split(self, word: str) -> bytes:
        return b"".join([self._run(run.encode()) for run in _RUNS.findall(word.lower())])

    def _new(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        found, whole = {}, []
        for w in words:
            if self.by_runs and w.isalpha():  # ASCII letters: a single run
                found[w] = self._run(w.lower())
            elif self.by_runs and _PLAIN.fullmatch(text := w.decode()):
                found[w] = self._split(text)
            else:
                whole.append(w)
        return found | dict(zip(whole, self._encode(whole), strict=True)) if whole else found

    def __call__(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian unsigned 32-bit numbers."""
        if self.may(text):
            return self._encode([text])[0]
        words = text.split()
        if len(self.ids) > self.most:
            self.ids.clear()
        found, new = self.ids, set(words).difference(self.ids)
        if new:
            more = self._new(new)
            if len(more) <= self.most:
                found.update(more)
            else:
                found = found | more
        return b"".join(map(found.__getitem__, words))


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def capacities(tokens: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences that hold so many tokens without padding."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, all of them at least 1."""
    caps = capacities(sum(lengths), length)
    pieces, rest, used = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % length, length):
            pieces.append((d, start, length, used, 0))
            used += 1
        if n % length:
            rest.append((n % length, d, n - n % length))
    room = np.array(caps[used:], np.int64)
    spent = np.zeros(len(room))
    offset = np.zeros(len(room), np.int64)
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while n:
            fits = room >= n
            if fits.any():
                k, take = int(np.argmin(np.where(fits, spent, np.inf))), n
            else:
                k = int(np.argmin(np.where(room > 0, spent, np.inf)))
                take = int(room[k])
            pieces.append((d, start, take, used + k, int(offset[k])))
            room[k] -= take
            offset[k] += take
            spent[k] += cost(take)
            start += take
            n -= take
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """A row for each piece: id, start, length, doc_tokens, sequence_id, offset, and its ids (little-endian unsigned 32-bit)."""
    path, kind = vocabulary or default_vocabulary(), docs.schema[id_col].dataType
    last = np.array([end], "<u4").tobytes()
    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches):
        from pyspark import TaskContext

        ids_of = word_ids(path)
        first = TaskContext.get().partitionId() << 33
        keys, texts, held = [], [], 0

        def packed():
            nonlocal first, keys, texts, held
            pieces = assign([len(t) // 4 for t in texts], length)
            pieces.sort(key=lambda p: (p[3], p[4]))
            for lo in range(0, len(pieces), BATCH):
                part = pieces[lo : lo + BATCH]
                d, start, n, seq, offset = zip(*part, strict=True)
                columns = [pa.array([keys[i] for i in d], type_), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([len(texts[i]) // 4 for i in d], pa.int64()), pa.array([first + s for s in seq], pa.int64()), pa.array(offset, pa.int64()), pa.array([texts[i][4 * s : 4 * (s + k)] for i, s, k in zip(d, start, n, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            first += 1 + max((p[3] for p in pieces), default=-1)
            keys, texts, held = [], [], 0

        type_ = b = value = None
        for b in batches:
            type_ = b.column(0).type
            for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts.append(ids_of(value.as_py() or b"") + last)
                keys.append(key)
                held += len(texts[-1]) // 4
                if held >= chunk:
                    yield from packed()
        del b, value
        if texts:
            yield from packed()
        C.give_back()

    return docs.select(id_col, F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(run, schema)
