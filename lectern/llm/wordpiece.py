"""Token counts of greedy word pieces by a linear longest-match automaton.

The pieces form two tries, for the start of a word and for its rest. Each node has a failure link, to the node
that is reached when the pieces matched so far are taken off, and the number of these pieces. Reading a
character then either follows an edge or takes failure links, so a word costs time in proportion to its length; only
numbers are kept, no pieces. (Published as LinMaxMatch, in "Fast WordPiece Tokenization".) A word that
cannot be cut into pieces is one unknown token. The bare mark, if it is a piece, starts the words that no longer one starts.

Defined results: null, empty and blank texts have no words and no tokens. Repeated rows count alike, null ids are
kept, long texts counted whole. An empty table gives no rows. Columns other than the id and the text
are not looked at, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker keeps at a time.
WORDS_KEPT = 500_000
MARK = "▁"

_automata: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that start words, without their mark (the bare mark is empty then), and those that go on, from a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    real = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [p[1:] for p in real if p.startswith(MARK)], [p for p in real if not p.startswith(MARK)]


class Automaton:
    """Nodes are numbers: 0 is the start of a word, 1 the start of its rest, -1 nowhere."""

    def __init__(self, starts: list[str], rests: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, starts), (1, rests)):
            for p in pieces:
                node = root
                for c in p:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    node = self.next[node][c]
                piece[node] = bool(p) or piece[node]
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        if "" in starts:
            self.fail[0], self.pops[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if piece[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z != -1 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.pops[v] = self.next[z][c], popped
            level = below

    def length(self, word: str) -> int:
        """Pieces of a word, 0 if it cannot be cut."""
        node, count, following, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while c not in following[node]:
                count += pops[node]
                node = fail[node]
                if node == -1:
                    return 0
            node = following[node][c]
        while node > 1:
            count += pops[node]
            node = fail[node]
        return count if node == 1 else 0


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) for each row; an unknown word counts as one token."""
    path, kind = vocabulary or default_vocabulary(), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        if path not in _automata:
            _automata[path] = (Automaton(*read_pieces(path)), {})
        automaton, kept = _automata[path]
        for b in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for value in b.column(1):
                ws = (value.as_py() or b"").split()
                try:
                    lengths = list(map(kept.__getitem__, ws))
                except KeyError:
                    if len(kept) > WORDS_KEPT:
                        kept.clear()
                    own = {w: kept[w] if w in kept else automaton.length(w.decode()) for w in dict.fromkeys(ws)}
                    if len(own) <= WORDS_KEPT:
                        kept.update(own)
                    lengths = list(map(own.__getitem__, ws))
                unknown = lengths.count(0)
                n_words.append(len(ws)), n_tokens.append(sum(lengths) + unknown), n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, F.encode(F.col(text), "UTF-8").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")
