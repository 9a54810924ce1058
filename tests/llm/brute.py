"""Plain restatements of the operators' results, one text at a time."""

import re
import zlib
from collections import Counter, defaultdict

import xxhash

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def simhash(text):
    ws = words(lowered(text))
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(fps))]


def targets(sizes):
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    lo, hi = 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(300):  # the level at which weights times it, held at twice the size, make up the total
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < total else (lo, mid)
    return {s: min(2 * sizes[s], hi * weight[s]) for s in names}


def check_pieces(rows, docs, encode):
    """rows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); docs: id to text, of distinct ids."""
    import numpy as np

    ids = {k: encode(t or "") + [2] for k, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, seq, offset in rows:
        assert total == len(ids[d]) and n > 0
        assert zlib.crc32(np.array(ids[d][start : start + n], "<u4").tobytes()) == crc
        by_doc[d].append((start, n))
        by_seq[seq].append((offset, n))
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def features(text):
    import regex

    n, chars, symbols, dup, repeat = quality(text)
    ws, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    stop = set(STOP) | {w[:1].upper() + w[1:].lower() for w in STOP}
    return dict(n_words=n, word_chars=chars, n_symbols=symbols, n_dup_lines=dup, n_repeat_words=repeat, n_lines=len(lines), n_stopwords=sum(w in stop for w in ws), n_letters=len(regex.findall(r"\p{L}", text)), n_capitals=len(regex.findall(r"\p{Lu}", text)))


STOP = (
    "the of and to in is it that for with as on be at by this from are or an was le la les de des et en un une du que qui est "
    "pour dans par au sur der die das und zu den mit von ist nicht ein eine dem im el los del las se su con por para lo al"
).split()


def votes(f):
    n = f["n_words"]
    vote = lambda on, bad, good: 0 if not on else -1 if bad else 1 if good else 0
    return (
        vote(n > 0, f["n_symbols"] > 0.2 * n, f["n_symbols"] <= 0.05 * n),
        vote(n >= 20, f["n_repeat_words"] > 0.35 * n, f["n_repeat_words"] <= 0.2 * n),
        vote(f["n_lines"] >= 4, f["n_dup_lines"] > 0.4 * f["n_lines"], f["n_dup_lines"] <= 0.2 * f["n_lines"]),
        vote(n >= 20, f["word_chars"] < 3 * n or f["word_chars"] > 9 * n, 4 * n <= f["word_chars"] <= 7 * n),
        vote(n >= 20, f["n_stopwords"] < 0.05 * n, f["n_stopwords"] >= 0.12 * n),
        vote(n >= 20, f["n_letters"] < 0.75 * f["word_chars"], f["n_letters"] >= 0.9 * f["word_chars"]),
        vote(n >= 20, f["n_capitals"] > 0.4 * f["n_letters"], f["n_capitals"] <= 0.15 * f["n_letters"]),
    )


def posteriors(vs, good=0.8, right_good=0.98, right_bad=0.5, weight=20.0):
    """Expectation-maximisation over each document by itself, to the end."""
    import math

    k = len(vs[0])
    share, g, b = good, [right_good] * k, [right_bad] * k
    count = Counter(vs)
    for _ in range(5000):
        post = {}
        for v in count:
            odds = math.log(share / (1 - share)) + sum(math.log(g[i] / (1 - b[i])) if x > 0 else math.log((1 - g[i]) / b[i]) if x < 0 else 0 for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-odds))
        clamp = lambda x, lo, hi: min(max(x, lo), hi)
        mass = sum(n * post[v] for v, n in count.items())
        new = clamp((mass + weight * good) / (len(vs) + weight), 0.05, 0.99)
        new_g, new_b = [], []
        for i in range(k):
            hit = sum(n * post[v] for v, n in count.items() if v[i] > 0)
            cast = sum(n * post[v] for v, n in count.items() if v[i])
            new_g.append(clamp((hit + weight * right_good) / (cast + weight), 0.9, 0.9999))
            hit = sum(n * (1 - post[v]) for v, n in count.items() if v[i] < 0)
            cast = sum(n * (1 - post[v]) for v, n in count.items() if v[i])
            new_b.append(clamp((hit + weight * right_bad) / (cast + weight), 0.11, 0.995))
        moved = max(abs(x - y) for x, y in zip([share, *g, *b], [new, *new_g, *new_b], strict=True))
        share, g, b = new, new_g, new_b
        if moved < 1e-12:
            break
    return post


def kept(rows):
    """Places of the texts that the quality rules keep."""
    found = [features(t) for t in rows]
    vs = [votes(f) for f in found]
    post = posteriors(vs)
    return [i for i, f in enumerate(found) if f["n_words"] >= 50 and 100 * f["n_repeat_words"] <= 50 * f["n_words"] and post[vs[i]] >= 0.5], [post[v] for v in vs]
