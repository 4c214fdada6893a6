"""Plain-Python forms of the operators' results, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import xxhash

SPACE = "[^\x20\x09-\x0d]+"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def op1(docs, path, end_id):
    from tokenizers import Tokenizer

    tok, out, at = Tokenizer.from_file(path), {}, 0
    for doc_id, text in sorted(docs):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def op3(docs, path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {d: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in docs}


def op5(docs, path, pattern):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    made = {d: enc.encode_ordinary(t or "") for d, t in docs}
    return {d: (len(i), sha(" ".join(map(str, i))), sha(enc.decode_bytes(i))) for d, i in made.items()}


def op6(docs, min_docs=10, keep_first=False):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    lines = {d: (t or "").split("\n") for d, t in docs}
    seen = {}
    for d in lines:
        for k in {key(x) for x in lines[d]}:
            seen[k] = seen.get(k, 0) + 1
    first, out = set(), {}
    for d in sorted(lines):
        kept = []
        for x in lines[d]:
            k = key(x)
            drop = k != "" and seen[k] >= min_docs
            if drop and keep_first and k not in first:
                first.add(k)
                drop = False
            if not drop:
                kept.append(x)
        out[d] = (len(lines[d]), len(lines[d]) - len(kept), sha("\n".join(kept)))
    return out


def op7(vectors, least=0.95):
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    names = [i for i, _ in vectors]
    units = [unit(v) for _, v in vectors]
    links = [
        (i, j)
        for i in range(len(units))
        for j in range(i)
        if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least
    ]
    count = np.bincount(np.array(links, int).ravel(), minlength=len(units)) if links else np.zeros(len(units), int)
    order = sorted(range(len(names)), key=lambda i: names[i])
    place = {i: k for k, i in enumerate(order)}
    of = components(len(names), [(place[i], place[j]) for i, j in links])
    return {names[i]: (int(count[i]), names[order[of[place[i]]]]) for i in range(len(names))}


def fingerprint(text, words=3):
    ws = re.findall(SPACE, ascii_lower(text or ""))
    shingles = [" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def op8(docs, words=3, bits=3):
    docs = sorted(docs)
    prints = [fingerprint(t, words) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    of = components(len(docs), links)
    return {docs[i][0]: (f"{prints[i]:016x}", docs[of[i]][0]) for i in range(len(docs))}


def op9(docs, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t or ""))
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                of = windows.get(tuple(w[i : i + size]))
                if of:
                    hit.update(range(i, i + size))
                    found |= of
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def op10(docs, window=20):
    seen, out = set(), {}
    for d, text in sorted(docs):
        w = re.findall(SPACE, text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def op2(docs, shards=40, overhead=16):
    """Per document size and crc32, and the loads that longest-processing-time scheduling of equal texts gives."""
    import heapq
    import zlib

    size = lambda t: len((t or "").encode()) + overhead
    groups = {}
    for _, t in docs:
        groups[t] = groups.get(t, 0) + size(t)
    heap = [0] * shards
    for n in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + n)
    return {d: (size(t), zlib.crc32((t or "").encode())) for d, t in docs}, sorted(heap)


def kneser_ney(counts, order=4):
    """The probability of a character after others by plain interpolated Kneser-Ney over one language's words."""
    raw = [{} for _ in range(order)]
    for word, n in counts.items():
        padded = f" {word} "
        for i in range(1, len(padded)):
            gram = padded[max(0, i - order + 1) : i + 1]
            raw[len(gram) - 1][gram] = raw[len(gram) - 1].get(gram, 0) + n
    for size in range(order - 1, 0, -1):
        for gram in raw[size]:
            raw[size - 1][gram[1:]] = raw[size - 1].get(gram[1:], 0) + 1

    def discount(table):
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        return min(0.9, max(0.1, once / max(once + 2 * twice, 1)))

    off = [discount(t) for t in raw]

    def probability(char, before, alphabet):
        lower = probability(char, before[1:], alphabet) if before else 1 / (alphabet + 1)
        table, d = raw[len(before)], off[len(before)]
        total = sum(v for g, v in table.items() if g[:-1] == before)
        if not total:
            return lower
        kinds = sum(g[:-1] == before for g in table)
        return max(table.get(before + char, 0) - d, 0) / total + d * kinds / total * lower

    return probability, set(raw[0])
