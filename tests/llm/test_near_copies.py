"""Near copies at a Jaccard similarity of 0.8, against all pairs of shingle sets."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute as B  # noqa: E402

import corpus_pipeline  # noqa: E402
from chronoloom.llm import near_copies, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words=5):
    found = text.lower().split()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def edited(r, words, changes):
    out = list(words)
    for at in r.sample(range(len(out)), changes):
        out[at] = f"new{r.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = []
    for length, changes in [(60, 1), (250, 1), (250, 3), (250, 5), (250, 12), (1000, 10), (1000, 22), (1000, 40)]:
        for _ in range(12):
            base = say(length)
            out += [base, edited(r, base, changes)]
    base = say(150)  # a hub: copies meet through it, seldom one another
    out += [base] + [edited(r, base, 3) for _ in range(60)]
    passage = say(40)  # a passage in many texts makes no copies
    out += [say(60) + passage + say(60) for _ in range(40)]
    texts = [" ".join(t) for t in out]
    r.shuffle(texts)
    return dict(enumerate(texts))


def survivors(texts):
    sets = [shingles(t) for t in texts.values()]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (c := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    return {i for i, c in enumerate(B.components(len(sets), links)) if i == c}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)


def test_all_pairs_at_the_limit(spark, texts):
    expected = survivors(texts)
    assert len(expected) < len(texts) - 60
    docs = frame(spark, texts.items())
    made = corpus_pipeline.near_duplicates(spark, docs, "")
    assert made.columns == docs.columns and sorted(r.doc_id for r in made.collect()) == sorted(expected)


def test_buckets_in_chunks(spark, texts, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 1500)
    made = near_copies.keep_one(frame(spark, texts.items()))
    assert sorted(r.doc_id for r in made.collect()) == sorted(survivors(texts))


def test_null_and_repeated_ids_leave_one_row(spark):
    one, two, three = ("".join(f"{c}{i} " for i in range(30)) for c in "abc")
    rows = [(None, one), (None, one), (None, one + "."), (4, two), (4, two), (9, two), (None, two), (6, three), (6, one.replace("a1 ", "z "))]
    made = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text[0]) for r in made)
    assert kept == [(False, 4, "b"), (False, 6, "a"), (False, 6, "c")]


def test_keys_are_golay_indices_of_the_simhash():
    r = np.random.default_rng(2)
    for size in (0, 4, 9, 300, 700):
        found = near_copies.shingle_set(" ".join(map(str, r.integers(0, 10**9, size + 4))) if size else "", 5)
        made = near_copies.fingerprint(found)
        assert int.from_bytes(made[:8].tobytes(), "big") == simhash._majority(found.astype(">u8").view(np.uint8).reshape(-1, 8))
        bits = np.unpackbits(made)
        tables = near_copies.TABLES[1] * (2 if size <= near_copies.SMALL else 1)
        expected = set()
        for t in range(tables):
            word = sum(int(b) << i for i, b in enumerate(bits[23 * t : 23 * t + 23]))
            keys, real = simhash.segment_keys(np.array([word]))
            expected |= {t << 12 | int(k) for k in keys[0][real[0]]}
        row, key = near_copies.golay_keys(made[None, :])
        assert not row.any() and sorted(key.tolist()) == sorted(expected)


@pytest.mark.parametrize("per", [1, 2])
@pytest.mark.parametrize(("a", "b", "common"), [(4, 5, 4), (9, 9, 8), (45, 45, 40), (80, 100, 80)])
def test_pairs_at_the_limit_are_candidates(a, b, common, per):
    """Sets with a similarity of exactly 0.8 share a key and pass the radius; sets with nothing in common hardly ever pass it."""
    r = np.random.default_rng(a)
    prints = []
    for _ in range(300):
        all_ = r.integers(0, 1 << 64, a + b - common, np.uint64)
        prints += [near_copies.fingerprint(x, per) for x in (all_[:a], all_[a - common :])]
    prints = np.array(prints)
    row, key = near_copies.golay_keys(prints, per)
    keys = [set() for _ in prints]
    for i, k in zip(row.tolist(), key.tolist(), strict=True):
        keys[i].add(k)
    apart = lambda x, y, words: int(np.unpackbits(x[: 8 * words] ^ y[: 8 * words]).sum())
    for i in range(0, len(prints), 2):
        assert keys[i] & keys[i + 1]
        assert apart(prints[i], prints[i + 1], near_copies.CHECKED) <= near_copies.MAX_BITS and apart(prints[i], prints[i + 1], 1) <= near_copies.MAX_FIRST
    assert sum(apart(prints[i], prints[i + 2], near_copies.CHECKED) <= near_copies.MAX_BITS for i in range(0, len(prints) - 2, 2)) <= 1


def test_neighbours_against_all_pairs():
    r = np.random.default_rng(4)
    rows = []
    for key, members in enumerate([1, 2, 3, 40, 300, 5]):
        centres = r.integers(-(1 << 63), (1 << 63) - 1, (members // 6 + 1, near_copies.CHECKED))
        for _ in range(members):
            w = centres[r.integers(len(centres))].copy()
            for bit in r.choice(64 * near_copies.CHECKED, r.integers(0, 45), replace=False):
                w[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).view(np.int64))
            one, other = (0, 0) if key != 3 else (0, 1)
            rows.append((key, one, other, int(r.integers(one, other + 1)), len(rows), int(r.choice([50, 55, 70])), *w.tolist()))
    rows.sort(key=lambda x: (x[:3], x[5]))
    columns = dict(zip(near_copies._BLOCK, (np.array(c, np.int64) for c in zip(*rows, strict=True)), strict=True))
    bits = lambda x, y, n: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x[6 : 6 + n], y[6 : 6 + n], strict=True))
    links = [
        (i, j)
        for j, y in enumerate(rows)
        for i, x in enumerate(rows[:j])
        if x[:3] == y[:3] and x[5] >= 0.8 * y[5] and (x[3] != y[3] or x[1] == x[2]) and bits(x, y, 1) <= near_copies.MAX_FIRST and bits(x, y, near_copies.CHECKED) <= near_copies.MAX_BITS
    ]
    expected = B.components(len(rows), links)
    assert near_copies.neighbours(columns, 0.8).tolist() == list(expected) and len(set(expected)) < len(rows) - 100


def components(spark, texts, **options):
    made = near_copies.near_copies(frame(spark, texts.items()), **options).collect()
    least = {}
    for r in made:
        least[r.component] = min(r.doc_id, least.get(r.component, r.doc_id))
    return set(least.values())


def test_keys_of_two_segments(spark, texts):
    assert components(spark, texts, per=2) == survivors(texts)


def test_buckets_in_parts(spark, texts, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 10)
    assert components(spark, texts) == survivors(texts)


def test_short_texts(spark):
    """Four shingles in five, the smallest sets that can be similar and not equal."""
    base = [[f"w{i}x{k}" for k in range(9)] for i in range(200)]
    texts = dict(enumerate(" ".join(words[:n]) for words in base for n in (9, 8, 7)))
    assert components(spark, texts) == survivors(texts) and len(survivors(texts)) == 400
