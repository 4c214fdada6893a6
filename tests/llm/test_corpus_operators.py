"""Each operator against its brute-force form, and on nulls, empty and long texts, ties, repeated rows, empty tables
and clashing column names."""

import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute as B  # noqa: E402

from chronoloom.llm import byte_bpe, chunks, decontaminate, embedding_dedup, huffman, language_id, line_dedup, piece_count, sharding, simhash, substring_dedup, token_output  # noqa: E402
from chronoloom.llm.components import connected_components  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_rng = random.Random(5)
_words = ["the", "of", "über", "Straße", "naïve", "a", "I", "x1", "42", "don't", "café,", "end.", "中文", "𝒳", "<|endoftext|>", "<s>"]
_passage = " ".join(_rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(_rng.randint(0, 9)) for _ in range(60))


def _text(k):
    r = random.Random(k)
    parts = [" ".join(r.choice(_words) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
    if r.random() < 0.3:
        parts.insert(r.randint(0, len(parts)), _passage)
    if r.random() < 0.3:
        parts.append(r.choice(["Common Line ", "\tcommon line", "another  line"]))
    return r.choice(["\n", "\n", "\n\n", " \n", "  "]).join(parts)


TEXTS = [_text(k) for k in range(60)] + [None, "", " ", "\n", "\n\n ", "a", "ab\tc", "\x85  x", "▁▁ a", "word " * 3000, "same text here", "same text here", _passage, _passage]
ROWS = [(i, t, None if i % 7 == 0 else "en", "s", None) for i, t in enumerate(TEXTS)]
PAIRS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


# ---- 1: token files ----


@pytest.mark.parametrize("size,n", [(2, 1), (5, 63), (5, 64), (300, 65), (50_000, 20_000)])
def test_huffman_round_trip(size, n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % size).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=size))
    assert lengths.max() <= huffman.LIMIT
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    book = huffman.Codebook.from_bytes(lengths.tobytes())
    back, lens = huffman.decode_block(book, huffman.encode_block(book, ids, np.array([n // 2, n - n // 2])))
    assert (back == ids).all() and lens.tolist() == [n // 2, n - n // 2]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5001])
def test_huffman_bits_are_the_codes_one_after_another(n):
    """Codes of every length up to the limit, packed two at a time, are the plain bit string with an offset every STEP codes."""
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    book = huffman.Codebook(huffman.code_lengths(np.array(counts)))
    assert book.lengths.max() == huffman.LIMIT
    ids = np.random.default_rng(n).integers(0, 30, n)
    codes = [format(int(book.codes[i]), f"0{book.lengths[i]}b") for i in ids]
    bits = "".join(codes)
    marks = np.cumsum([0, *map(len, codes)])[:-1][:: huffman.STEP] if n else np.empty(0)
    body = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert huffman.encode_block(book, ids, np.array([n])).endswith(np.array([n], "<u4").tobytes() + marks.astype("<u8").tobytes() + body)


def test_huffman_is_optimal_below_the_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 50)
    heap = [(int(c), 0) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        cost += a + b
        heapq.heappush(heap, (a + b, 0))
    assert (huffman.code_lengths(counts) * counts).sum() == cost


def test_token_files(spark, docs, tmp_path):
    token_output.write_tokens(docs, JSON, str(tmp_path / "t"), end_id=2)
    got = by_id(token_output.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", F.crc32("ids")))
    assert got == B.op1(PAIRS, JSON, 2)


def test_token_files_of_nothing_and_odd_rows(spark, empty, tmp_path):
    token_output.write_tokens(empty, JSON, str(tmp_path / "e"), end_id=2)
    assert token_output.read_tokens(spark, str(tmp_path / "e")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, None), (3, None), (1, "c")], "doc_id long, text string")
    token_output.write_tokens(odd, JSON, str(tmp_path / "o"), end_id=2)
    rows = token_output.read_tokens(spark, str(tmp_path / "o")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 3, 3] and [r.n_tokens for r in rows] == [3, 2, 1, 1]


# ---- 2: sharding ----


def test_schedule_is_longest_processing_time():
    import heapq

    r = random.Random(2)
    sizes = [r.choice([5, 7, 100, 1000, 3]) for _ in range(500)]
    heap = [(0, s) for s in range(6)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    classes = [(c, sizes.count(c), c * sizes.count(c)) for c in set(sizes)]
    plan = sharding.schedule(classes, 6)
    loads = [0] * 6
    for c, runs in plan.items():
        assert sum(n for _, n in runs) == sizes.count(c)
        for s, n in runs:
            loads[s] += c * n
    assert sorted(loads) == sorted(x for x, _ in heap)


def test_sharding(spark, docs, empty):
    rows = sharding.assign(docs, shards=5).collect()
    assert len(rows) == len(TEXTS)
    shard = {r.doc_id: r.shard for r in rows}
    text = dict(PAIRS)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 for r in rows)
    groups = {}
    for i, t in PAIRS:
        groups.setdefault(t, set()).add(shard[i])
    assert all(len(s) == 1 for s in groups.values())
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(empty, shards=5).count() == 0


def test_sharding_against_plain_scheduling(spark):
    r = random.Random(12)
    texts = ["x" * r.choice([1, 1, 2, 30, 400, r.randint(0, 3000)]) + str(r.randint(0, 40)) for _ in range(700)] + [None] * 30 + ["", ""] + ["hot"] * 400
    rows = list(enumerate(texts))
    told, loads = B.op2(rows, 7)
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    assert {x.doc_id: (x["size"], x.text_crc32) for x in got} == told
    mine = [0] * 7
    for x in got:
        mine[x.shard] += x["size"]
    assert sorted(mine) == loads
    of = {}
    for x in got:
        of.setdefault(texts[x.doc_id], set()).add(x.shard)
    assert all(len(v) == 1 for v in of.values())


def test_size_classes_are_bounded_and_ordered(spark):
    sizes = [0, 1, 65_535, 65_536, 65_600, 131_071, 131_072, 10**9, 10**15]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = [r[0] for r in df.select(sharding.size_class(F.col("s")), "s").orderBy("s").collect()]
    assert got == sorted(got) and len(set(got)) >= 8


# ---- 3 and 5: token counts and byte-level BPE ----


def _fuzz(seed, n=2000):
    r = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", "a", "b", "é", "中", "𝒳", "1", "'s", ".", ",", " ", "<s>", "\r\n", "ab ", "\x85", "▁", " \n", "the", "\x00", "and ", "<|endoftext|>"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", None]


def test_piece_counts_match_the_library():
    import sentencepiece

    model, ours = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_count.PieceCounter(PIECES)
    texts = _fuzz(1) + TEXTS
    assert ours.counts(pa.array(texts)).tolist() == [len(model.encode(t or "")) for t in texts]


@pytest.mark.parametrize("limit", [2, 40])
def test_piece_cache_is_only_a_cache(limit, monkeypatch):
    ours, tok = piece_count.PieceCounter(PIECES), byte_bpe.ByteLevelTokenizer.from_json(JSON)
    texts = TEXTS + _fuzz(7, 300)
    expected, ids = ours.counts(pa.array(texts)).tolist(), [x.tolist() for x in tok.encode(texts)]
    ours.cache.limit = tok.cache.limit = limit
    monkeypatch.setattr(chunks, "CACHE_CHARS", 3)
    assert [n for t in texts for n in ours.counts(pa.array([t], pa.string())).tolist()] == expected
    assert [x.tolist() for t in texts for x in tok.encode([t])] == ids
    assert [x.tolist() for x in tok.encode(texts)] == ids


def test_fresh_pieces_take_few_calls():
    """New words, with marks, in lines and of any script, go to the library in runs; Python makes at most two calls for each."""
    import cProfile
    import pstats

    r = random.Random(3)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(9)) + r.choice(["", ",", ".", "²,", ".,"]) for _ in range(6000)]
    text = "".join(r.choice([" ", " ", "\n"]) + w for w in words)[1:]
    tok, profile = byte_bpe.ByteLevelTokenizer.from_json(JSON), cProfile.Profile()
    tok.encode(["some\nwords, imports done"])
    profile.enable()
    ids, _ = tok.encode_flat(pa.array([text, text]))
    profile.disable()
    assert ids.tolist() == 2 * tok.library.encode(text, add_special_tokens=False).ids
    assert pstats.Stats(profile).total_calls < 2 * len(words)


def test_long_texts_are_cut_where_it_is_exact(monkeypatch):
    """Texts beyond the bound go in parts, with the ids and counts of the whole."""
    texts = [" ".join(t for t in _fuzz(k, 60) if t) for k in range(30)] + [None, "ab cd", _passage]
    ours, tok = piece_count.PieceCounter(PIECES), byte_bpe.ByteLevelTokenizer.from_json(JSON)
    expected = ours.counts(pa.array(texts)).tolist()
    ids, ends = tok.encode_flat(pa.array(texts), 2)
    for size in (1, 17, 100):
        monkeypatch.setattr(chunks, "SLICE_BYTES", size)
        monkeypatch.setattr(chunks.cut_long, "__defaults__", (size,))
        assert all(" ".join(chunks.cut_long(t)) == t for t in texts if t)
        assert ours.counts(pa.array(texts)).tolist() == expected
        got = tok.encode_flat(pa.array(texts), 2)
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == ends.tolist()


def test_token_counts(docs, empty):
    got = by_id(piece_count.count_tokens(docs, PIECES).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), "n_tokens", F.col("n_tokens") > 4096))
    assert got == B.op3(PAIRS, PIECES)
    assert piece_count.count_tokens(empty, PIECES).count() == 0


@pytest.mark.parametrize("path", [JSON, RANKS])
def test_byte_bpe_matches_the_libraries(path):
    tok, texts = byte_bpe.tokenizer(path), _fuzz(2) + TEXTS
    if path == JSON:
        expected = [tok.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    else:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
        expected = [enc.encode_ordinary(t or "") for t in texts]
    got = tok.encode(texts)
    assert [g.tolist() for g in got] == expected
    assert all(tok.decode(g.tolist()) == (t or "").encode() for t, g in zip(texts, got, strict=True))


def test_byte_bpe_columns(docs, empty):
    encoded = byte_bpe.encode(docs.withColumn("ids", F.lit("clash")), RANKS, offsets="offsets")
    both = byte_bpe.decode(encoded, RANKS)
    got = by_id(both.select("doc_id", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), F.sha2("decoded", 256)))
    assert got == B.op5(PAIRS, RANKS, public_tokenizers.PATTERN)
    for r in both.select("text", "ids", "offsets").collect():
        assert len(r.ids) == len(r.offsets)
        assert all(a < b for a, b in r.offsets) and (not r.offsets or r.offsets[-1][1] == len(r.text))
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS), RANKS).count() == 0


# ---- 4: language ID ----


def _languages(n=400):
    r = random.Random(9)
    alphabets = {"aa": "abcde", "bb": "efghi", "cc": "aeiou"}
    for i in range(n):
        lang = r.choice(list(alphabets))
        yield i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 60))), lang


def test_rejection_is_not_moved_by_one_odd_text():
    """A mislabelled text among those calibrated on leaves the limits of both languages where they are."""
    models = language_id.Models.fit({"x": {"abab": 5, "ba": 2, "aab": 3}, "y": {"bb": 4, "bab": 1}})
    rng = np.random.default_rng(2)
    h = np.concatenate([rng.normal([1.4, 3.0], 0.05, (200, 2)), rng.normal([3.0, 1.6], 0.05, (200, 2))])
    truth = np.repeat([0, 1], 200)
    h[7] = [9.0, 9.5]
    models.calibrate(h, truth)
    limit = np.broadcast_to(models.limit, 2)
    assert (limit > h[truth == truth].min(0)).all() and (limit < 2.5).all()


def test_language_id(spark, empty):
    rows = list(_languages())
    extra = [(1000, None, "aa"), (1001, "12 ,. !", "aa"), (1002, "", None), (None, "abc abc", "bb"), (1003, "abcde cabed", None), (1003, "abcde cabed", None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("language", F.lit("clash"))
    models = language_id.train(df)
    out = language_id.identify(df, models).select("doc_id", "lang", language_id.held_out(F.col("doc_id")).alias("held"), F.col("language.lang").alias("pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected")).collect()
    held = [r for r in out if r.held and r.lang and r.doc_id < 1000]
    assert sum(r.pred == r.lang for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r.pred for r in out if r.doc_id in (1000, 1001, 1002)}
    assert set(odd.values()) == {"und"}
    assert sum(r.rejected for r in out if r.pred != "und") == 0
    assert language_id.keep_identified(df).count() == len(rows) + 3
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_models_are_distributions():
    models = language_id.Models.fit({"x": {"abab": 5, "ba": 2, "aab": 3}, "y": {"bb": 4, "bab": 1}})
    level = models.levels[0]
    assert np.exp(level.logp).sum(0) <= 1 + 1e-6 if level.logp.ndim == 1 else (np.exp(level.logp).sum(0) <= 1 + 1e-5).all()
    h, letters = models.cross_entropies(["abab aab", "bb bab"])
    assert h[0].argmin() == 0 and h[1].argmin() == 1 and letters.tolist() == [7, 5]


def test_models_are_plain_kneser_ney():
    r = random.Random(14)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 7)))
    counts = {"x": {word("abcd"): r.randint(1, 4) for _ in range(40)}, "y": {word("cdef"): r.randint(1, 9) for _ in range(30)}}
    models = language_id.Models.fit(counts)
    plain = {lang: B.kneser_ney(counts[lang]) for lang in counts}
    alphabet = len(plain["x"][1] | plain["y"][1])
    words = [word("abcdefgz") for _ in range(60)] + list(counts["x"])[:5]
    got = models.word_scores(words)
    for w, scores in zip(words, got, strict=True):
        padded = f" {w} "
        for k, lang in enumerate(models.langs):
            expected = sum(np.log(plain[lang][0](padded[i], padded[max(0, i - 3) : i], alphabet)) for i in range(1, len(padded)))
            assert abs(scores[k] - expected) < 1e-3 * len(padded), (w, lang)


def test_gibberish_is_rejected(spark):
    rows = list(_languages())
    models = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.predict(["zq xw zzvv kqx wzxq qqzk"])[0][3]


# ---- 6: lines ----


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(docs, keep_first):
    made = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=4, keep_first=keep_first))
    assert by_id(made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))) == B.op6(PAIRS, 4, keep_first)
    for r in made.select("n_dropped", "drop_runs").collect():
        assert sum(r.drop_runs[1::2]) == r.n_dropped


def test_line_dedup_odd_rows(spark, empty):
    rows = [(None, "x\ny"), (None, "x\nz"), (1, "X \n\nq"), (1, "X \n\nq"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("clash"), "kept_text": F.lit(1)})
    made = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, min_docs=3))
    assert sorted(r.kept_text for r in made.collect()) == ["", "\nq", "\nq", "y", "z"]
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


# ---- 7: embeddings ----


def _vectors(n=400, dim=12):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for k in range(0, n, 4):
        rows[k] = rows[(k * 7) % 40 * 4 + 1] + rng.normal(size=dim) * 0.05
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


def test_embedding_dedup(spark, monkeypatch):
    rows = _vectors() + [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0, None] * 6), (904, [float("nan")] * 12), (905, [1.0, 0.0, 0.0]), (906, [2.0, 0.0, 0.0])]
    rows += [(910, rows[5][1]), (911, rows[5][1]), (912, [2 * x for x in rows[5][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    assert by_id(embedding_dedup.near_vectors(df)) == B.op7(rows)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 3)  # exact form, and cells that are split
    exact = embedding_dedup.near_vectors(df, recall=1.0)
    assert by_id(exact) == B.op7(rows)
    assert embedding_dedup.measured_recall(df, exact) == 1.0
    assert embedding_dedup.measured_recall(df, exact.withColumn("n_links", F.lit(0))) == 0.0


def test_embedding_dedup_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(none).count() == 0
    one = spark.createDataFrame([(3, [1.0, 2.0]), (4, None)], "vec_id long, embedding array<float>")
    assert by_id(embedding_dedup.near_vectors(one)) == {3: (0, 3), 4: (0, 4)}


def test_embedding_cells_are_calibrated_without_links(spark):
    """Where no probe has a partner, links at the limit must be found all the same."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = embedding_dedup.Grid.fit(x, 128)
    nodes = spark.createDataFrame([(v.tolist(),) for v in x[:1000]], "unit array<double>")
    count = embedding_dedup._calibrate(nodes, grid, x[:300], 0.95, 0.999)
    q = x[3000:5000]
    aside = rng.standard_normal(q.shape)
    aside -= (aside * q).sum(1)[:, None] * q
    y = 0.951 * q + np.sqrt(1 - 0.951**2) * aside / np.linalg.norm(aside, axis=1)[:, None]
    dq, dy = grid.distances(q), grid.distances(y)
    either = zip(grid.cells(*dy).tolist(), grid.visits(*dq, count), grid.cells(*dq).tolist(), grid.visits(*dy, count), strict=True)
    assert np.mean([a in va or b in vb for a, va, b, vb in either]) >= 0.995


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    cells = embedding_dedup.traversal(a, b, 63)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == 63


# ---- 8: SimHash ----


def test_golay_keys_meet_within_one_bit():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 5000)
    near = words ^ (1 << rng.integers(0, 23, 5000))
    own = simhash.segment_keys(words)[0][:, 0]
    keys, real = simhash.segment_keys(near)
    assert ((keys == own[:, None]) & real).any(1).all()


@pytest.mark.parametrize("segments", [3, 4])
def test_groups_find_all_links(spark, segments):
    rng = np.random.default_rng(segments)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 60)
    near = []
    for b in base:
        for _ in range(4):
            v = int(b)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                v ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            near.append(v)
    fps = sorted({int(x) for x in base} | set(near))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3]
    of = B.components(len(fps), links)
    expected = {}
    for i, c in enumerate(of):
        expected.setdefault(c, set()).add(fps[i])
    got = {}
    for r in simhash.groups(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, segments).collect():
        got.setdefault(r.component, set()).add(r.fp)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in expected.values() if len(s) > 1}


def test_simhash(spark, docs, empty):
    found = simhash.near_duplicates(docs, words=3)
    assert by_id(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")) == B.op8(PAIRS)
    kept = {r.doc_id for r in simhash.keep_one(docs, words=5).collect()}
    assert kept == {i for i, (_, c) in B.op8(PAIRS, words=5).items() if i == c}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(odd).collect()] == [4, 4, 4]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = B.components(400, edges)
    assert got == {x: of[x] for e in edges for x in e if e[0] != e[1] or x in got}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- memory of workers ----

_HELD = """
import random, re, sys
import public_tokenizers
import pyarrow as pa
from chronoloom.llm import byte_bpe
anon = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
tok = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
encode = getattr(tok, "encode_lists", tok.encode_flat)
r = random.Random(1)
words = ["%x" % r.getrandbits(24) for _ in range(60_000)]
before = anon()
for _ in range(3):
    column = pa.array([" ".join(r.choices(words, k=300)) for _ in range(15_000)])
    made = encode(column)
    del column, made
print(anon() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read")
def test_encoding_gives_memory_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = subprocess.run([sys.executable, "-c", _HELD], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True, timeout=300)
    assert float(made.stdout) < 60  # MB: what is remembered, and the last ids


# ---- 9: decontamination ----

ITEMS = [(0, " ".join(_passage.split()[:30])), (1, "The of straße"), (2, None), (3, "..."), (None, "a"), (4, "42 42"), (4, "42 42"), (10, " ".join(_passage.split()[20:50]))]


@pytest.mark.parametrize("bits", [27, 18])
def test_decontamination(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_hits(docs.withColumn("hits", F.lit("clash")), items, 13)
    n, hit = F.col("hits.n_words"), decontaminate.hit_words("hits.runs")
    got = by_id(found.select("doc_id", n, hit, F.size("hits.items"), F.sha2(F.array_join("hits.items", ","), 256), decontaminate.contaminated(hit, n)))
    assert got == B.op9(PAIRS, [(i, t) for i, t in ITEMS if i is not None])


def test_words_are_counted_without_making_them(spark, docs):
    odd = ["a", "A-b", "-", "x", "é", "\u0300", "", None, "中 文", "a" * 70_000, "a b " * 9, "Z[`{9:/", "\x00\x7f\x80"]
    of = pa.array(["cut off", *TEXTS, *odd])[1:]  # a slice
    want = [B.op9([(0, t)], [])[0][0] for t in [*TEXTS, *odd]]
    for kind in (pa.string(), pa.large_string()):
        assert decontaminate.count_words(of.cast(kind)).to_pylist() == want
    assert decontaminate.count_words(pa.array([], pa.string())).to_pylist() == []
    found = decontaminate.find_hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), 13)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "count_words" in plan  # an array of a text's words costs more than all else


def test_decontamination_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == len(TEXTS)
    assert decontaminate.keep_clean(empty, items).count() == 0
    left = {r.doc_id for r in decontaminate.keep_clean(docs, items.where("item_id IN (0, 10)")).collect()}
    assert left == {i for i, t in PAIRS if t is None or "beta" not in t}


# ---- 10: substrings ----


@pytest.mark.parametrize("group", [2, 20, 20_000])
def test_substring_dedup(docs, group):
    made = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash")), 20, group=group)
    assert by_id(made.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256))) == B.op10(PAIRS)


def test_substring_dedup_random(spark):
    r = random.Random(3)
    passages = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 4))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(["x y " * r.randint(5, 30)] if r.random() < 0.1 else parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (3, 2000):
        made = substring_dedup.remove_repeats(df, 20, group=group)
        assert by_id(made.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256))) == B.op10(rows)


def test_substring_dedup_odd_rows(spark, empty):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(None, long), (3, long), (3, long), (5, "x " + long), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(df, 20).collect())
    assert got == [(False, 3, 0), (False, 3, 0), (False, 5, 25), (False, 6, 0), (True, 0, 25)]
    assert substring_dedup.remove_repeats(empty, 20).count() == 0


# ---- names, ids and very long texts ----

CLASH = ["_a", "_b", "_k", "_ka", "_kb", "_n", "_runs", "_row", "_id", "_bid", "_brow", "_lines", "_first", "_made", "_found", "_hits", "_language", "_gone", "_bucket", "key", "a", "b", "n", "e", "h", "g", "doc", "start", "parts", "part", "fp", "hits", "kept", "place", "window", "item"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en") for i, t in enumerate(["one two three " * 12, "one two three " * 12, _passage, "x\ny", None, ""])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.mark.parametrize("run", [
    lambda d: line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d, min_docs=2)),
    lambda d: substring_dedup.remove_repeats(d),
    lambda d: decontaminate.find_hits(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 2"), out="found"),
    lambda d: decontaminate.keep_clean(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 3")),
    lambda d: language_id.keep_identified(d),
    lambda d: simhash.keep_one(d),
    lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS), RANKS),
    lambda d: piece_count.count_tokens(d, PIECES),
], ids="lines substrings hits clean language simhash bpe pieces".split())
def test_columns_of_internal_names_stay(clashing, run):
    made = run(clashing)
    assert set(CLASH) <= set(made.columns)
    assert all(r[c] == 7 for r in made.select(*CLASH).collect() for c in CLASH)


def test_columns_of_internal_names_do_not_matter(spark, clashing, tmp_path):
    plain = clashing.select("doc_id", "text")
    rows = lambda df: sorted(map(str, df.collect()))
    for run in (lambda d: sharding.assign(d, shards=3), lambda d: simhash.near_duplicates(d)):
        assert rows(run(clashing)) == rows(run(plain))
    token_output.write_tokens(clashing, JSON, str(tmp_path / "c"), end_id=2)
    token_output.write_tokens(plain, JSON, str(tmp_path / "p"), end_id=2)
    assert rows(token_output.read_tokens(spark, str(tmp_path / "c"))) == rows(token_output.read_tokens(spark, str(tmp_path / "p")))


def test_periodic_and_very_long_texts(spark):
    """One run of windows far beyond a group, a text of a million words, and a word of a megabyte."""
    r = random.Random(8)
    rows = [(0, "la " * 30_000), (1, "la " * 25_000), (2, " ".join(str(r.randint(0, 10**6)) for _ in range(300_000))), (3, "w" * 1_500_000 + " end")]
    made = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in made.select("doc_id", "n_words", "n_removed").collect()}
    assert got == {0: (30_000, 29_999), 1: (25_000, 25_000), 2: (300_000, 0), 3: (2, 0)}


def test_line_sql_says_the_same_of_repeated_and_missing_ids(spark, tmp_path):
    import duckdb

    from chronoloom.llm import queries

    rows = [(5, f"same\n{k}") for k in range(6)] + [(6, "same")] * 3 + [(None, "same\nx"), (None, "same\nx"), (None, "SAME "), (7, None), (8, "same\n\nq")]
    more = [(5, f"other\n{k}") for k in range(5)] + [(9, "other")] * 9
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = queries.op6_line_dedup(spark, str(tmp_path))
    said = con.sql(queries.OP6_SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, said))
    assert {r.n_dropped for r in made.collect()} == {0, 1}


def test_hot_keys_are_split(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)})
    far = [x ^ 0x7FFF000000000000 for x in fps[:40]]
    df = spark.createDataFrame([(f,) for f in fps + far], "fp long")
    expected = {(r.fp, r.component) for r in simhash.groups(df).collect()}
    monkeypatch.setattr(simhash, "PART", 7)
    assert {(r.fp, r.component) for r in simhash.groups(df).collect()} == expected
    assert {(r.fp, r.component) for r in simhash.groups(df, segments=4).collect()} == expected


def test_suffix_trees():
    """Common prefixes, deep nodes and maximal repeats against all pairs."""
    r = random.Random(2)
    for _ in range(60):
        rows = [(g, d, 0, 100 * d, 0, b" ".join(r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(3, 15)))) for g in range(2) for d in range(3)]
        tree = substring_dedup.SuffixTrees(np.array([x[0] for x in rows]), [x[5] for x in rows])
        words = [x[5].split() for x in rows]
        suffix = lambda i: words[tree.segment[i]][tree.place[i] :]  # noqa: B023, E731
        group = lambda i: rows[tree.segment[i]][0]  # noqa: B023, E731

        def common(i, j):
            n = 0
            if group(i) == group(j):  # noqa: B023
                for x, y in zip(suffix(i), suffix(j), strict=False):  # noqa: B023
                    if x != y:
                        break
                    n += 1
            return n

        assert [common(i, j) for i, j in zip(tree.order[:-1], tree.order[1:], strict=True)] == tree.common.tolist()
        pairs = {(i, j) for i in range(len(tree.order)) for j in range(i) if common(i, j) >= 3}
        node, members, depth = tree.deep_nodes(3)
        of = [sorted(members[node == k].tolist()) for k in range(len(depth))]
        assert {(j, i) for m in of for x, i in enumerate(m) for j in m[x + 1 :]} == pairs
        for n, m in tree.maximal_repeats(3):
            assert min(common(i, j) for i in m for j in m if i < j) == n
