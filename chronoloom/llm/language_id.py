"""Language identification by interpolated Kneser-Ney models over characters.

Words (runs of letters, lower-cased, with a space on both sides) are scored
character by character given up to ``ORDER - 1`` characters before.  For each
order the n-grams of all languages are one sorted array of 64-bit hashes, with
a column of interpolated log probabilities for each language; another such
array holds each context's weight of the lower order.  A text's language is
that of the lowest cross-entropy per character.

Models are fitted on a bounded sample: about ``TRAIN_DOCS`` labelled documents
of each language, chosen by a hash of their id; a tenth of them calibrates the
score (a temperature) and each language's limit of cross-entropy beyond which a
text is ``rejected``.

Defined cases: a text that is null or has no letter gets ``und``, score 0 and is
rejected; rows without a language or id don't train; with no labelled row at
all every text gets ``und``; of languages with equal cross-entropies the first
by name is taken, of those with equally many documents too; texts of any length
are scored whole; an empty table gives no rows; further columns stay whatever
their names, one of an output's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, unique_name

ORDER = 4
#: Labelled documents of each language that fit the models; the bound of all that is gathered.
TRAIN_DOCS = 2500
#: Languages that are learned: those of the most labelled documents (a value beyond them is taken for a slip).
LANGUAGES = 1000
UNKNOWN = "und"
#: Words a worker remembers the scores of before it starts afresh.
CACHE_WORDS = 300_000
#: Where a language's limit of cross-entropy lies: so far beyond this quantile of its calibration texts.
QUANTILE, SLACK = 0.99, 1.4
_LETTERS = re.compile(r"[^\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` characters that end at each position; only right from position n-1 on."""
    h = np.full(len(codes), n, np.uint64)
    for k in range(n - 1, -1, -1):
        shifted = codes if k == 0 else np.concatenate([np.zeros(min(k, len(codes)), np.uint64), codes[:-k] if k < len(codes) else codes[:0]])
        h = (h ^ shifted) * _FACTOR
        h ^= h >> np.uint64(31)
    return h


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of ' word ' for all words, how far each is into its word, and where words start."""
    data = " " + "  ".join(words) + " "
    codes = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(lens) - lens
    return codes, np.arange(len(codes)) - np.repeat(starts, lens), starts


@dataclass
class Level:
    """Order n: sorted hashes of n-grams with log probabilities (n-grams x languages), and of contexts with log weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


class Models:
    def __init__(self, langs: list[str], levels: list[Level], floor: np.ndarray, temperature: float = 1.0, limit: float = np.inf):
        self.langs, self.levels, self.floor, self.temperature = langs, levels, floor, temperature
        self.limit = np.full(len(langs), limit)
        self._row: dict[str, int] = {}
        self._table = np.empty((0, len(langs)))

    def __getstate__(self):
        return {**self.__dict__, "_row": {}, "_table": np.empty((0, len(self.langs)))}

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]]) -> Models:
        """``counts``: for each language how often each word is in its texts."""
        langs = sorted(counts)
        raw: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
        for k, lang in enumerate(langs):
            for word, n in counts[lang].items():
                padded = f" {word} "
                for i in range(1, len(padded)):
                    gram = padded[max(0, i - ORDER + 1) : i + 1]
                    of = raw[len(gram) - 1].get(gram)
                    if of is None:
                        of = raw[len(gram) - 1][gram] = np.zeros(len(langs))
                    of[k] += n
        # lower orders count how many characters a sequence was seen after; those at a word's start keep their counts
        for size in range(ORDER - 1, 0, -1):
            below = raw[size - 1]
            for gram, of in raw[size].items():
                shorter = gram[1:]
                got = below.get(shorter)
                if got is None:
                    got = below[shorter] = np.zeros(len(langs))
                got += of > 0
        floor = np.full(len(langs), -np.log(len(raw[0]) + 1.0))
        levels: list[Level] = []
        lower: dict[str, np.ndarray] = {}
        for size in range(1, ORDER + 1):
            table = raw[size - 1]
            grams = sorted(table)
            seen = np.array([table[g] for g in grams]).reshape(len(grams), len(langs))
            context = [g[:-1] for g in grams]
            names = sorted(set(context))
            number = {c: i for i, c in enumerate(names)}
            of = np.array([number[c] for c in context], np.int64)
            total, kinds = (np.zeros((len(names), len(langs))) for _ in range(2))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            once, twice = (seen == 1).sum(0), (seen == 2).sum(0)
            discount = np.clip(once / np.maximum(once + 2.0 * twice, 1), 0.1, 0.9)
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, discount * kinds / total, 1.0)
                own = np.where(total[of] > 0, np.maximum(seen - discount, 0) / total[of], 0.0)
            base = np.array([lower[g[1:]] if size > 1 else np.exp(floor) for g in grams]).reshape(len(grams), len(langs))
            prob = own + weight[of] * base
            lower = dict(zip(grams, prob, strict=True))
            levels.append(cls._level(grams, np.log(prob), names, np.log(weight)))
        return cls(langs, levels, floor)

    @staticmethod
    def _level(grams, logp, contexts, weight) -> Level:
        def hashed(strings):
            if not strings or strings == [""]:
                return np.zeros(len(strings), np.uint64)
            codes = np.array([[ord(c) for c in s] for s in strings], np.uint64)
            h = np.full(len(strings), codes.shape[1], np.uint64)
            for k in range(codes.shape[1]):
                h = (h ^ codes[:, k]) * _FACTOR
                h ^= h >> np.uint64(31)
            return h

        g, c = hashed(grams), hashed(contexts)
        a, b = np.argsort(g), np.argsort(c)
        return Level(g[a], logp[a].astype(np.float32), c[b], weight[b].astype(np.float32))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words x languages) of all characters of each word and the space after it."""
        codes, depth, starts = _codes(words)
        at, known = _find(self.levels[0].grams, _ngram_hashes(codes, 1))
        logp = np.where(known[:, None], self.levels[0].logp[at], (self.levels[0].weight[0] + self.floor)[None, :])
        for n in range(2, ORDER + 1):
            level, deep = self.levels[n - 1], depth >= n - 1
            rows = np.flatnonzero(deep)
            at, known = _find(level.grams, _ngram_hashes(codes, n)[rows])
            ctx = np.concatenate([np.zeros(1, np.uint64), _ngram_hashes(codes, n - 1)[:-1]])[rows]
            cat, cknown = _find(level.contexts, ctx)
            add = np.where(cknown[:, None], level.weight[cat], 0.0)
            logp[rows] = np.where(known[:, None], level.logp[at], logp[rows] + add)
        logp[starts] = 0.0
        return np.add.reduceat(logp, starts, axis=0)

    def cross_entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """For each text the nats per character by language, and its number of letters."""
        found = [words_of(t) for t in texts]
        if len(self._row) > CACHE_WORDS:
            self._row, self._table = {}, np.empty((0, len(self.langs)))
        need = list(set().union(*found).difference(self._row))
        if need:
            parts = [self.word_scores(need[i : i + 20_000]) for i in range(0, len(need), 20_000)]
            self._row.update(zip(need, range(len(self._table), len(self._table) + len(need)), strict=True))
            self._table = np.concatenate([self._table, *parts])
        letters = np.array([sum(map(len, w)) for w in found], np.int64)
        length = letters + np.array([len(w) for w in found], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        row = self._row.__getitem__
        for i, w in enumerate(found):
            if w:
                out[i] = self._table[np.fromiter(map(row, w), np.int64, len(w))].sum(0) / -length[i]
        return out, letters

    def predict(self, texts: list) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        h, letters = self.cross_entropies(texts)
        best = h.argmin(1)
        score = 1.0 / np.exp((h.min(1)[:, None] - h) * self.temperature).sum(1)
        low = h.min(1)
        return [
            (self.langs[b], float(s), float(x), bool(x > self.limit[b])) if n else (UNKNOWN, 0.0, None, True)
            for b, s, x, n in zip(best.tolist(), score.tolist(), low.tolist(), letters.tolist(), strict=True)
        ]

    def calibrate(self, h: np.ndarray, truth: np.ndarray) -> None:
        """``h`` (texts x languages), ``truth`` their languages' numbers.

        The temperature is the likeliest of a grid.  A text is rejected where
        its best model does clearly worse than on nearly all of the texts of its
        language: by ``SLACK`` beyond the ``QUANTILE`` of their cross-entropies,
        which a few garbled or mislabelled ones among them don't move.
        """
        if not len(h):
            return
        own = h[np.arange(len(h)), truth]
        grid = 2.0 ** np.arange(-1, 10)
        loss = [(np.log(np.exp((h.min(1)[:, None] - h) * t).sum(1)) + (own - h.min(1)) * t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        # a language without a text calibrated on goes by those of all
        self.limit = np.array([np.quantile(x if len(x := own[truth == i]) else own, QUANTILE) for i in range(h.shape[1])]) * SLACK


def held_out(doc_id: Column) -> Column:
    """Every fifth document by crc32 of its id as text; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Models:
    """Models from (doc_id, text, lang) of documents that aren't held out; ``train_docs`` of each language, about."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # a row for each language of the table, of which only those with the most documents are learned
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # documents are taken by a hash of their id, so the sample is the same whatever the partitions are
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1_000_000))
    share = F.floor(F.lit(1_000_000 * train_docs) / F.col("n")) + 1
    sample = labelled.join(sizes, "lang").where(draw < share).withColumn("test", F.pmod(F.xxhash64(F.lit(12), F.col("doc_id")), F.lit(10)) == 0)

    def count(batches):
        total: dict[str, Counter] = {}
        for batch in batches:
            for langs, texts in _side_by_side(batch, "lang", "text"):
                for lang, text in zip(langs, texts, strict=True):
                    total.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items()]
        if rows:
            lang, word, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    rows = sample.where("NOT test").select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    table = rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()  # words of the bounded sample
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(lang, {})[word] = n
    if not counts:
        return Models([], [], np.empty(0))
    models = Models.fit(counts)
    number = {lang: i for i, lang in enumerate(models.langs)}

    def measure(batches):
        for batch in batches:
            for langs, texts in _side_by_side(batch, "lang", "text"):
                h, letters = models.cross_entropies(texts)
                use = [i for i, n in enumerate(letters) if n and langs[i] in number]
                yield pa.RecordBatch.from_arrays([pa.array([number[langs[i]] for i in use], pa.int32()), pa.array(h[use].tolist(), pa.list_(pa.float64()))], ["truth", "h"])

    held = sample.where("test").select("lang", "text").mapInArrow(measure, "truth int, h array<double>").toArrow()
    if held.num_rows:
        models.calibrate(np.array(held.column("h").to_pylist()), np.array(held.column("truth").to_pylist(), np.int64))
    return models


def _side_by_side(batch, label: str, text: str):
    at = 0
    for texts in slices(batch.column(text)):
        yield batch.column(label).slice(at, len(texts)).to_pylist(), texts
        at += len(texts)


def identify(docs: DataFrame, models: Models, text: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``: struct of lang, score, cross_entropy, rejected."""

    @F.arrow_udf("struct<lang:string,score:double,cross_entropy:double,rejected:boolean>")
    def predict(column: pa.Array) -> pa.Array:
        rows = [r for part in slices(column) for r in models.predict(part)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        release()
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "score", "cross_entropy", "rejected"])

    return docs.withColumn(out, predict(F.col(text).cast("string")))


def keep_identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without those that no model of theirs accepts."""
    name = unique_name(docs, "_language")
    return identify(docs, train(docs, train_docs), out=name).where(~F.col(name).rejected).drop(name)
