"""Language identification (operator 6): interpolated Kneser-Ney character models.

Each language gets an interpolated Kneser-Ney model of the characters of its
words (a context reaches back to the space before the word, ORDER - 1 characters
at most). All models lie in one set of hash arrays, sorted by n-gram hash, with a
column per language. A text's language is that of the lowest cross-entropy per
character; softmax of the negative cross-entropies at a temperature fitted on
calibration documents is the score.

A document is rejected where it has no letter, or where its lowest cross-entropy
is above that language's calibrated bound: the highest among the calibration
documents plus SLACK, and more for short texts.

The fit reads a sample of the labelled rows, about SAMPLE_DOCS whole documents a
language, a fifth of them for calibration; every document is scored whole.

Defined results: null text, or text without a letter, is `und` with score 0;
rows with a null doc_id are scored and never learned from; a table without any
labelled row gives `und` for all; further columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.llm.common import held, map_batches, mix, table

ORDER = 5
#: About so many labelled documents of each language are learned from (the bound of the fit's sample).
SAMPLE_DOCS = 500
#: Nats per character above the worst calibration document, and further slack that fades with length.
SLACK, SHORT_SLACK = 1.0, 12.0
UNKNOWN = "und"
#: Words that a worker remembers, and that it scores at once; longer ones aren't remembered, and scored in parts that carry their context.
WORDS, AT_ONCE, LONGEST = 300_000, 4096, 64

_START = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x2545F4914F6CDD1D)
_NOT_LETTER = re.compile(r"[\W\d_]+")


def cleaned(token: str) -> str:
    """The letters of a token in lower case, one space where others stood, and a space at either end; empty without letters."""
    inner = _NOT_LETTER.sub(" ", token.lower()).strip()
    if not inner.isascii() and not inner.replace(" ", "").isalpha():  # fractions, raised digits and number letters are no letters
        inner = " ".join("".join(c if c.isalpha() else " " for c in inner).split())
    return f" {inner} " if inner else ""


def gram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 0 to order characters before and at each character, those that reach over a word's start as 0; owner and validity of each character.

    Element n of the list holds, for each character, the hash of the n characters that end with it.
    """
    text = "".join(words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(cp)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # characters before it in its word
    out = [np.full(len(cp), _START)]
    for n in range(1, order + 1):
        before = np.empty_like(out[-1])
        before[:1], before[1:] = _START, out[-1][:-1]
        h = mix((before if n > 1 else out[0]) * _STEP + cp)
        h[depth < n - 1] = 0
        out.append(h)
    return out, owner, depth


class Models:
    """All languages' models: for each order, sorted hashes of n-grams with a column per language of what they add and of what they pass on as a context."""

    def __init__(self, langs: list[str], base: float, grams: list, contexts: list):
        self.langs, self.base = langs, base
        self.order, empty = len(grams), np.ones((1, len(langs)))
        # the weight of the lowest order's base
        self.first = contexts[0][1] if len(contexts[0][0]) else empty
        self.tables = [self._joined(grams[n - 1], contexts[n] if n < self.order else (np.zeros(0, np.uint64), empty[:0])) for n in range(1, self.order + 1)]
        self.temperature, self.bound = 1.0, np.full(len(langs), np.inf)

    def _joined(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and for each its probabilities and its weights as a context; a last row for what isn't there."""
        k = len(self.langs)
        keys = np.union1d(grams[0], contexts[0]).astype(np.uint64)
        values = np.concatenate([np.zeros((len(keys) + 1, k)), np.ones((len(keys) + 1, k))], axis=1)
        values[np.searchsorted(keys, grams[0]), :k] = grams[1]
        values[np.searchsorted(keys, contexts[0]), k:] = contexts[1]
        return keys, values

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return values[np.zeros(len(wanted), np.int64)]
        at = np.searchsorted(keys, wanted)
        at[keys[np.minimum(at, len(keys) - 1)] != wanted] = len(keys)
        return values[at]

    def log_probabilities(self, words: list[str], first: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Each cleaned word's summed log probability by language, and its number of predicted characters: those from first on."""
        k = len(self.langs)
        sums, n = np.zeros((len(words), k), dtype=np.float32), np.zeros(len(words), dtype=np.int32)
        if not any(words):
            return sums, n
        hashes, owner, depth = gram_hashes(words, self.order)
        p = np.full((len(owner), k), self.base)
        weight = np.broadcast_to(self.first, p.shape)
        for order in range(1, self.order + 1):
            # grams that reach over a word's start have hash 0, aren't found, and leave p and the weight as they are
            found = self.find(*self.tables[order - 1], hashes[order])
            p = found[:, :k] + weight * p
            weight = np.ones_like(p)
            weight[1:] = found[:-1, k:]
        told = depth >= first
        logs = np.log(p[told])
        for lang in range(k):
            sums[:, lang] = np.bincount(owner[told], weights=logs[:, lang], minlength=len(words))
        n[:] = np.bincount(owner[told], minlength=len(words))
        return sums, n


def kneser_ney(counts: dict[str, dict[str, int]], order: int = ORDER) -> Models:
    """Models from each language's counts of n-grams of 1 to order characters."""
    langs = sorted(counts)
    letters = {g for c in counts.values() for g in c if len(g) == 1}
    rows: list[dict[str, list[float]]] = [{} for _ in range(order)]
    backs: list[dict[str, list[float]]] = [{} for _ in range(order)]
    for k, lang in enumerate(langs):
        own = counts[lang]
        left: Counter = Counter(g[1:] for g in own if len(g) > 1)  # in how many ways each gram continues one
        for n in range(1, order + 1):
            # the highest order and those that begin a word have counts, the others continuation counts
            c = {g: (v if n == order or g[0] == " " and n > 1 else left.get(g, 0)) for g, v in own.items() if len(g) == n}
            c = {g: v for g, v in c.items() if v}
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = once / (once + 2 * twice) if once else 0.5
            total, kinds = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            for g, v in c.items():
                rows[n - 1].setdefault(g, [0.0] * len(langs))[k] = max(v - d, 0.0) / total[g[:-1]]
            for ctx, v in total.items():
                backs[n - 1].setdefault(ctx, [1.0] * len(langs))[k] = d * kinds[ctx] / v

    def arrays(found: dict[str, list[float]], n: int) -> tuple[np.ndarray, np.ndarray]:
        names = list(found)
        if n == 0:
            h = np.full(len(names), _START)
        else:
            h = gram_hashes(names, n)[0][n][n - 1 :: n] if names else np.zeros(0, dtype=np.uint64)
        at = np.argsort(h)
        return h[at], np.array([found[names[i]] for i in at], dtype=np.float64).reshape(len(names), len(langs))

    return Models(langs, 1.0 / (len(letters) + 1), [arrays(rows[n], n + 1) for n in range(order)], [arrays(backs[n], n) for n in range(order)])


def parts(word: str, order: int, longest: int = LONGEST) -> tuple[str, list[str]]:
    """A cleaned word's beginning, and the parts that follow, each behind the order - 1 characters before it."""
    return word[:longest], [word[max(0, at - order + 1) : at + longest] for at in range(longest, len(word), longest)]


class Scorer:
    """Sums word scores of whole texts; remembers the words it has seen."""

    def __init__(self, models: Models):
        self.models, self.memo = models, {}
        self.sums, self.n = np.zeros((0, len(models.langs)), dtype=np.float32), np.zeros(0, dtype=np.int32)

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by language, and the number of characters (0 without letters)."""
        split = [x.split() for x in texts]
        long = {k: [w for w in x if len(w) > LONGEST] for k, x in enumerate(split) if max(map(len, x), default=0) > LONGEST}
        for k in long:
            split[k] = [w for w in split[k] if len(w) <= LONGEST]
        if len(self.memo) > WORDS:
            self.__init__(self.models)
        new = list({w for x in split for w in x}.difference(self.memo))
        if new:
            scored = [self.models.log_probabilities([cleaned(w) for w in new[i : i + AT_ONCE]]) for i in range(0, len(new), AT_ONCE)]
            self.memo.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
            self.sums, self.n = np.concatenate([self.sums, *(s for s, _ in scored)]), np.concatenate([self.n, *(n for _, n in scored)])
        total, n = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), dtype=np.int64)
        for k, x in enumerate(split):
            at = np.fromiter(map(self.memo.__getitem__, x), np.int64, len(x))
            total[k], n[k] = self.sums[at].sum(axis=0, dtype=np.float64), self.n[at].sum()
        for k, words in long.items():
            for sums, count in map(self.scored_whole, words):
                total[k] += sums
                n[k] += count
        return -total / np.maximum(n, 1)[:, None], n

    def scored_whole(self, word: str) -> tuple[np.ndarray, int]:
        """The summed log probabilities and characters of a long word, by parts."""
        order = self.models.order
        head, tail = parts(cleaned(word), order)
        total, n = np.zeros(len(self.models.langs)), 0
        for words, first in ([head], 1), (tail, order - 1):
            for i in range(0, len(words), AT_ONCE):
                sums, counts = self.models.log_probabilities(words[i : i + AT_ONCE], first)
                total, n = total + sums.sum(axis=0, dtype=np.float64), n + int(counts.sum())
        return total, n


def count_grams(labelled: DataFrame, order: int = ORDER) -> dict[str, dict[str, int]]:
    """Counts of character n-grams by language; small, since the sample is bounded."""

    def run(batch: pa.RecordBatch):
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(map(cleaned, text.split()))
        for lang, words in by_lang.items():
            grams: Counter = Counter()
            for w, c in words.items():
                for i in range(1, len(w)):
                    for n in range(1, min(order, i + 1) + 1):
                        grams[w[i - n + 1 : i + 1]] += c
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counted = map_batches(labelled.select("text", "lang"), run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, dict[str, int]] = {}
    for row in counted.toLocalIterator():
        found.setdefault(row["lang"], {})[row["gram"]] = row["n"]
    return found


def held_out() -> F.Column:
    """Whether crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """About per_language labelled documents of each language, by a hash of id and text; part 0 of 5 is for calibration."""
    learn = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[x for lang, k in n.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / k)))]) if n else F.create_map(F.lit(""), F.lit(0.0))
    h = F.xxhash64("doc_id", "text")
    return learn.filter(F.pmod(h, F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003).select("text", "lang", F.pmod(F.shiftright(h, 24), F.lit(5)).alias("part"))


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS, order: int = ORDER) -> Models | None:
    """Models, temperature and bounds of rejection; None without a labelled row."""
    rows = sampled(docs, per_language)
    counts = count_grams(rows.filter("part > 0"), order) or count_grams(rows, order)
    counts = {lang: c for lang, c in counts.items() if c}
    if not counts:
        return None
    models = kneser_ney(counts, order)
    known = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, n = Scorer(known.value).cross_entropies(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(x), pa.list_(pa.float64())), pa.array(n)], ["lang", "x", "n"])

    tried = [r for r in map_batches(rows.filter("part = 0").select("text", "lang"), run, "lang string, x array<double>, n long").collect() if r["n"]]
    if tried:
        x, n = np.array([r["x"] for r in tried]), np.array([r["n"] for r in tried])
        truth = np.array([models.langs.index(r["lang"]) if r["lang"] in models.langs else -1 for r in tried])
        ok = truth >= 0
        losses = []
        for t in (grid := np.geomspace(0.02, 2.0, 25)):
            p = softmax(-x[ok] / t)
            losses.append(-np.log(np.maximum(p[np.arange(ok.sum()), truth[ok]], 1e-9)).mean() if ok.any() else 0.0)
        models.temperature = float(grid[int(np.argmin(losses))])
        for k in range(len(models.langs)):
            mine = ok & (truth == k) & (x.argmin(axis=1) == k)
            if mine.any():
                models.bound[k] = (x[mine, k] - SHORT_SLACK / np.sqrt(n[mine])).max() + SLACK
    return models


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected added (those of the same names are replaced)."""
    names = ("lang_pred", "score", "cross_entropy", "rejected")
    docs = docs.drop(*names)
    if models is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    known = docs.sparkSession.sparkContext.broadcast(models)
    key = uuid.uuid4().hex  # tells these models from others of a reused worker
    schema = T.StructType([f for f in docs.schema])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = held(("language", key), lambda: Scorer(known.value))
        m, texts = known.value, [x or "" for x in batch.column("text").to_pylist()]
        parts = [scorer.cross_entropies(texts[i : i + 512]) for i in range(0, len(texts), 512)]
        x, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        best, has = x.argmin(axis=1), n > 0
        score = np.where(has, softmax(-x / m.temperature).max(axis=1), 0.0)
        low = x[np.arange(len(x)), best]
        rejected = ~has | (low - SHORT_SLACK / np.sqrt(np.maximum(n, 1)) > m.bound[best])
        pred = [m.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        added = [pa.array(pred, pa.string()), pa.array(score), pa.array(low, mask=~has), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    for name, kind in zip(names, ("string", "double", "double", "boolean"), strict=True):
        schema.add(name, kind)
    return map_batches(docs, run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
