"""Quality classifier from weak labels (operator 7).

Heuristic labellers vote good, bad or abstain on every document. Expectation-
maximisation over the counts of vote patterns of all documents (bounded by the
number of patterns) estimates how each labeller votes on good and on bad
documents, with no label used. A pattern's posterior then labels the documents of
a bounded sample (SAMPLE_DOCS), on which a hashed linear scorer is fitted:
logistic regression on the mean of hashed token features. The scorer, which a
worker applies through a memo of tokens, grades every whole document.

Defined results: null text, or text without a token, has score 0 and isn't kept;
a table in which all votes agree keeps what the labellers call good; repeated rows
each give their row; further columns are left alone.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import Memo, held, map_batches, stored, table

#: The scorer is fitted on about so many documents (the bound of its sample), in so many hashed features.
SAMPLE_DOCS, FEATURES = 8_000, 1 << 15
STEPS, RATE, DECAY = 150, 4.0, 1e-4
ROUNDS = 60
KEEP = 0.5

GOOD, BAD, ABSTAIN = 1, 0, 2
_SYMBOL = re.compile(r"[^\w\s.,;:'\"?!()\-‘’“”«»¿¡–—…]|[!?]{2,}|_")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]")


def band(value: float, good: float, bad: float) -> int:
    """A vote on a share that is good when low."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def votes(text: str) -> tuple[int, ...]:
    """Each labeller's vote on a text."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return (BAD,) * len(LABELLERS)
    chars = sum(map(len, tokens))
    letters = max(1, len(re.findall(r"[^\W\d_]", text)))
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = len(set(tokens))
    longest = max(map(len, tokens))
    repeats = n - kinds if n < 20 else sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    marked = sum(t[-1] in ".!?…:;\"'”»)" for t in (x.rstrip() for x in lines))
    return (
        band(len(_SYMBOL.findall(text)) / chars, 0.02, 0.08),
        band(len(_UPPER.findall(text)) / letters, 0.15, 0.4),
        ABSTAIN if n < 20 else band(1 - kinds / n**0.85, 0.45, 0.8),
        ABSTAIN if n < 20 else band(repeats / n, 0.05, 0.25),
        ABSTAIN if len(lines) < 4 else band(1 - len(set(lines)) / len(lines), 0.2, 0.5),
        GOOD if 2.5 <= chars / n <= 11 else BAD,
        band(sum(t[-1] in "%&$#*|!" for t in tokens) / n, 0.03, 0.2),
        GOOD if marked >= 0.7 * len(lines) else BAD if marked < 0.2 * len(lines) else ABSTAIN,
        ABSTAIN if longest < 60 else BAD,
    )


#: What the labellers look at, in the order of their votes.
LABELLERS = ("symbols", "capitals", "vocabulary", "repeated_tokens", "repeated_lines", "token_length", "noisy_endings", "punctuated_lines", "giant_tokens")


def with_votes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and votes (an integer of base 3) of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [sum(v * 3**k for k, v in enumerate(votes(t.as_py() or ""))) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(codes, pa.int64())], ["doc_id", "text_hash", "votes"])

    return map_batches(hashed(docs), run, "doc_id long, text_hash long, votes long")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def label_model(patterns: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Each pattern's posterior of being good, by expectation-maximisation over pattern counts."""
    if not patterns:
        return {}
    codes = np.array(list(patterns))
    weight = np.array(list(patterns.values()), dtype=float)
    cast = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good, bad = (cast == GOOD).sum(axis=1), (cast == BAD).sum(axis=1)
    p = (good + 1.0) / (good + bad + 2.0)  # majority vote to begin with
    shown = np.eye(3)[cast][:, :, :2]  # pattern, labeller, vote; that one abstains tells nothing
    for _ in range(rounds):
        prior = np.clip((weight * p).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        logs = []
        for mass, q in ((weight * p, prior), (weight * (1 - p), 1 - prior)):
            rates = np.einsum("i,ijk->jk", mass, shown) + 1.0
            rates /= rates.sum(axis=1, keepdims=True)
            logs.append(np.log(q) + np.einsum("ijk,jk->i", shown, np.log(rates)))
        z = np.clip(logs[0] - logs[1], -30, 30)
        p = 1 / (1 + np.exp(-z))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


_RUNS = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]|_")


def features(token: str) -> list[int]:
    """Hashed features of a token: its shape, its symbols, and its lower-cased self."""
    shape = []
    for run in _RUNS.findall(token):
        c = run[0]
        kind = ("A" if run.isupper() and len(run) > 1 else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    names = [f"s{''.join(shape)[:12]}", f"l{min(len(token), 30) // 3}", f"w{token.lower()}", *(f"c{c}" for c in set(shape) if c not in "Aa0")]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


def vector(tokens: list[str], memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Features of a document and their shares of its tokens, with one for repetition."""
    found = [f for t in tokens for f in memo[t]]
    rows, n = np.unique(np.array(found, dtype=np.int32), return_counts=True)
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens)
    return np.append(rows, FEATURES).astype(np.int32), np.append(n / len(tokens), again).astype(np.float32)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a logistic regression on soft targets, both classes weighing the same."""
    w = np.zeros(FEATURES + 2)
    if not rows:
        return w
    owner = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
    columns, values = np.concatenate([r for r, _ in rows]), np.concatenate([v for _, v in rows]).astype(float)
    share = np.clip(target.mean(), 0.02, 0.98)
    weight = target / share + (1 - target) / (1 - share)
    weight /= weight.sum()
    squares = np.full(FEATURES + 2, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(owner, weights=values * w[columns], minlength=len(rows)) + w[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        step = np.bincount(columns, weights=values * slope[owner], minlength=FEATURES + 2) + DECAY * w
        step[-1] = slope.sum()
        squares += step**2
        w -= RATE / 10 * step / np.sqrt(squares)
    return w


def fit(docs: DataFrame, voted: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[dict[int, float], np.ndarray]:
    """The label model over all documents, and the scorer fitted on a sample of them."""
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** labellers
    posterior = label_model(counts)
    total = sum(counts.values())
    share = min(1.0, sample / max(1, total))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_003)) < F.lit(int(1_000_003 * share) + 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, out = Memo(features, 100_000), []
        for text in batch.column("text"):
            tokens = (text.as_py() or "").split()
            if tokens:
                out.append((sum(v * 3**k for k, v in enumerate(votes(text.as_py()))), *vector(tokens, memo)))
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["votes", "rows", "shares"])

    got = map_batches(some.select("text"), run, "votes long, rows array<int>, shares array<float>").toArrow()
    rows = [(r.values.to_numpy(), v.values.to_numpy()) for r, v in zip(got.column("rows").combine_chunks(), got.column("shares").combine_chunks(), strict=True)] if got.num_rows else []
    target = np.array([posterior.get(v, 0.5) for v in got.column("votes").to_pylist()])
    return posterior, fit_scorer(rows, target)


class Grader:
    """Scores whole texts; remembers each token's summed weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.memo = Memo(lambda token: float(sum(self.weights[f] for f in features(token))), 400_000)

    def score(self, text: str) -> float:
        tokens = text.split()
        if not tokens:
            return 0.0
        again = sum(map(str.__eq__, tokens, tokens[1:])) / len(tokens)
        z = sum(map(self.memo.__getitem__, tokens)) / len(tokens) + again * self.weights[FEATURES] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def graded(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, weak_label (the label model's posterior), score and kept of every document."""
    spark = docs.sparkSession
    voted = stored(with_votes(docs))
    posterior, weights = fit(docs, voted)
    shared = spark.sparkContext.broadcast(weights)
    mark = uuid.uuid4().hex  # tells this fit from others of a reused worker

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grader = held(("quality", mark), lambda: Grader(shared.value))
        texts = [t.as_py() or "" for t in batch.column("text")]
        scores = np.fromiter(map(grader.score, texts), np.float64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(scores), pa.array(scores >= keep)], ["doc_id", "text_hash", "score", "kept"])

    scored = map_batches(hashed(docs), run, "doc_id long, text_hash long, score double, kept boolean")
    # a document's votes aren't cast again: equal rows have equal ones
    once = voted.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.max("votes").alias("votes"))
    weak = F.broadcast(spark.createDataFrame(list(posterior.items()), "votes long, weak_label double"))  # at most 3 ** labellers rows
    out = scored.join(once, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).join(weak, "votes")
    return out.select("doc_id", "votes", "weak_label", "score", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(table(spark, sf_dir, "documents"))
