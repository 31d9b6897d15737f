"""Quality scores by a factorisation machine.

A text's features are its hashed words, statistics of its structure, and metadata. The machine
adds a weight for each feature and a low-rank interaction for each pair of them, which the
identity 2 * sum of pairs = square of the sum - sum of the squares scores in linear time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.language import held_out
from quadrat.llm.memory import released
from quadrat.runtime import materialize, ship

WORDS = 2048
STATISTICS = 22
RANK = 8
#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 8000
EPOCHS = 30
SEED = 23
THRESHOLD = 0.3
CACHE = 300_000

_MARKS = re.compile(r"[^\w\s]")
_RUN = re.compile(r"([^\w\s])\1")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


class Features:
    """Counts of hashed words, and the statistics, of texts; keeps the hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[word] = zlib.crc32(word.lower().encode()) % WORDS
        return got

    def row(self, text: str | None, n_chars: float | None) -> np.ndarray:
        """Word part (damped, unit length) and statistics; a null text is an empty one."""
        text = text or ""
        words = text.split()
        out = np.zeros(WORDS + STATISTICS, np.float32)
        n, size = len(words), len(text)
        if n:
            got = np.log1p(np.bincount([self.bucket(w) for w in words], minlength=WORDS))
            out[:WORDS] = got / np.linalg.norm(got)
        distinct = len(set(words))
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        lines = text.split("\n")
        marks, upper = len(_MARKS.findall(text)), len(_UPPER.findall(text))
        per_word = lambda x: x / max(n, 1)
        per_char = lambda x: x / max(size, 1)
        stats = [
            1.0,
            np.log1p(n) / 8,
            np.log1p(size) / 10,
            distinct / max(n, 1),
            per_word(again),
            per_char(marks) * 4,
            per_char(upper) * 2,
            per_char(len(_DIGIT.findall(text))) * 4,
            per_word(len(_RUN.findall(text))),
            per_word(len(_SENTENCE.findall(text))) * 4,
            per_word(text.count(",")) * 4,
            per_word(text.count("|")) * 2,
            per_word(text.count("!")) * 2,
            per_word(sum(map(text.count, "#$%&*@^~"))),
            per_word(sum(map(text.count, "<>{}[]=\\/_"))),
            np.log1p(len(lines)) / 6,
            len(set(lines)) / len(lines),
            np.log1p(size / len(lines)) / 8,
            per_word(size) / 10,
            max(map(len, words), default=0) ** 0.5 / 10,
            float(n == 0),
            # Metadata: the length that the table says, against the text's.
            float(n_chars is not None and n_chars != size),
        ]
        out[WORDS:] = np.clip(stats, -4, 4)
        return out


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(1) / 2
        return self.bias + x @ self.weights + pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit_machine(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Adagrad on the logistic loss, in seeded batches."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(x.shape[1]), rng.normal(0, 0.02, (x.shape[1], rank)))
    if not len(x):
        return m
    rate_mean = np.clip(y.mean(), 0.01, 0.99)
    m.bias = float(np.log(rate_mean / (1 - rate_mean)))
    if y.min() == y.max():
        return m
    g_bias, g_w, g_v = 1e-8, np.full(len(m.weights), 1e-8), np.full(m.factors.shape, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            xb = x[order[at : at + 128]].astype(np.float64)
            error = (m.scores(xb) - y[order[at : at + 128]]) / len(xb)
            sums = xb @ m.factors
            d_w = xb.T @ error + decay * m.weights
            d_v = xb.T @ (error[:, None] * sums) - m.factors * ((xb**2).T @ error)[:, None] + decay * m.factors
            g_bias += error.sum() ** 2
            g_w += d_w**2
            g_v += d_v**2
            m.bias -= rate * error.sum() / np.sqrt(g_bias)
            m.weights -= rate * d_w / np.sqrt(g_w)
            m.factors -= rate * d_v / np.sqrt(g_v)
    return m


def _inputs(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, **how) -> Machine:
    """Fit on documents that have a label 0 or 1 and aren't held out.

    At most `sample` labelled rows are used, those with the smallest seeded hashes: they are
    few enough to be sent to all executors, which compute their features where the texts are.
    Of a doc_id with several labels each distinct one counts. Where a doc_id has many rows, the
    rows that enter the fit are bounded by `sample` too, in the order of these hashes. Without
    labels all scores are alike.
    """
    ship(docs.sparkSession)
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    picked = picked.filter(~held_out()).distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "quality").limit(sample)
    joined = _inputs(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "n_chars", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features.row(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            used = [np.flatnonzero(r) for r in rows]
            yield pa.record_batch({
                "doc_id": batch.column(0),
                "quality": batch.column(3),
                "at": pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                "x": pa.array([r[u].astype("<f4").tobytes() for r, u in zip(rows, used, strict=True)], pa.binary()),
            })

    found = joined.mapInArrow(released(run), "doc_id long, quality int, at binary, x binary")
    # Limited where it is computed: the driver gets `sample` rows at most.
    found = materialize(found.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "quality", "at", "x").limit(sample), "quality-rows")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["quality"], r["at"], r["x"]))
    x = np.zeros((len(rows), WORDS + STATISTICS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f4")
    return fit_machine(x, np.array([r["quality"] for r in rows], np.float64), seed=seed, **how)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every row's whole text.

    docs needs doc_id and text, n_chars may be there; other columns aren't looked at. A null
    text is scored as an empty one. Rows stay as they are.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.stack([features.row(t, c) for t, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)])
                got = machine.scores(x)
                yield pa.record_batch({"doc_id": part.column(0), "score": pa.array(got), "predicted": pa.array((got >= threshold).astype(np.int32))})

    return _inputs(docs).mapInArrow(released(run), "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on labelled rows that aren't held out."""
    return score(docs, fit(docs, labels, **how)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
