"""Language identification: nearest of several clustered centroids for each language.

A text is a vector of hashed byte 2-, 3- and 4-gram counts, damped, weighted by inverse document
frequency and normalised. Document frequencies cover all training rows; centroids are fitted by
spherical k-means on a bounded sample of each language's training rows. A text goes to the
language of the centroid with the largest cosine, and is rejected if even that is too far: farther
than the fitted rows of its size are, as short texts lie far from every centroid and long ones near.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.memory import released
from quadrat.runtime import ship

DIMENSIONS = 4096
GRAMS = (2, 3, 4)
#: Training rows of each language that the centroids are fitted on, at most.
SAMPLE = 400
CLUSTERS = 3
#: Cosine distance to the nearest centroid beyond which a text of any size is rejected.
MAX_DISTANCE = 0.95
#: What a text may be farther than the farthest fitted row of its size (see `limits`).
MARGIN = 0.15
#: Fitted rows that a size needs to have a limit of its own.
LEAST = 20
SEED = 17
UNKNOWN = "und"
#: Texts that are compared with the centroids at a time.
ROWS = 256
#: Bytes of a text that are counted at a time.
CHUNK = 1 << 20

# ASCII capitals to small letters, what isn't a letter to a space; other bytes as they are.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text leaves 0 when divided by 5 (null: it isn't)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def counts(text: str) -> np.ndarray:
    """Counts of the text's hashed n-grams, spaces folded to one."""
    folded = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(folded), CHUNK):
        b = np.frombuffer(folded[at : at + CHUNK + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        code = b.copy()
        for n in range(2, max(GRAMS) + 1):
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(0x01000193) ^ b[n - 1 :]
            if n in GRAMS:
                last = min(CHUNK, len(code))
                mixed = code[:last] * np.uint32(0x9E3779B1)
                out += np.bincount(mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: The distance beyond which a text is rejected, by its size.
    limits: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.empty((len(texts), DIMENSIONS), np.float32)
        for row, text in zip(x, texts, strict=True):
            weighed = np.log1p(counts(text)) * self.idf
            row[:] = weighed / max(np.linalg.norm(weighed), 1e-12)
        return x

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text; score is the cosine of the nearest centroid."""
        known = np.array([has_letter(t) for t in texts], bool)
        names, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~known
        if self.languages and known.any():
            at = np.flatnonzero(known)
            x = self.vectors([texts[i] for i in at])
            cosine = x @ self.centroids.T
            best = cosine.argmax(1)
            score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
            rejected[at] = 1 - score[at] > self.limits[sizes(x)]
            for i, o in zip(at, self.owner[best], strict=True):
                names[i] = self.languages[o]
        return names, score, rejected


def sizes(x: np.ndarray) -> np.ndarray:
    """The size of each vector's text: the bit length of the number of buckets it has n-grams in."""
    return np.frexp(np.count_nonzero(x, 1))[1]


def limits(size: np.ndarray, distance: np.ndarray, margin: float = MARGIN, max_distance: float = MAX_DISTANCE) -> np.ndarray:
    """The rejection distance of every size, falling with it, from fitted rows' sizes and distances.

    It is `margin` more than the largest distance of the rows of this size or a larger one, and
    never more than max_distance. Sizes of fewer than LEAST rows take the next smaller one's;
    the smallest, with none before them, max_distance.
    """
    out, last = np.empty(DIMENSIONS.bit_length() + 1), max_distance
    for s in range(len(out)):
        if (size == s).sum() >= LEAST:
            last = min(max_distance, distance[size >= s].max() + margin)
        out[s] = last
    return out


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from farthest-first beginnings; unit centroids, without empty ones."""
    rng = np.random.default_rng(seed)
    centroids = x[[rng.integers(len(x))]]
    while len(centroids) < min(k, len(x)):
        centroids = np.concatenate([centroids, x[[(x @ centroids.T).max(1).argmin()]]])
    for _ in range(rounds):
        who = (x @ centroids.T).argmax(1)
        sums = np.stack([x[who == j].sum(0) for j in range(len(centroids)) if (who == j).any()])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if new.shape == centroids.shape and np.allclose(new, centroids):
            break
        centroids = new
    return centroids


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, seed: int = SEED, margin: float = MARGIN, max_distance: float = MAX_DISTANCE) -> Model:
    """Fit on the rows of train (doc_id, text, lang) with a text and a language.

    Document frequencies are counted over all of them. The centroids are fitted on at most
    `sample` distinct rows of each language, those with the smallest seeded hashes of doc_id and
    text; their vectors, not their texts, go to the driver. Rejection distances come from the
    same rows (`limits`). Without such rows
    the model knows no language: it predicts `und` and rejects only texts without letters.
    """
    spark = train.sparkSession
    ship(spark)
    rows = train.select("doc_id", "text", "lang").filter("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts(text) > 0
                n += 1
        used = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": pa.array(np.append(used, -1).astype(np.int32)), "n": pa.array(np.append(seen[used], n))})

    # One row for each bucket, whatever the input.
    df = rows.select("text").mapInArrow(released(frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = {r["bucket"]: r["n"] for r in df}
    total = frequency.pop(-1, 0)
    idf = np.full(DIMENSIONS, np.log(1 + total) + 1.0)
    for bucket, n in frequency.items():
        idf[bucket] = np.log((1 + total) / (1 + n)) + 1
    of_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    none = np.zeros(0, np.int64)
    model = Model(sorted(of_lang), idf, np.zeros((0, DIMENSIONS), np.float32), none, limits(none, none, margin, max_distance))
    if not of_lang:
        return model
    # About one and a half times the sample by hash, equal rows once, then exactly the smallest hashes.
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / float(1 << 53)
    share = F.create_map(*[F.lit(x) for lang in model.languages for x in (lang, min(1.0, (1.5 * sample + 50) / of_lang[lang]))])
    picked = rows.withColumn("u", unit).filter(F.col("u") <= share[F.col("lang")])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                part = part.filter(pa.array([has_letter(t) for t in part.column(2).to_pylist()], pa.bool_()))
                x = model.vectors(part.column(2).to_pylist())
                used = [np.flatnonzero(r).astype("<u2") for r in x]
                values = [r[u].astype("<f4").tobytes() for r, u in zip(x, used, strict=True)]
                yield pa.record_batch({"lang": part.column(0), "u": part.column(1), "at": pa.array([u.tobytes() for u in used], pa.binary()), "x": pa.array(values, pa.binary())})

    picked = picked.select("lang", "u", "text").mapInArrow(released(sparse), "lang string, u double, at binary, x binary")
    found: dict[str, list] = {}
    for r in picked.dropDuplicates(["lang", "u"]).collect():  # about 1.5 samples a language, a vector each
        found.setdefault(r["lang"], []).append(r)
    centroids, owner, size, distance = [], [], [], []
    for lang in sorted(found):
        rows_of = sorted(found[lang], key=lambda r: (r["u"], r["at"], r["x"]))[:sample]
        x = np.zeros((len(rows_of), DIMENSIONS), np.float32)
        for row, r in zip(x, rows_of, strict=True):
            row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f4")
        nearest = kmeans(x, clusters, seed)
        centroids.append(nearest)
        owner += [model.languages.index(lang)] * len(nearest)
        size.append(sizes(x))
        distance.append(1 - (x @ nearest.T).max(1))
    if centroids:
        model.centroids, model.owner = np.concatenate(centroids).astype(np.float32), np.array(owner)
        model.limits = limits(np.concatenate(size), np.concatenate(distance), margin, max_distance)
    else:
        model.languages = []
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row's whole text.

    docs needs doc_id and text. lang_pred is `und`, score 0 and rejected true if the text is
    null or has no letter; otherwise lang_pred is the nearest language and rejected tells
    whether it is farther than the model's limit for texts of its size. Rows stay as they are.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, score, rejected = model.predict(part.column(1).to_pylist())
                yield pa.record_batch({"doc_id": part.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "rejected": pa.array(rejected)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: fitted on the rows that aren't held out."""
    model = fit(docs.filter(~held_out()), **how)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose text isn't rejected, with all their columns."""
    spark = docs.sparkSession
    model = fit(docs.filter(~held_out()), **how)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(~model.predict(part.column("text").to_pylist())[2]))

    return docs.mapInArrow(released(run), docs.schema)
