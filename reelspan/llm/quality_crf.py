"""Quality scores by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are its own and those of the lines before
and after it; transition weights tie neighbours together. Forward-backward gives each line's
marginal probability of being good; their mean, weighted by length, is the document's score.

The field is fitted on the driver to a sample of labelled documents: the first `fit_documents` by a digest of
their doc_id, cut into chains of `chain_lines` lines, of which the first `fit_chains` by a digest are taken. So no text is too long for the fit, which
documents count has nothing to do with their size, and the driver holds fit_chains * chain_lines lines of 120 bytes at most (46 MB), and works on `cells` padded
ones at once. Only line features travel, those of the neighbours with them, as single-precision bytes; a document's label is that of each of its
lines. Rows whose crc32(doc_id) mod `folds` is 0 are held out and never read for fitting. Scores use the text only.

Defined results: a null or wordless text scores 0; without any usable label every other text scores
the prior 0.5; labels other than 0 and 1 are ignored, and of several labels of a doc_id the least
counts; repeated rows give repeated results; a null doc_id is not held out; a score of exactly `threshold` is
predicted 1; further columns are ignored, whatever their names; an empty table gives an empty result. Texts are
scored whole: a very long one takes memory in proportion to its lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>~^_=+@{}[]\\/"
SHOUTS = b"!?"
N_FEATURES = 10


@dataclass(frozen=True)
class FieldConfig:
    fit_documents: int = 2_500
    fit_chains: int = 1_500
    chain_lines: int = 256
    cells: int = 32_768
    folds: int = 5
    threshold: float = 0.3
    steps: int = 120
    rate: float = 0.15
    ridge: float = 1e-3


@dataclass
class Field:
    """Weights of the good state against the bad one: features (standardised), bias and the gain of staying in a state."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stay: np.ndarray  # bad to bad, good to good; a change of state has none


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, size = len(words), len(line)

    def share(chars: bytes) -> float:
        return (size - len(line.translate(None, chars))) / size

    return (
        log1p(n),
        share(UPPER),
        share(SYMBOLS),
        share(SHOUTS),
        share(DIGITS),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        min(size / n, 40.0) / 10,
        share(LETTERS),
        1.0 if seen else 0.0,
    )


def own_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and the lines' lengths."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, line in seen))
            sizes.append(len(line))
            seen.add(line)
    return np.array(rows, np.float64).reshape(len(rows), N_FEATURES), np.array(sizes, np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and those of the line after; zeros beyond either end."""
    edge = np.zeros((1, N_FEATURES))
    return np.hstack([own, np.vstack([edge, own[:-1]]) if len(own) else own, np.vstack([own[1:], edge]) if len(own) else own])


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(scores: np.ndarray, lengths: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and, for each text, the expected numbers of stays in bad and in good.

    scores: texts by lines, the good state's gain over the bad one, padded; lengths: lines of each text.
    """
    n, width = scores.shape
    rows = np.arange(n)
    fb, fg = np.empty_like(scores), np.empty_like(scores)  # forward, up to and with a line
    fb[:, 0], fg[:, 0] = 0.0, scores[:, 0]
    for t in range(1, width):
        b, g = fb[:, t - 1], fg[:, t - 1]
        fb[:, t] = _add(b + stay[0], g)
        fg[:, t] = _add(b, g + stay[1]) + scores[:, t]
    last = lengths - 1
    total = _add(fb[rows, last], fg[rows, last])
    good = np.zeros_like(scores)
    stays = np.zeros((n, 2))
    bb, bg = np.zeros(n), np.zeros(n)  # backward, after a line
    for t in range(width - 1, -1, -1):
        alive = t < lengths
        good[:, t] = np.where(alive, np.exp(np.minimum(fg[:, t] + bg - total, 0.0)), 0.0)
        if t:
            e = scores[:, t] + bg
            stays[:, 0] += np.where(alive, np.exp(np.minimum(fb[:, t - 1] + stay[0] + bb - total, 0.0)), 0.0)
            stays[:, 1] += np.where(alive, np.exp(np.minimum(fg[:, t - 1] + stay[1] + e - total, 0.0)), 0.0)
            bb, bg = np.where(alive, _add(bb + stay[0], e), 0.0), np.where(alive, _add(bb, e + stay[1]), 0.0)
    return good, stays


def _padded(values: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return out


def fit(features: list[np.ndarray], labels: np.ndarray, config: FieldConfig) -> Field:
    """The field of greatest penalised likelihood of the texts' labels, by Adam."""
    lengths = np.array([len(f) for f in features])
    order = np.argsort(lengths, kind="stable")
    features, labels, lengths = [features[i] for i in order], labels[order], lengths[order]
    n = lengths.sum()
    mean = sum(f.sum(axis=0, dtype=np.float64) for f in features) / n
    scale = np.sqrt(sum(((f - mean) ** 2).sum(axis=0) for f in features) / n) + 1e-6
    groups, a = [], 0
    while a < len(features):  # neighbours in length share a padded block of so many cells
        b = a + 1
        while b < len(features) and (b + 1 - a) * lengths[b] <= config.cells:
            b += 1
        groups.append(slice(a, b))
        a = b
    stacked = [np.vstack(features[g]) for g in groups]
    del features
    truth = [np.repeat(labels[g], lengths[g]) for g in groups]
    wanted = np.array([((lengths - 1) * (labels == s)).sum() for s in (0, 1)], float)

    theta = np.zeros(len(mean) + 3)  # weights, bias, stays
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, config.steps + 1):
        slope = np.zeros_like(theta)
        expected = np.zeros(2)
        for g, x, y in zip(groups, stacked, truth, strict=True):
            x = (x - mean) / scale
            s = x @ theta[:-3] + theta[-3]
            parts = np.split(s, np.cumsum(lengths[g])[:-1])
            good, stays = marginals(_padded(parts, lengths[g].max()), lengths[g], theta[-2:])
            p = np.concatenate([row[:n] for row, n in zip(good, lengths[g], strict=True)])
            slope[:-3] += x.T @ (p - y)
            slope[-3] += (p - y).sum()
            expected += stays.sum(axis=0)
        slope[-2:] = expected - wanted
        slope = slope / n + config.ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, theta[:-2], theta[-2:])


def scores(texts: list[bytes], field: Field | None, pad: int = 200_000) -> np.ndarray:
    """The score of each text; pad bounds the padded lines that are worked on at once."""
    out = np.zeros(len(texts))
    ready = [(i, *own_features(t)) for i, t in enumerate(texts)]
    ready = sorted((r for r in ready if len(r[2])), key=lambda r: len(r[2]))
    if field is None:
        out[[r[0] for r in ready]] = 0.5
        return out
    while ready:
        n = 1
        while n < min(256, len(ready)) and (n + 1) * len(ready[n][2]) <= pad:
            n += 1
        now, ready = ready[:n], ready[n:]
        lengths = np.array([len(r[2]) for r in now])
        lines = [(with_neighbours(r[1]) - field.mean) / field.scale @ field.weights[:-1] + field.weights[-1] for r in now]
        good, _ = marginals(_padded(lines, lengths.max()), lengths, field.stay)
        for row, (i, _, sizes) in zip(good, now, strict=True):
            out[i] = min(1.0, max(0.0, float(row[: len(sizes)] @ sizes / sizes.sum())))
    return out


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, config: FieldConfig = FieldConfig()) -> Field | None:
    """The field for labels (doc_id, quality) of docs (doc_id, text), or None without usable labels."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), config.folds))
    rank = F.xxhash64("doc_id")
    sample = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(rank, "doc_id").limit(config.fit_documents)
    sample = shared.written(sample, "labelled-sample")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, quality, text in zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), shared.byte_texts(batch.column("text")), strict=True):
            every = with_neighbours(own_features(text)[0]).astype(np.float32)
            rows += [(doc_id, quality, k, every[a : a + config.chain_lines].tobytes()) for k, a in enumerate(range(0, len(every), config.chain_lines))]
        ids, labels, chains, found = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(chains, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "quality", "chain", "features"])

    # the sample has fit_documents rows at most; of several texts of a doc_id the least counts
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("long"), "quality", "text")
    featured = shared.written(shared.arrow_map(rows, work, "doc_id long, quality int, chain long, features binary", rows=100), "sample-features")
    table = featured.orderBy(F.xxhash64("doc_id", "chain"), "doc_id", "chain").limit(config.fit_chains).select("quality", "features").toArrow()
    if not table.num_rows:
        return None
    features = [np.frombuffer(x.as_py(), np.float32).reshape(-1, 3 * N_FEATURES) for x in table["features"]]
    return fit(features, np.array(table["quality"].to_pylist(), float), config)


def scored(docs: DataFrame, field: Field | None, config: FieldConfig = FieldConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(shared.byte_texts(batch.column("text")), field)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    rows = shared.arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), config.folds).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))
