"""Document quality by Bradley-Terry ranking: from pairs of a preferred and a rejected document, learn weights w such
that sigmoid(w . (x_good - x_bad)) is likely, then place the threshold at a quantile of the scores."""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "spaces", "non_ascii", "stops", "commas", "marks", "symbols", "bars", "other",
    "word_ends", "distinct_words", "log_lines", "line_words", "repeated_lines", "closed_lines", "entropy", "longest_word",
)

_GROUPS = {"stops": b".", "commas": b",;:", "marks": b"!?", "symbols": b"#$%&*<>@^~\\", "bars": b"|/_=+", "digits": b"0123456789", "spaces": b" \t\n\r\x0b\x0c"}
_CODES = {k: np.frombuffer(v, np.uint8) for k, v in _GROUPS.items()}
_END = re.compile(rb"[!#$%&*<>@^~|]+(?=\s|$)")


def features(text: str | None) -> list[float]:
    """Form of a text, none of its words: lengths, shares of kinds of characters, repetition. Zeros for null and empty."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    share = {k: counts[c].sum() / n for k, c in _CODES.items()}
    share["upper"], share["non_ascii"], lower = counts[65:91].sum() / n, counts[128:].sum() / n, counts[97:123].sum() / n
    p = counts[counts > 0] / n
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    x = {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "word_length": min(40.0, lengths.mean()), "word_spread": min(40.0, lengths.std()),
        "other": max(0.0, 1 - lower - sum(share.values())), "word_ends": len(_END.findall(data)) / k, "distinct_words": len(set(words)) / k,
        "log_lines": math.log1p(len(lines)), "line_words": math.log1p(len(words) / max(1, len(lines))), "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "closed_lines": sum(y.rstrip()[-1:] in b".!?" for y in lines) / max(1, len(lines)), "entropy": float(-(p * np.log2(p)).sum()), "longest_word": math.log1p(lengths.max()),
    }
    x |= share
    return [float(x[f]) for f in FEATURES]


class BradleyTerry:
    """score(x) = sigmoid(w . (x - mean) / spread - threshold)."""

    def __init__(self, mean, spread, weights, threshold):
        self.mean, self.spread, self.weights, self.threshold = mean, spread, weights, threshold

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, rounds: int = 25, seed: int = 7) -> BradleyTerry:
    """Newton's method on the logistic loss of `pairs` random pairs (good, bad).

    The threshold is the quantile of the scores at the share of bad documents. Only one label, or no rows: every
    document gets the score of the label there is (1 for good or no rows at all).
    """
    d = x.shape[1]
    if good.all() or not good.any():
        return BradleyTerry(np.zeros(d), np.ones(d), np.zeros(d), -30.0 if good.all() else 30.0)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    diff = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]
    w = np.zeros(d)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1 - p) / pairs - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    # between the scores on both sides of the quantile, so that neither of the two rows lies on the threshold
    q = np.sort(s)
    k = min(len(q) - 1, max(1, round(len(q) * (1 - good.mean()))))
    return BradleyTerry(mean, spread, w, float((q[k - 1] + q[k]) / 2))


def _feature_rows(batches):
    common.held("quality")
    for batch in batches:
        x = np.array([features(t.as_py()) for t in batch.column("_text")]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], names=["_label", "x"])


def _score_rows(batches, model: BradleyTerry):
    common.held("quality")
    for batch in batches:
        x = np.array([features(t.as_py()) for t in batch.column("_text")]).reshape(-1, len(FEATURES))
        names = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model.scores(x), pa.float64())], names=[*names, "score"])


def held_out(doc_id) -> "F.Column":
    """Rows of which no label is ever learned: crc32 of the id as text, modulo 3, is 1. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = 6000) -> BradleyTerry:
    """Fit on at most max_labels labelled rows, those with the smallest hashes of doc_id; held-out rows never count.

    Labels that are null, or whose document is missing or null, are left out; a document with several labels counts
    with the largest, a doc_id with several texts with the smallest of them. So what reaches the driver is bounded by
    max_labels however often ids are repeated.
    """
    common.ship(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)  # so few rows that they may be broadcast
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").alias("_text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")).select("_text", "_label")
    got = rows.mapInArrow(_feature_rows, f"_label {dict(labels.dtypes)['quality']}, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["_label"].to_numpy()))  # the same pairs whatever the order of arrival
    return fit(x[order], got["_label"].to_numpy()[order] > 0)


def score(docs: DataFrame, model: BradleyTerry, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and score double for each row. Null texts are scored as empty ones, repeated rows each; an empty
    table gives none. A column of keep called score is left out, other columns are not read."""
    common.ship(docs.sparkSession)
    rows = docs.select(*(c for c in keep if c != "score"), F.col("text").alias("_text"))
    return rows.mapInArrow(partial(_score_rows, model=model), rows.drop("_text").withColumn("score", F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns (of any name), whose score reaches the threshold; a score at it stays. Null texts are
    judged as empty ones, repeated rows each; an empty table stays empty, and without labels all rows stay."""
    model = learn(docs, labels, **options)
    scored = score(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model, keep=("_row",))
    return scored.where(F.col("score") >= threshold).select("_row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; a row for each, null and empty texts too."""
    docs, labels = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), common.table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
