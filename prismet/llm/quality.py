"""Quality scores from Bradley-Terry pairwise ranking.

Every text becomes a vector of shares that do not depend on its length or language. From a bounded sample of
labelled rows (`sample` rows, drawn by a hash of the id, never held out), documents of label 1 are paired with
documents of label 0, PARTNERS drawn partners for each; a document beats another with the logistic of the
difference of their scores, and the linear scores that make the drawn preferences likeliest are found by Newton
steps on the logistic loss of feature differences. The threshold is a quantile of the scores of the sample: the
one whose cut agrees best with the labels. Scores are mapped so that the threshold lies at 0.3.

Defined results: null or empty text has all features 0 and gets the score of that vector; very long texts are
read whole; without labels of both kinds every score is 0.5; an empty table gives no rows; repeated rows score
alike; null labels and labels without a document are passed over. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_remainder, slices, table, texts_of

SAMPLE = 6000
PARTNERS = 12
THRESHOLD = 0.3
_RUNS = re.compile(r"[^\w\s]{2,}")
_SYMBOLS = str.maketrans("", "", "".join(chr(c) for c in range(33, 127) if chr(c).isalnum() or chr(c) in ".,;:'\"()-!?"))
FEATURES = 16


def features(text: str) -> np.ndarray:
    """Shares describing one text; those of rare marks are damped in short texts."""
    out = np.zeros(FEATURES)
    words = text.split()
    if not words:
        return out
    n, chars = len(words), len(text)
    counts = Counter(words)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, words))
    bare = sum(not any(map(str.isalnum, w)) for w in counts)
    symbols = len(text.translate(_SYMBOLS)) - letters_beyond_ascii(text) - chars_of_space(text)
    out[0] = repeated / n
    out[1] = 1 - len(counts) / n if n > 20 else 0.0
    out[2] = counts.most_common(1)[0][1] / n if n > 20 else 0.0
    out[3] = upper / n
    out[4] = max(0, symbols) / (chars + 60)
    out[5] = sum(m.end() - m.start() for m in _RUNS.finditer(text)) / (chars + 60)
    out[6] = text.count("!") / n
    out[7] = (text.count("|") + text.count(">") + text.count("·")) / n
    out[8] = 1 - len(line_counts) / len(lines)
    out[9] = (letters + 250) / (chars + 300)
    out[10] = sum(map(text.count, "0123456789")) / (chars + 300)
    out[11] = np.log1p(n) / 10
    out[12] = min(1.0, chars / n / 20)
    out[13] = bare / len(counts)
    out[14] = (text.count(".") + text.count(",") + text.count("!") + text.count("?")) / n
    out[15] = 1.0 if n < 8 else 0.0
    return out


def letters_beyond_ascii(text: str) -> int:
    return 0 if text.isascii() else sum(c > "\x7f" for c in text)


def chars_of_space(text: str) -> int:
    return sum(map(text.count, " \n\t\r\x0b\x0c"))


class Ranker:
    """Linear Bradley-Terry scores of standardised features and of their square roots, and the mapping to 0 to 1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, partners: int = PARTNERS, ridge: float = 1.0) -> None:
        self.ready = bool((labels == 1).any() and (labels == 0).any())
        if not self.ready:
            return
        self.mean = self.expand(rows).mean(axis=0)
        self.scale = np.maximum(self.expand(rows).std(axis=0), 1e-3)
        x = self.standard(rows)
        rng = np.random.default_rng(7)
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        pairs = np.concatenate([np.stack([np.repeat(good, partners), rng.choice(bad, len(good) * partners)], 1), np.stack([rng.choice(good, len(bad) * partners), np.repeat(bad, partners)], 1)])
        difference = x[pairs[:, 0]] - x[pairs[:, 1]]
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
            step = np.linalg.solve(difference.T @ (difference * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), difference.T @ p - ridge * w)
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut(x @ w, labels)

    @staticmethod
    def expand(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([rows, np.sqrt(np.abs(rows))], axis=1)

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((self.expand(rows) - self.mean) / self.scale, -6, 6)

    def cut(self, scores: np.ndarray, labels: np.ndarray) -> None:
        """The quantile of the scores at which keeping what lies above agrees best with the labels; the middle of ties."""
        order = np.argsort(scores, kind="stable")
        ranked, truth = scores[order], labels[order] == 1
        right = np.concatenate([[0], np.cumsum(~truth)]) + np.concatenate([np.cumsum(truth[::-1])[::-1], [0]])
        best = int(np.argmax(right))
        self.quantile = best / len(scores)
        low = ranked[best - 1] if best else ranked[0] - 1
        high = ranked[best] if best < len(ranked) else ranked[-1] + 1
        self.threshold = (low + high) / 2

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(rows), 0.5)
        raw = self.standard(rows) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _featured(docs: DataFrame, *more: str) -> DataFrame:
    schema = pa.schema([*[(c, pa.int64()) for c in more], ("features", pa.list_(pa.float64()))])

    def task(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in more], pa.array([features(t) for t in texts_of(batch)], pa.list_(pa.float64()))], schema=schema)

    return bounded(docs).mapInArrow(task, ", ".join([*[f"{c} long" for c in more], "features array<double>"]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Fit on at most about `sample` labelled rows whose id is not held out."""
    rank = F.shiftrightunsigned(F.xxhash64("label_id", F.lit(3)), 11) / float(1 << 53)
    marked = labels.where((id_remainder(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("long").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Ranker(np.zeros((0, FEATURES)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(1.0, sample / 2 / n))])
    chosen = marked.where(rank < F.element_at(share, F.col("quality")))  # about `sample` rows of two numbers: small by its bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("quality", "doc_id", "text")
    got = sorted((r["doc_id"], r["quality"], tuple(r["features"])) for r in _featured(rows, "doc_id", "quality").collect())
    return Ranker(np.array([g[2] for g in got]).reshape(-1, FEATURES), np.array([g[1] for g in got]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = shipped.value
        for batch in slices(batches):
            scores = own.score(np.array([features(t) for t in texts_of(batch)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())], schema=_SCHEMA)

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranker) -> DataFrame:
    """The documents predicted 1, with their own columns; rows are judged where they lie, without a join."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = shipped.value
        for batch in slices(batches):
            yield batch.filter(pa.array(own.score(np.array([features(t) for t in texts_of(batch)])) >= THRESHOLD))

    return bounded(docs).mapInArrow(task, docs.schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
