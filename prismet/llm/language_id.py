"""Language identification with a blended-spectrum presence kernel.

A text is the set of its character 1- to 3-grams (lower case; all that is no letter is one character). The kernel
of two texts is the size of the intersection over the geometric mean of their sizes. Landmarks, an equal number
of training texts a language, give the Nystroem map K(x, L) K(L, L)^(-1/2); ridge regression on it, one language
against the rest, gives weights that are folded back to the landmarks. Scoring counts the grams that a text shares
with each landmark (a bit a landmark for every gram of theirs), then multiplies by weights (landmarks x languages).

Training uses a bounded sample (`sample` rows, texts up to `longest` characters, drawn by a hash of the id) of
the rows that are not held out and whose lang is known; prediction reads the text alone.

Defined results: `und` with score 0 where text is null or has no letter, or where nothing could be learned;
an empty table gives no rows; ties go to the first language in code-point order; other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_remainder, slices, table, texts_of

SAMPLE = 1600
LANDMARKS = 64
LONGEST = 32_000
UNDETERMINED = "und"


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: 0 for what is no letter, one of its own for every letter."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)), np.int64, sys.maxunicode + 1)


class PresenceGrams:
    """Character 1- to 3-grams as numbers, exact for all letters of Unicode; all that is no letter is one character."""

    #: Code points that are told apart, and the base of the numbers.
    known = range(sys.maxunicode + 1)
    size = sys.maxunicode + 1

    def of(self, text: str) -> np.ndarray:
        """The different grams of a text, in order."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _classes()[codes]
        a = self.size
        two = c[:-1] * a + c[1:]
        return np.concatenate([np.unique(c), np.unique(two) + a, np.unique(two[:-1] * a + c[2:]) + a + a * a])


class Model:
    """Nystroem kernel ridge regression; see the module's text."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> None:
        self.langs = sorted(set(langs))
        self.grams = PresenceGrams()
        by_lang = {g: [i for i, x in enumerate(langs) if x == g] for g in self.langs}
        each = max(1, landmarks // max(1, len(self.langs)))
        marks = [i for g in self.langs for i in by_lang[g][:each]]
        sets = [self.grams.of(texts[i]) for i in marks]
        self.vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        self.norms = np.sqrt([max(1, len(s)) for s in sets])
        self.landmarks = np.zeros((len(self.vocabulary), -(-len(marks) // 8)), np.uint8)
        for j, s in enumerate(sets):
            self.landmarks[np.searchsorted(self.vocabulary, s), j // 8] |= 128 >> j % 8
        inner = self.kernel([texts[i] for i in marks]).astype(float)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        mapped = self.kernel(texts).astype(float) @ root
        share = {g: len(by_lang[g]) for g in self.langs}
        weight = np.array([1 / share[x] for x in langs])[:, None]
        goal = np.array([[1.0 if x == g else -1.0 for g in self.langs] for x in langs])
        solved = np.linalg.solve(mapped.T @ (weight * mapped) + ridge * np.eye(mapped.shape[1]), mapped.T @ (weight * goal))
        self.weights = (root @ solved).astype(np.float32)

    def kernel(self, texts: list[str], block: int = 16384) -> np.ndarray:
        """Kernel of the texts with the landmarks, whose bits are counted in blocks of grams."""
        n = len(self.norms)
        out = np.zeros((len(texts), n), np.float32)
        for i, t in enumerate(texts if len(self.vocabulary) else []):
            grams = self.grams.of(t)
            at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
            at = at[self.vocabulary[at] == grams]
            common = np.zeros(n, np.int64)
            for start in range(0, len(at), block):
                common += np.unpackbits(self.landmarks[at[start : start + block]], axis=1, count=n).sum(axis=0, dtype=np.int32)
            out[i] = common / (np.sqrt(max(1, len(grams))) * self.norms)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        raw = self.kernel(texts) @ self.weights
        soft = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        sure = soft[np.arange(len(texts)), best] / soft.sum(axis=1)
        lettered = [any(c.isalpha() for c in t) for t in texts]
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(sure, lettered, strict=True)]


def training_rows(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """(text, lang) of at most `sample` rows, the same number for every language where it has them."""
    learn = docs.where((id_remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return []
    quota = max(1, sample // len(counts))
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, (1.5 * quota + 20) / n))])
    rows = learn.where((rank < F.element_at(share, F.col("lang"))) & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}")).select(rank.alias("rank"), "lang", "text").collect()
    out, seen, used = [], set(), Counter()
    for r in sorted(rows, key=lambda r: (r["rank"], r["text"])):
        if used[r["lang"]] < quota and r["text"] not in seen:
            seen.add(r["text"])
            used[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return out


def train(docs: DataFrame, **options) -> Model:
    rows = training_rows(docs, **options)
    return Model([r[0] for r in rows], [r[1] for r in rows])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = shipped.value
        for batch in slices(batches, rows=512):
            langs, scores = own.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=_SCHEMA)

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
