"""Decomposition over a fixed dictionary: orthogonal matching pursuit, then non-negative least squares on its support."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismet.operators.similarity import matrix, tile_rows, unit


def matching_pursuit(x: np.ndarray, atoms: np.ndarray, k: int, least: float = 1e-10) -> np.ndarray:
    """Places of up to k atoms (unit rows): each time the one that correlates most with what is left."""
    return pursuits(x[None], atoms, k, least)[0]


def pursuits(x: np.ndarray, atoms: np.ndarray, k: int, least: float = 1e-10) -> list[np.ndarray]:
    """matching_pursuit of each row of x. The projections are kept as orthonormal bases, so a step costs one product of what
    is left of the rows with the dictionary."""
    if k > len(atoms):
        raise ValueError(f"k={k} exceeds the dictionary's {len(atoms)} atoms")
    n, d = x.shape
    left, basis, chosen, on = x.astype(float).copy(), np.zeros((n, k, d)), np.full((n, k), -1), np.arange(n)
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)[:, None]
    for step in range(k):
        on = on[np.linalg.norm(left[on], axis=1) > least]
        if not len(on):
            break
        match = left[on] @ atoms.T
        np.abs(match, out=match)
        match[np.arange(len(on))[:, None], chosen[on, :step]] = -1
        at = match.argmax(1)
        chosen[on, step] = at
        v = atoms[at].astype(float)
        for _again in range(2):
            for b in range(step):
                v -= dot(basis[on, b], v) * basis[on, b]
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.where(size > 1e-9, v / np.maximum(size, 1e-300), 0.0)  # an atom that its forerunners span adds no direction
        basis[on, step] = v
        left[on] -= dot(v, left[on]) * v
    return [c[c >= 0] for c in chosen]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Least |a x - b| over x >= 0, by the active-set method on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    n = len(target)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        gradient = target - gram @ x
        if free.all() or np.where(free, -np.inf, gradient).max() <= tolerance:
            break
        free[int(np.where(free, -np.inf, gradient).argmax())] = True
        while True:
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (solved > tolerance).all():
                x[:] = 0
                x[at] = solved
                break
            bad = solved <= tolerance
            ratio = x[at][bad] / np.maximum(x[at][bad] - solved[bad], 1e-300)
            x[at] += ratio.min() * (solved - x[at])
            free[at[x[at] <= tolerance]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def decompose(images: DataFrame, terms: list[str], dictionary: np.ndarray, k: int, gap: np.ndarray | None = None) -> DataFrame:
    """image_id, term_idx, name, activation of the positive coefficients; the dictionary is broadcast, its size is fixed.

    images: image_id, emb."""
    if len(terms) != len(dictionary):
        raise ValueError(f"{len(terms)} terms and {len(dictionary)} rows of the dictionary")
    if k > len(dictionary):
        raise ValueError(f"k={k} exceeds the dictionary's {len(dictionary)} atoms")
    shipped = images.sparkSession.sparkContext.broadcast((terms, unit(np.asarray(dictionary, float)), gap))
    schema = pa.schema([("image_id", pa.int64()), ("term_idx", pa.int64()), ("name", pa.string()), ("activation", pa.float64())])

    def task(batches):
        names, atoms, moved = shipped.value
        for batch in batches:
            rows = []
            images_, x = batch.column("image_id").to_pylist(), matrix(batch.column("emb"))
            x = unit(x if moved is None or not len(x) else x - moved)
            strip = tile_rows(len(atoms))
            found = (at for lo in range(0, len(x), strip) for at in pursuits(x[lo : lo + strip], atoms, k))
            for image, row, at in zip(images_, x, found, strict=True):  # found reads x as it goes
                weights = nonnegative_least_squares(atoms[at].T, row) if len(at) else np.zeros(0)
                order = np.lexsort((at, -weights))
                rows += [(image, int(at[i]), names[at[i]], float(weights[i])) for i in order if weights[i] > 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return images.select(F.col("image_id").cast("long").alias("image_id"), F.col("emb").cast("array<double>").alias("emb")).mapInArrow(task, "image_id long, term_idx long, name string, activation double")
