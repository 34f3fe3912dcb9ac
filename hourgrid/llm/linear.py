"""Small dense models, on bounded samples in memory or by sums over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression on targets from 0 to 1, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - target)) + ridge * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibration(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn logits into calibrated ones."""
    slope, offset = fit_logistic(logit[:, None], labels.astype(float), penalty=1e-2)
    return float(max(slope, 0.0)), float(offset)


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Gradient and curvature of weighted rows, for each row of weights in ``fits``: one flat array each."""
    out = []
    for w in fits:
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y))
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        out.append(np.concatenate([gradient, curvature.ravel()]))
    return np.stack(out)


def newton_step(w: np.ndarray, sums: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """One Newton step, of bounded length, on a flat gradient and curvature."""
    d = len(w)
    ridge = np.full(d, penalty)
    ridge[-1] = 1e-3
    step = np.linalg.solve(sums[d:].reshape(d, d) + np.diag(ridge), sums[:d] + ridge * w)
    return w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))


def _packed(total: list[np.ndarray | None]) -> pa.RecordBatch:
    there = [i for i, t in enumerate(total) if t is not None]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([total[i].astype(np.float64).tobytes() for i in there], pa.binary())], names=["part", "sums"])


def added(rows: DataFrame, ask: Callable[[pa.RecordBatch], Sequence[np.ndarray | None]], parts: int) -> list[np.ndarray | None]:
    """The sums over all rows of the ``parts`` flat arrays that ``ask`` gives of a batch; one row a part reaches the driver."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None] * parts
        for batch in batches:
            if batch.num_rows:
                for i, found in enumerate(ask(batch)):
                    if found is not None:
                        total[i] = found if total[i] is None else total[i] + found
        yield _packed(total)

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None] * parts
        for batch in batches:
            for i, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                found = np.frombuffer(raw, np.float64)
                total[i] = found if total[i] is None else total[i] + found
        yield _packed(total)

    said = "part int, sums binary"
    found = {r["part"]: np.frombuffer(r["sums"], np.float64) for r in rows.mapInArrow(each, said).repartition("part").mapInArrow(together, said).collect()}
    return [found.get(i) for i in range(parts)]
