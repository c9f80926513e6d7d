"""Scoring networks, run by Spark over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(features: DataFrame, model: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], column: str = "features", batch: int = 256) -> DataFrame:
    """p: three probabilities for each row, by a model on batches of arrays [rows, *shape]. Any model will do."""
    schema = features.drop(column).withColumn("p", F.array(F.lit(0.0))).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                x = np.stack(part[column].to_list()).reshape(len(part), *shape).astype(np.float32)
                yield part.drop(columns=column).assign(p=list(model(x).astype(float)))

    return features.mapInPandas(run, schema)


def recurrent_model(weights: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A bidirectional GRU over positions, pooled by mean, and a softmax: from given weights, in numpy."""

    def direction(x: np.ndarray, d: str) -> np.ndarray:
        w, u, b = weights["w" + d], weights["u" + d], weights["b" + d]
        k = u.shape[0]
        h, out = np.zeros((len(x), k), np.float32), np.zeros((len(x), x.shape[1], k), np.float32)
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            i, s = x[:, t] @ w + b, h @ u
            z, r = (1 / (1 + np.exp(-(i[:, j * k : (j + 1) * k] + s[:, j * k : (j + 1) * k]))) for j in (0, 1))
            c = np.tanh(i[:, 2 * k :] + r * s[:, 2 * k :])
            h = c + z * (h - c)
            out[:, t] = h
        return out

    def run(x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([direction(x, "f"), direction(x, "b")], axis=2).mean(axis=1)
        e = pooled @ weights["o"] + weights["bo"]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return run


def convolve(x: np.ndarray, w: np.ndarray, stride: int = 1) -> np.ndarray:
    """Convolution of x [n, channels, rows, columns] with w [out, channels, 3, 3], one zero around: one product of
    matrices over all places of all examples."""
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    view = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))[:, :, ::stride, ::stride]
    n, _, rows, columns = view.shape[:4]
    places = view.transpose(0, 2, 3, 1, 4, 5).reshape(n * rows * columns, -1)
    return (places @ w.reshape(len(w), -1).T).reshape(n, rows, columns, len(w)).transpose(0, 3, 1, 2)


def residual_model(weights: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Probabilities of read-level matrices [n, rows, columns, channels] by a residual network of given weights.

    Three steps halve rows and columns, each followed by a block that adds its input to two convolutions of it; three
    dense layers end in a softmax. Convolutions are normalised by stored means and variances. Names: c1 to c3 for the
    steps, c1a, c1b and so on for the blocks, each with a kernel and /scale, /shift, /mean, /var; d1 to d3 with /bias.
    """

    def normal(x: np.ndarray, name: str) -> np.ndarray:
        g = weights[f"{name}/scale"] / np.sqrt(weights[f"{name}/var"] + 1e-5)
        return x * g[None, :, None, None] + (weights[f"{name}/shift"] - weights[f"{name}/mean"] * g)[None, :, None, None]

    selu = lambda x: 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0)))

    def run(x: np.ndarray) -> np.ndarray:
        h = np.ascontiguousarray(x.transpose(0, 3, 1, 2))
        for k in ("c1", "c2", "c3"):
            h = np.maximum(normal(convolve(h, weights[k], 2), k), 0)
            inner = np.maximum(normal(convolve(h, weights[f"{k}a"]), f"{k}a"), 0)
            h = np.maximum(h + normal(convolve(inner, weights[f"{k}b"]), f"{k}b"), 0)
        h = h.reshape(len(h), -1)
        for k in ("d1", "d2", "d3"):
            h = selu(h @ weights[k].T + weights[f"{k}/bias"])
        e = np.exp(h - h.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return run


def random_residual_weights(shape: tuple[int, int, int], seed: int, widths: tuple[int, int, int] = (64, 96, 128), dense: tuple[int, int, int] = (160, 128, 3)) -> dict[str, np.ndarray]:
    """Weights of the right shapes for matrices [rows, columns, channels], to try a plan with."""
    r, out, before = np.random.default_rng(seed), {}, shape[2]

    def layer(name: str, to: int, of: int) -> None:
        out[name] = r.normal(0, (9 * of) ** -0.5, (to, of, 3, 3)).astype(np.float32)
        out[f"{name}/scale"], out[f"{name}/var"] = (r.uniform(0.5, 1.5, to).astype(np.float32) for _ in range(2))
        out[f"{name}/shift"], out[f"{name}/mean"] = (r.normal(0, 0.1, to).astype(np.float32) for _ in range(2))

    rows, columns = shape[:2]
    for k, n in enumerate(widths, 1):
        layer(f"c{k}", n, before)
        layer(f"c{k}a", n, n)
        layer(f"c{k}b", n, n)
        before, rows, columns = n, -(-rows // 2), -(-columns // 2)
    size = before * rows * columns
    for k, n in enumerate(dense, 1):
        out[f"d{k}"], out[f"d{k}/bias"] = r.normal(0, size**-0.5, (n, size)).astype(np.float32), r.normal(0, 0.1, n).astype(np.float32)
        size = n
    return out
