"""Hashed byte n-grams of whole texts and sparse logistic regression on them.

A text's features are the shares of its n-grams, hashed to ``2**BITS`` places.
A linear score is then the mean weight of the text's n-grams, so scoring looks
each n-gram up in a table and adds: no feature vector is built, and long texts
are read in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import buffers

BITS = 15
PLACES = 1 << BITS
_BLOCK = 1 << 18          # bytes looked at at a time


def _places(x: np.ndarray) -> np.ndarray:
    """Place of the 3-gram that starts at each byte but the last two."""
    x = x.astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def spans(offsets: np.ndarray):
    """Cut rows into blocks: ``(first row, last row, first byte, last byte)``;
    a long row makes several blocks that overlap by two bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j
            continue
        for a in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[i + 1]) - 2), _BLOCK):
            yield i, i + 1, a, min(a + _BLOCK + 2, int(offsets[i + 1]))
        i += 1


def gram_blocks(texts: pa.Array, lut: np.ndarray):
    """``(rows, places)`` of all 3-grams, block by block; rows ascend."""
    offsets, data = buffers(texts)
    for i, j, a, b in spans(offsets):
        if b - a < 3:
            continue
        at = _places(lut[data[a:b]])
        if j - i == 1:
            yield np.full(len(at), i), at
            continue
        ends = offsets[i:j + 1] - a
        row = np.repeat(np.arange(i, j), np.diff(ends))[:len(at)]
        inside = row == np.repeat(np.arange(i, j), np.diff(ends))[2:]
        yield row[inside], at[inside]


def mean_scores(texts: pa.Array, lut: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean row of ``weights`` over each text's 3-grams (zero if none)."""
    total = np.zeros((len(texts), weights.shape[1]))
    count = np.zeros(len(texts))
    for row, at in gram_blocks(texts, lut):
        if not len(row):
            continue
        cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        total[row[cut]] += np.add.reduceat(weights[at], cut, axis=0)
        count[row[cut]] += np.diff(np.append(cut, len(row)))
    return total / np.maximum(count, 1)[:, None]


def sparse(texts: pa.Array, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, share)`` of a bounded sample, sorted by row."""
    keys, counts = [], []
    for row, at in gram_blocks(texts, lut):
        k, c = np.unique(row * PLACES + at, return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    flat, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, weights=np.concatenate(counts))
    row, at = flat // PLACES, flat % PLACES
    size = np.bincount(row, weights=count, minlength=len(texts))
    return row, at, count / size[row]


def fit_sparse(row, place, share, y: np.ndarray, sample_weight: np.ndarray | None = None,
               steps: int = 50, ridge: float = 1e-3,
               start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A logistic regression for every column of ``y`` (0/1) by accelerated
    gradient steps, from ``start`` if given; weights per place and biases.
    Entries are sorted by row."""
    n, b = y.shape
    sw = np.ones(n) if sample_weight is None else sample_weight
    sw = (sw / max(sw.sum(), 1e-12)).astype(np.float32)
    out, biases = (np.zeros((PLACES, b)), np.zeros(b)) if start is None else (start[0].copy(), start[1].copy())
    if not len(row):
        return out, biases
    used, col = np.unique(place, return_inverse=True)
    scale = (1.0 / np.sqrt(np.bincount(col, weights=share) / n + 1e-4)).astype(np.float32)
    x = (share * scale[col]).astype(np.float32)
    by_col = np.argsort(col, kind="stable")
    row_c, x_c = row[by_col], x[by_col]
    col_cut = np.flatnonzero(np.concatenate(([True], np.diff(col[by_col]) > 0)))
    row_cut = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
    norm = float((np.bincount(row, weights=x * x, minlength=n) * sw).sum())
    rate = np.float32(1.0 / (0.25 * (2 * norm + 1) + ridge))
    for k in range(b):
        w, bias = (out[used, k] / scale).astype(np.float32), float(biases[k])
        look_w, look_b, t = w.copy(), bias, 1.0
        target = y[:, k].astype(np.float32)
        for _ in range(steps):
            f = np.full(n, look_b, np.float32)
            f[row[row_cut]] += np.add.reduceat(look_w[col] * x, row_cut)
            g = (1 / (1 + np.exp(-np.clip(f, -35, 35))) - target) * sw
            grad = np.add.reduceat(g[row_c] * x_c, col_cut)
            new_w, new_b = look_w - rate * (grad + ridge * look_w), look_b - rate * float(g.sum())
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            step = np.float32((before - 1) / t)
            look_w, look_b = new_w + step * (new_w - w), new_b + step * (new_b - bias)
            w, bias = new_w, new_b
        out[used, k], biases[k] = w * scale, bias
    return out, biases


def fit_dense(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None,
              steps: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    sw = np.ones(len(x)) if sample_weight is None else sample_weight
    w = np.zeros(x.shape[1])
    keep = ridge * max(sw.sum(), 1.0) * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ ((p - y) * sw) + keep * w
        hess = (x * (np.maximum(p * (1 - p), 1e-6) * sw)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
