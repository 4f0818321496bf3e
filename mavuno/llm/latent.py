"""Latent-semantic vectors of texts: hashed terms, inverse document frequencies and a truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, unit_hash

TERMS = 1024  # hashed terms of each of the two blocks
BINS = 8  # terms that stand for how much of a text repeats itself
DIMS = 2 * TERMS + BINS

# Classes of bytes: letters by case, digits, blanks and line ends share a class each, other marks have one each.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 1  # bytes of letters beyond ASCII, of whatever case


def _trigrams(codes: np.ndarray, seed: int) -> np.ndarray:
    """Counts of hashed trigrams; texts of fewer than three bytes are padded by zeros."""
    if len(codes) < 3:
        codes = np.concatenate([codes, np.zeros(3 - len(codes), np.uint32)])
    h = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77 + 2 * seed) + codes[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(22), minlength=TERMS)


def repetition(codes: np.ndarray, width: int = 16) -> float:
    """The share of windows of `width` bytes that stand elsewhere in the text already."""
    n = len(codes) - width + 1
    if n < 2:
        return 0.0
    powers, back = (np.cumprod(np.full(len(codes), b, np.uint32), dtype=np.uint32) for b in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(codes * powers, dtype=np.uint32)])
    window = (sums[width:] - sums[:-width]) * back[:n]  # the base is odd, so a window's sum can be moved back to place 0
    window.sort()
    return float(np.count_nonzero(window[1:] == window[:-1])) / n


_BASE = np.uint32(0x9E3779B1)
_INVERSE = np.uint32(pow(int(_BASE), -1, 1 << 32))


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text: square roots of relative frequencies of its marks and letter cases, of its letters
    regardless of case, and a soft histogram of its repetition. All zero for an empty or null text."""
    out = np.zeros(DIMS, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    lower = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    out[:TERMS] = np.sqrt(_trigrams(_CLASS[raw], 1) / max(1, len(raw) - 2))
    out[TERMS : 2 * TERMS] = np.sqrt(_trigrams(lower, 7) / max(1, len(lower) - 2))
    at = repetition(lower) * (BINS - 1)
    out[2 * TERMS + int(at)] = 1 - (at - int(at))
    if at > int(at):
        out[2 * TERMS + int(at) + 1] = at - int(at)
    return out


@dataclass(frozen=True)
class Space:
    """scale: inverse document frequency times the block's weight, for each term. basis: DIMS x dims."""

    scale: np.ndarray
    basis: np.ndarray

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors, a row for each text; zero for empty ones."""
        return unit(np.stack([terms(t) for t in texts]) * self.scale @ self.basis) if texts else np.zeros((0, self.basis.shape[1]), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(sample: np.ndarray, dims: int = 48, weights: tuple[float, float, float] = (1.0, 0.3, 0.7), seed: int = 7) -> Space:
    """Fit the space on term rows of a bounded sample, by a randomized SVD with fixed seed."""
    n = len(sample)
    idf = 1 + np.log((1 + n) / (1 + np.count_nonzero(sample, axis=0)))
    scale = (idf * np.repeat(weights, (TERMS, TERMS, BINS))).astype(np.float32)
    x = sample * scale
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((DIMS, min(DIMS, dims + 16))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return Space(scale, np.ascontiguousarray((q @ v.T)[:, :dims], dtype=np.float32))


def sampled(df: DataFrame, bound: int, *key: Column, seed: int = 0) -> DataFrame:
    """About `bound` rows of df, chosen by a hash of their key: the same rows however df is partitioned, and all if there
    are no more. Only fitting reads a sample; see the callers for their bounds."""
    n = df.count()
    return df if n <= bound else df.filter(unit_hash(*key, seed=seed) < bound / n)


def term_rows(df: DataFrame, text: str, *also: str) -> tuple[np.ndarray, pd.DataFrame]:
    """Collect the term rows of a bounded sample. Texts stay on the executors; 8 KB for each row come to the driver."""
    arrow_batches(df.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(also)].assign(terms=[terms(t).tobytes() for t in batch[text]])

    schema = df.select(*also, F.lit(b"").alias("terms")).schema
    rows = df.select(text, *also).mapInPandas(work, schema).toPandas()
    rows = rows.sort_values([*also, "terms"], ignore_index=True)  # fitting must not depend on the order of partitions
    return np.array([np.frombuffer(x, np.float32) for x in rows.pop("terms")], np.float32).reshape(-1, DIMS), rows
