"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, unit_hash

HIDDEN = 8
WIDTH = 64  # bytes of a window; every window of a text is read, in both directions
TRAIN_TEXTS, TRAIN_ROWS = 512, 8192  # bounds of the labelled sample, whole texts: for each language, and for all (one for each at least)
STEPS, BATCH, RATE = 300, 256, 0.02
UNKNOWN = "und"

# A direction's parameters: `x` (3H x 256) what each byte adds to update gate, reset gate and candidate, `u` (3H x H) what
# the state adds, `c` (H x 1) the candidate's bias inside the reset. Gates are clip(0.25 a + 0.5, 0, 1), candidates clip(a, -1, 1).


def _direction(p: dict, text: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (T, H, B) for byte columns text (T, B)."""
    h_size = p["u"].shape[1]
    h = np.zeros((h_size, text.shape[1]), np.float32)
    out = np.empty((len(text), *h.shape), np.float32)
    for t, row in enumerate(text):
        a = np.take(p["x"], row, axis=1)
        s = p["u"] @ h
        gates = a[: 2 * h_size]
        gates += s[: 2 * h_size]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:h_size], gates[h_size:]
        inner = s[2 * h_size :]
        inner += p["c"]
        n = r * inner
        n += a[2 * h_size :]
        np.clip(n, -1, 1, out=n)
        if tape is not None:
            tape.append((row, h, z, r, inner, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def _scaled(p: dict) -> dict:
    """The same direction with the gates' line 0.25 a + 0.5 worked into the weights, for reading without a tape."""
    h_size = p["u"].shape[1]
    x, u = p["x"].copy(), p["u"].copy()
    x[: 2 * h_size] = 0.25 * x[: 2 * h_size] + 0.5
    u[: 2 * h_size] *= 0.25
    return {"x": x, "u": u, "c": p["c"]}


def _read(p: dict, text: np.ndarray, out: np.ndarray) -> None:
    """As _direction, for scaled parameters and byte columns as np.intp, into out (T, H, B), without new arrays."""
    h_size = p["u"].shape[1]
    a = np.empty((3 * h_size, text.shape[1]), np.float32)
    s = np.empty_like(a)
    gates, z, n, inner = a[: 2 * h_size], a[:h_size], a[h_size : 2 * h_size], s[2 * h_size :]
    h = np.zeros((h_size, text.shape[1]), np.float32)
    for t, row in enumerate(text):
        np.take(p["x"], row, axis=1, out=a, mode="clip")
        np.matmul(p["u"], h, out=s)
        gates += s[: 2 * h_size]
        np.clip(gates, 0, 1, out=gates)
        inner += p["c"]
        n *= inner  # n held the reset gate
        n += a[2 * h_size :]
        np.clip(n, -1, 1, out=n)
        np.subtract(h, n, out=out[t])
        h = out[t]
        h *= z
        h += n


def _back(p: dict, tape: list, d_out: np.ndarray) -> dict:
    """Gradients of a direction's parameters through time."""
    h_size = p["u"].shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d_h = np.zeros_like(d_out[0])
    for t in range(len(tape) - 1, -1, -1):
        row, h, z, r, inner, n = tape[t]
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * ((n > -1) & (n < 1))
        d_z = d_h * (h - n) * 0.25 * ((z > 0) & (z < 1))
        d_r = d_n * inner * 0.25 * ((r > 0) & (r < 1))
        d_inner = d_n * r
        d_a = np.concatenate([d_z, d_r, d_n])
        d_s = np.concatenate([d_z, d_r, d_inner])
        g["c"] += d_inner.sum(axis=1, keepdims=True)
        g["u"] += d_s @ h.T
        np.add.at(g["x"].T, row, d_a.T)
        d_h = d_h * z + p["u"].T @ d_s
    return g


@dataclass(frozen=True)
class Network:
    languages: list[str]
    forward: dict
    backward: dict
    w: np.ndarray  # (L, 2H)
    b: np.ndarray  # (L, 1)

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, 2H, B) to (T, L, B)."""
        a = self.w @ states + self.b
        a -= a.max(axis=1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=1, keepdims=True)
        return a

    def positions(self, text: np.ndarray) -> np.ndarray:
        """Language probabilities (T, L, B) of every byte of the byte columns text (T, B)."""
        h_size = len(self.forward["c"])
        states = np.empty((len(text), 2 * h_size, text.shape[1]), np.float32)
        rows = text.astype(np.intp)
        _read(_scaled(self.forward), rows, states[:, :h_size])
        _read(_scaled(self.backward), rows[::-1], states[::-1, h_size:])
        return self._probabilities(states)

    def pooled(self, texts: list[str], windows_at_once: int = 4096) -> np.ndarray:
        """Mean probabilities (n, L) over all bytes of each text; zero for an empty one."""
        lengths = np.array([len(t.encode()) for t in texts], int)
        counts = -(-lengths // WIDTH)
        total = np.zeros((len(texts), len(self.languages)))
        if counts.sum() and self.languages:
            flat, _, sizes = windows(texts, [0] * len(texts))
            sums = np.empty((len(flat), len(self.languages)), np.float64)
            for i in range(0, len(flat), windows_at_once):
                part = np.ascontiguousarray(flat[i : i + windows_at_once].T)
                p = self.positions(part)
                p *= (np.arange(WIDTH)[:, None] < sizes[i : i + windows_at_once])[:, None]  # padding is no position
                sums[i : i + windows_at_once] = p.sum(axis=0).T
            full = counts > 0
            total[full] = np.add.reduceat(sums, (np.cumsum(counts) - counts)[full])
        return total / np.maximum(lengths, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its pooled probability. UNKNOWN and 0 for a text that is null or has no letter."""
        known = [bool(t) and any(c.isalpha() for c in t) for t in texts]
        p = self.pooled([t if k else "" for t, k in zip(texts, known, strict=True)])
        best = p.argmax(axis=1) if p.size else np.zeros(len(texts), int)
        known = np.array(known, bool) & bool(self.languages)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1, initial=0.0), 0.0).clip(0, 1)


def windows(texts: list[str], goals: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of WIDTH bytes of whole texts, their goals, and how many bytes each has; the last one of a text is padded."""
    raw = [(np.frombuffer(t.encode(), np.uint8), g) for t, g in zip(texts, goals, strict=True)]
    counts = [-(-len(x) // WIDTH) for x, _ in raw]
    data, sizes = np.zeros((sum(counts), WIDTH), np.uint8), np.full(sum(counts), WIDTH)
    at = 0
    for (x, _), k in zip(raw, counts, strict=True):
        data[at : at + k].reshape(-1)[: len(x)] = x
        if k:
            sizes[at + k - 1] = len(x) - WIDTH * (k - 1)
        at += k
    return data, np.repeat([g for _, g in raw], counts).astype(int), sizes


def train(texts: list[str], languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on the mean cross-entropy of all positions, by backpropagation through time over windows of WIDTH bytes.

    Each step draws a text of each language, then one of its windows, so short texts count as long ones do; padding is
    no position. Two or more languages always train; a single one needs no weights, and without texts nothing is told.
    """
    told = [(t, n) for t, n in zip(texts, languages, strict=True) if t]
    names = sorted({n for _, n in told})
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    side = lambda: {"x": init(3 * hidden, 256), "u": init(3 * hidden, hidden), "c": np.zeros((hidden, 1), np.float32)}
    net = Network(names, side(), side(), init(len(names), 2 * hidden), np.zeros((len(names), 1), np.float32))
    if len(names) < 2:
        return net
    goals = [names.index(n) for _, n in told]
    data, _, sizes = windows([t for t, _ in told], goals)
    counts = np.array([-(-len(t.encode()) // WIDTH) for t, _ in told])
    starts = np.cumsum(counts) - counts
    params = [("f", k, v) for k, v in net.forward.items()] + [("b", k, v) for k, v in net.backward.items()] + [("o", "w", net.w), ("o", "b", net.b)]
    m, v2 = [np.zeros_like(p) for *_, p in params], [np.zeros_like(p) for *_, p in params]
    per = [np.flatnonzero(np.array(goals) == i) for i in range(len(names))]
    for step in range(1, steps + 1):
        chosen = rng.permutation(len(per))[:BATCH]  # languages count alike; of more than BATCH each step takes as many
        picked = np.concatenate([rng.choice(per[i], max(1, BATCH // len(per))) for i in chosen])
        pick = starts[picked] + (rng.random(len(picked)) * counts[picked]).astype(int)
        text, y = np.ascontiguousarray(data[pick].T), np.array(goals)[picked]
        real = (np.arange(WIDTH)[:, None] < sizes[pick]).astype(np.float32)
        tf, tb = [], []
        states = np.concatenate([_direction(net.forward, text, tf), _direction(net.backward, text[::-1], tb)[::-1]], axis=1)
        p = net._probabilities(states)
        p[:, y, np.arange(len(y))] -= 1
        p *= real[:, None, :] / real.sum()
        d_states = net.w.T @ p
        gf = _back(net.forward, tf, d_states[:, :hidden])
        gb = _back(net.backward, tb, d_states[::-1, hidden:])
        grads = {("f", k): g for k, g in gf.items()} | {("b", k): g for k, g in gb.items()} | {("o", "w"): np.einsum("tlb,thb->lh", p, states), ("o", "b"): p.sum(axis=(0, 2))[:, None]}
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, (part, k, value) in enumerate(params):
            g = np.clip(grads[part, k], -1, 1)
            m[i] = 0.9 * m[i] + 0.1 * g
            v2[i] = 0.999 * v2[i] + 0.001 * g * g
            value -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v2[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Network:
    """Train on a bounded sample of whole texts outside the held-out fold: about TRAIN_TEXTS of each language, fewer where
    many languages share TRAIN_ROWS, chosen by a hash of doc_id and text. A row for each language and the sample come to
    the driver. Null and empty texts, null languages and UNKNOWN teach nothing."""
    known = docs.filter(F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN) & (F.length(text) > 0) & ~held_out())
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [])
    each = max(1, min(TRAIN_TEXTS, TRAIN_ROWS // len(counts)))
    rates = docs.sparkSession.createDataFrame([(k, max(each, 8) / n) for k, n in counts.items()], "_named string, _rate double")
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col(text)]
    chosen = known.join(F.broadcast(rates), F.col(lang) == F.col("_named")).filter(unit_hash(*key, seed=3) < F.col("_rate"))
    rows = [(r[text], r[lang]) for r in chosen.select("doc_id", lang, text).collect()]
    rows.sort(key=lambda r: (r[1], hashlib.blake2b(r[0].encode()).digest()))
    return train([t for t, _ in rows], [n for _, n in rows])


def identify(df: DataFrame, network: Network, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language of each whole text and its pooled probability to df.

    UNKNOWN and 0 for a text that is null, empty or without a letter, and for all texts if the network knows no language.
    Every byte of a long text is read, window by window; equal texts get equal answers. Columns so named are replaced,
    the rest stay; nothing is shuffled, and an empty df gives none.
    """
    arrow_batches(df.sparkSession)
    df = df.drop(*into)
    sent = df.sparkSession.sparkContext.broadcast(network)  # tens of kB

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = sent.value.predict([None if t is None or t != t else t for t in batch[text]])
            yield batch.assign(**{into[0]: names, into[1]: scores})

    return df.mapInPandas(work, df.withColumn(into[0], F.lit("")).withColumn(into[1], F.lit(0.0)).schema)
