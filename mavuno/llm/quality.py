"""Document quality by nearest-neighbour voting among labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out
from .latent import Space, fit, sampled, term_rows

MOST_LABELLED = 4096  # bound of the labelled sample: 33 MB of term rows at the driver, under 1 MB of vectors sent to executors
NEIGHBOURS = 15
SHARPNESS = 12.0  # a neighbour's vote counts as its cosine to this power
LEAST_SCORE = 0.7


@dataclass(frozen=True)
class Voter:
    space: Space
    vectors: np.ndarray  # of the labelled documents
    labels: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """For each text the mean label of its nearest labelled documents by exact cosine, weighted by likeness.
        0 for empty texts, which are like no document, and for all texts if nothing is labelled."""
        x = self.space.vectors(texts)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.zeros(len(x))
        cosine = x @ self.vectors.T  # a block of documents against all labelled ones
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(cosine, near, axis=1).astype(np.float64), 0, 1) ** SHARPNESS
        return np.clip((votes * self.labels[near]).sum(axis=1) / np.maximum(votes.sum(axis=1), 1e-300), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, bound: int = MOST_LABELLED) -> Voter:
    """Learn from at most about `bound` labelled documents outside the held-out fold, chosen by a hash of their id.

    A document that is labelled more than once counts as labelled 1 only if all its labels are 1; null labels and
    labels of unknown documents are left out.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = sampled(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), bound, F.col("doc_id"))
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # the sample is bounded
    rows, about = term_rows(found, "text", "doc_id", "quality")
    space = fit(rows)
    return Voter(space, _unit_rows(rows, space), about["quality"].to_numpy(np.float64))


def _unit_rows(rows: np.ndarray, space: Space) -> np.ndarray:
    x = rows * space.scale @ space.basis
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def score(df: DataFrame, voter: Voter, text: str = "text", into: str = "score") -> DataFrame:
    """Add `into`, the quality of each whole text from 0 to 1, to df.

    Null and empty texts score 0, and so do all without labels; very long texts are read whole, and equal texts score alike
    whatever batch they are in. A column named `into` is replaced, all others stay; an empty df gives none.
    """
    arrow_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(voter)  # bounded by the labelled sample
    df = df.drop(into)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.concatenate([sent.value.scores(list(batch[text].iloc[i : i + 512])) for i in range(0, len(batch), 512)] or [np.zeros(0)])
            yield batch.assign(**{into: out})

    return df.mapInPandas(work, df.withColumn(into, F.lit(0.0)).schema)
