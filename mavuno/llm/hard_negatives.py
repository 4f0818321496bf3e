"""Hard negatives for anchors, from full integer scores by the method of the four Russians."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut

UNIT = 256  # a component x counts as floor(UNIT * x)
GROUP = 8  # components whose bits make up a byte
ANCHORS, ROWS = 1024, 8192  # anchors and rows of a cell of the grid
TILE = 256  # anchors whose tables are looked up at a time, so that one group's table stays in the cache
POSITIVES, NEGATIVES = 5, 10
FROM, TO, OF = 30, 90, 100  # OF times a negative's score lies between FROM and TO times the positive's
_LONG = (1 << 63) - 1


def whole(vectors: list[np.ndarray]) -> np.ndarray:
    """Components as whole numbers, a row for each vector, shorter ones filled with zeros; Python's integers where 62 bits are too few."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    if np.abs(out).max(initial=0) < 2.0**53:
        return np.floor(out * UNIT).astype(np.int64)
    # a float of this size is whole
    return np.array([[int(np.floor(x * UNIT)) if abs(x) < 2.0**53 else int(x) * UNIT for x in row] for row in out.tolist()], dtype=object)


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """The two's complement of each number, bit by bit from the sign down: (row, plane, group) bytes, a bit of a byte for each of GROUP
    neighbouring components."""
    rows, width = numbers.shape
    groups = -(-width // GROUP)
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    bits = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0) + 1
    out = np.zeros((rows, bits, groups), np.uint8)
    for b in range(bits):
        plane = ((numbers >> (bits - 1 - b)) & 1).astype(np.uint8)
        out[:, b] = np.packbits(plane, axis=1, bitorder="little")
    return out


class Scorer:
    """Scores of rows by anchors. For each group of GROUP components a table holds the sum of every subset of the anchor's
    components, so that a byte of a plane is looked up instead of multiplied; planes are added up from the sign down by doubling."""

    def __init__(self, anchors: np.ndarray):
        self.n = len(anchors)
        groups = -(-anchors.shape[1] // GROUP)
        wide = np.zeros((self.n, groups * GROUP), anchors.dtype)
        wide[:, : anchors.shape[1]] = anchors
        most = max((abs(int(x)) for x in (wide.min(), wide.max())), default=0) if wide.size else 0
        self.bits, self.kept = most.bit_length() + wide.shape[1].bit_length(), {}
        # (group, subset, anchor): each component doubles the subsets that are known
        self.tables = np.zeros((groups, 1 << GROUP, self.n), np.int64 if self.bits < 62 else object)
        for k in range(GROUP):
            self.tables[:, 1 << k : 2 << k] = self.tables[:, : 1 << k] + wide[:, k::GROUP].T[:, None, :]

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """(row, anchor) inner products. Where one of the two has more components, the other's count as zero."""
        rows, bits, groups = planes.shape
        groups = min(groups, len(self.tables))
        exact = np.int32 if self.bits + bits < 31 else np.int64 if self.bits + bits < 62 else object
        if exact not in self.kept:
            self.kept[exact] = self.tables.astype(exact, copy=False)
        tables = self.kept[exact]
        out = np.zeros((rows, self.n), exact)
        for a in range(0, self.n, TILE):
            total = np.zeros((rows, min(TILE, self.n - a)), exact)
            for b in range(bits):
                plane = np.zeros_like(total)
                for g in range(groups):
                    plane += tables[g, :, a : a + TILE][planes[:, b, g]]
                total = plane * -1 if b == 0 else total * 2 + plane  # the first plane is the sign's
            out[:, a : a + TILE] = total
        return out if exact is not object else np.clip(out, -_LONG, _LONG).astype(np.int64)


class Best:
    """The k best rows of each slot that have been met so far: highest score first, ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.least, self.last = np.full(slots, -_LONG - 1), np.full(slots, _LONG)

    def beats(self, score: np.ndarray, ids: np.ndarray, slots: np.ndarray | slice) -> np.ndarray:
        """Which of (row, slot) scores could come in."""
        least = self.least[slots]
        return (score > least) | (score == least) & (ids[:, None] < self.last[slots])

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        full = place == self.k - 1
        self.least[slot[full]], self.last[slot[full]] = score[full], ids[full]
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def _finite(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, n_bits, planes) of the rows that take part, and their components as whole numbers where `is_anchor`."""
    rows = vectors.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"), "is_anchor")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("embedding")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = [whole([v]) for v in batch["embedding"]]
            planes = [bit_planes(n)[0] for n in numbers]
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"],
                    "label": batch["label"],
                    "n_bits": [len(p) for p in planes],
                    "planes": [p.tobytes() for p in planes],
                    "vector": [v if a else None for v, a in zip(batch["embedding"], batch["is_anchor"], strict=True)],
                }
            )

    return rows.mapInPandas(encode, "vec_id long, label long, n_bits int, planes binary, vector array<double>")


def _stacked(planes: pd.Series, bits: pd.Series) -> np.ndarray:
    """Planes of several rows as one block: the sign's plane is repeated where a row has fewer, groups that it has not are zero."""
    rows = [np.frombuffer(p, np.uint8).reshape(b, -1) for p, b in zip(planes, bits, strict=True)]
    out = np.zeros((len(rows), max(map(len, rows)), max(r.shape[1] for r in rows)), np.uint8)
    for block, r in zip(out, rows, strict=True):
        block[-len(r) :, : r.shape[1]] = r
        block[: -len(r), : r.shape[1]] = r[0]
    return out


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, work, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows, in cells that are shuffled: a cell's anchors first, then its rows in batches.

    Blocks are dealt by a hash of the id, so they are even, and their numbers follow from the counts. A cell's anchors are
    bounded, its rows stream through. The plan is the same for any number of blocks.
    """
    a_blocks, r_blocks = -(-n_anchors // ANCHORS), -(-n_rows // ROWS)
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_a", block(1, a_blocks)).withColumn("_r", every(r_blocks)).withColumn("kind", F.lit(0))
    right = rows.withColumn("_r", block(2, r_blocks)).withColumn("_a", every(a_blocks)).withColumn("kind", F.lit(1))
    cells = left.unionByName(right, allowMissingColumns=True).withColumn("cell", F.col("_a") * r_blocks + F.col("_r")).drop("_a", "_r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, waiting, state = None, [], None
        for batch in batches:
            for at, part in batch.groupby("cell", sort=False):
                if at != cell:
                    if state is not None:
                        yield state.result()
                    cell, waiting, state = at, [], None
                if (part["kind"] == 0).any():
                    waiting.append(part[part["kind"] == 0])
                part = part[part["kind"] == 1]
                if len(part) and waiting:
                    state = state or work(pd.concat(waiting, ignore_index=True))
                    state.add(part["vec_id"].to_numpy(), part["label"].to_numpy(), _stacked(part["planes"], part["n_bits"].astype(int)))
        if state is not None:
            yield state.result()

    return cells.repartition("cell").sortWithinPartitions("cell", "kind").mapInPandas(run, schema)


class _Positives:
    """Best rows of the anchors' own labels."""

    def __init__(self, anchors: pd.DataFrame, k: int):
        self.anchors = anchors.sort_values("label", kind="stable", ignore_index=True)
        self.labels = self.anchors["label"].to_numpy()
        numbers = whole(list(self.anchors["vector"]))
        self.scorers = {}
        for label in np.unique(self.labels):
            a, z = np.searchsorted(self.labels, [label, label + 1])
            self.scorers[label] = (a, z, Scorer(numbers[a:z]))
        self.ids, self.best = self.anchors["vec_id"].to_numpy(), Best(len(anchors), k)

    def add(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        for label in np.unique(labels):
            if label in self.scorers:
                a, z, scorer = self.scorers[label]
                on = labels == label
                score = scorer.scores(planes[on]).astype(np.int64)
                row, slot = np.nonzero(self.best.beats(score, ids[on], slice(a, z)) & (ids[on][:, None] != self.ids[a:z]))
                self.best.add(slot + a, score[row, slot], ids[on][row])

    def result(self) -> pd.DataFrame:
        at = self.best.slot
        return pd.DataFrame({"vec_id": self.ids[at], "copy": self.anchors["copy"].to_numpy()[at], "positive_id": self.best.id, "positive_score": self.best.score})


class _Negatives:
    """Best rows of other labels within the bounds that each positive sets."""

    def __init__(self, anchors: pd.DataFrame, k: int):
        self.anchors, self.scorer = anchors, Scorer(whole(list(anchors["vector"])))
        self.labels = anchors["label"].to_numpy()
        counts = [len(p) for p in anchors["positives"]]
        self.of = np.repeat(np.arange(len(anchors)), counts)  # the anchor of each slot
        flat = [p for row in anchors["positives"] for p in row]
        self.place = np.array([p["place"] for p in flat], np.int64)
        self.positive = np.array([p["positive_id"] for p in flat], np.int64)
        self.score = np.array([p["positive_score"] for p in flat], np.int64)
        self.low = np.array([-(-FROM * int(s) // OF) for s in self.score], np.int64)
        self.high = np.array([TO * int(s) // OF for s in self.score], np.int64)
        self.best = Best(len(flat), k)

    def add(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        score = self.scorer.scores(planes)
        for at in range(0, len(self.of), TILE):
            of = self.of[at : at + TILE]
            s = score[:, of].astype(np.int64)
            on = (s >= self.low[at : at + TILE]) & (s <= self.high[at : at + TILE]) & (labels[:, None] != self.labels[of])
            row, slot = np.nonzero(on & self.best.beats(s, ids, slice(at, at + TILE)))
            self.best.add(slot + at, s[row, slot], ids[row])

    def result(self) -> pd.DataFrame:
        at = self.best.slot
        of = self.of[at]
        return pd.DataFrame(
            {
                "anchor_id": self.anchors["vec_id"].to_numpy()[of],
                "copy": self.anchors["copy"].to_numpy()[of],
                "place": self.place[at],
                "positive_id": self.positive[at],
                "positive_score": self.score[at],
                "negative_id": self.best.id,
                "negative_score": self.best.score,
            }
        )


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) rows: for each anchor and each of its best rows of
    the same label, the best rows of other labels whose score is FROM to TO percent of the positive's.

    Needs vec_id, label and embedding; other columns are not looked at. Scores are exact inner products of whole numbers, highest first, ties to the
    smaller vec_id, and are held at the limits of a long. All rows are scored by all anchors, in the cells of a grid of blocks: first those
    of the anchors' labels, then the others.

    Rows without vec_id, label or a vector, and with a component that is null or not finite, take no part; nor does an empty vector. Of two
    vectors of different lengths the shorter counts as filled with zeros. Rows that repeat stand for themselves,
    anchors too; rows of an anchor's own vec_id are not its positives. A positive without fitting negatives gives no row, and an empty table none.
    """
    arrow_batches(vectors.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    rows = cut(prepared(vectors.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), label))
    anchors = rows.filter(F.col("vector").isNotNull()).withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "planes")))
    anchors = anchors.select("vec_id", "copy", "label", "vector")
    packed = rows.drop("vector")
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count("vector")).first()
    if not n_anchors:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], empty)

    near = _grid(anchors, packed, n_anchors, n_rows, lambda a: _Positives(a, positives), "vec_id long, copy int, positive_id long, positive_score long")
    first = Window.partitionBy("vec_id", "copy").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    near = near.groupBy("vec_id", "copy").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))  # of `positives` rows
    asking = cut(anchors.join(near, ["vec_id", "copy"]))
    schema = "anchor_id long, copy int, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _grid(asking, packed, n_anchors, n_rows, lambda a: _Negatives(a, negatives), schema)
    first = Window.partitionBy("anchor_id", "copy", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
