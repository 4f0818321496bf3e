"""Where many terms stand in many texts, as substrings, by Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import dealt, every, meet

FEW, FEW_CHARS = 50_000, 4_000_000  # terms that are sent to every task
BLOCK, TEXTS = 200_000, 4096  # terms and texts of a cell beyond that


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(term, i)
    out.make_automaton()
    return out


class _Finder:
    """Occurrences of a set of terms in the texts of batches."""

    def __init__(self, terms: list[str], fields: list[str], kept: list[str]):
        self.terms, self.fields, self.kept = terms, fields, kept
        self.automaton = _automaton(terms)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, found, counts = [], [], [[] for _ in self.fields]
        texts = [batch.column(f).to_pylist() for f in self.fields]
        for i in range(batch.num_rows):
            met: dict[int, list[int]] = {}
            for f, column in enumerate(texts):
                ends: dict[int, int] = {}
                for end, t in self.automaton.iter(column[i] or ""):
                    start = end + 1 - len(self.terms[t])
                    if start >= ends.get(t, 0):  # occurrences of a term that do not overlap, from the left
                        ends[t] = end + 1
                        met.setdefault(t, [0] * len(self.fields))[f] += 1
            for t, n in met.items():
                row.append(i)
                found.append(self.terms[t])
                for f, c in enumerate(n):
                    counts[f].append(c)
        if row:
            at = pa.array(row, pa.int64())
            columns = [*[batch.column(c).take(at) for c in self.kept], pa.array(found, pa.string()), *[pa.array(c, pa.int64()) for c in counts]]
            yield from pa.table(columns, [*self.kept, "term", *[f"n{f}" for f in self.fields]]).to_batches(max_chunksize=16_384)

    def result(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def occurrences(texts: DataFrame, fields: list[str], terms: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(id, ..., term, n<field>, ...): how often each of `terms` (a column `term`) stands in each field of a text without
    overlapping itself, for the pairs where it stands anywhere. Columns besides the fields are kept.

    Terms that are few, by their count and size, are sent to every task, and texts stay where they lie. Beyond that, blocks
    of terms and blocks of texts meet in the cells of a grid. A text is read once for each block of terms, whatever their
    number, and no pair without an occurrence is made. Null fields hold nothing, and so does an empty term.
    """
    spark = texts.sparkSession
    wanted = terms.select("term").filter("term <> ''").distinct()
    kept = [c for c in texts.columns if c not in fields]
    types = dict(texts.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], "term string", *[f"n{f} long" for f in fields]])
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n <= few and size <= FEW_CHARS:
        sent = spark.sparkContext.broadcast([r["term"] for r in wanted.collect()])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not sent.value:
                return
            finder = _Finder(sent.value, fields, kept)
            for batch in batches:
                yield from finder.add(batch)

        return texts.mapInArrow(work, schema)
    t_blocks, x_blocks = -(-n // block), max(1, -(-texts.count() // TEXTS))
    cell = F.col("_t") * x_blocks + F.col("_x")
    left = wanted.withColumn("_t", dealt("term", t_blocks)).withColumn("_x", every(x_blocks)).select(cell.alias("cell"), F.col("term").alias("_term"))
    right = texts.withColumn("_x", F.pmod(F.xxhash64(*texts.columns), F.lit(x_blocks))).withColumn("_t", every(t_blocks)).withColumn("cell", cell).drop("_t", "_x")
    make: Callable[[pa.Table], _Finder] = lambda held: _Finder(held.column("_term").to_pylist(), fields, kept)
    return meet(left, right, make, schema)
