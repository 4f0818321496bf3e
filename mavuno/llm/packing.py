"""Packing of documents into training sequences whose mixture of sources is controlled, by deficit round-robin."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, joined

WINDOW, END = 2048, 1  # tokens of a sequence; the id that ends a document
PACKET = 128  # tokens that a source sends at once at least, unless a document ends before
LANE, MOST_LANES = 1 << 20, 1 << 18  # tokens that a task packs; beyond 275 billion tokens lanes grow, as they are streamed
MOST_QUEUES = 1024  # sources with a queue of their own, the most frequent ones; the others share one
_AT_ONCE = 1 << 20  # characters that are encoded at a time
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: the pre-tokenizer of byte-level BPE files
_STABLE = regex.compile(r"[^\W_](?=[ \n])")  # every match of the pattern ends behind it, whatever stands around


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE file, once per worker process. Strings of special tokens in a text are ordinary text."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    if model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"] or model["model"]["type"] != "BPE":
        raise ValueError(f"{os.path.basename(path)} is no plain byte-level BPE")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]  # bytes that stand for themselves
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, known: tiktoken.Encoding) -> np.ndarray:
    """Ids of a whole text, which is encoded in parts where it is very long."""
    if len(text) <= _AT_ONCE:
        return np.array(known.encode_ordinary(text), "<u4")
    parts, at = [], 0
    while at < len(text):
        stop = _STABLE.search(text, at + _AT_ONCE)
        end = stop.end() if stop else len(text)
        parts.append(np.array(known.encode_ordinary(text[at:end]), "<u4"))
        at = end
    return np.concatenate(parts)


def phases(totals: list[int], weights: list[float] | None) -> np.ndarray:
    """How many tokens of each queue have been sent at the end of each phase, a row for each. In a phase the queues that are
    left send in proportion to their weights, and it ends when one of them runs dry; queues without a weight come last. Without weights every
    queue sends in proportion to its total, in one phase."""
    if not weights or not any(w > 0 and t for w, t in zip(weights, totals, strict=True)):
        return np.array([totals], np.int64)
    until = sorted({t / w for t, w in zip(totals, weights, strict=True) if w > 0 and t})
    rows = [[min(t, round(w * x)) if w > 0 else 0 for t, w in zip(totals, weights, strict=True)] for x in until]
    for row in rows[-1:]:
        row[:] = [t if w > 0 else 0 for t, w in zip(totals, weights, strict=True)]
    rows.append(list(totals))
    out = np.unique(np.maximum.accumulate(np.array(rows, np.int64), axis=0), axis=0)
    sizes = np.diff(out.sum(axis=1), prepend=0)
    return out[(sizes >= WINDOW) | (np.arange(len(out)) == len(out) - 1)]


class Lanes:
    """Which share of every queue a task packs. Lane j of a phase of n takes from a queue with t tokens in that phase those from
    t * j // n up to t * (j + 1) // n: what a lane falls short of its share, the next ones make up."""

    def __init__(self, ends: np.ndarray, lane: int, most: int):
        self.ends = ends
        self.begins = np.vstack([np.zeros((1, ends.shape[1]), np.int64), ends[:-1]])
        sizes = (ends - self.begins).sum(axis=1)
        lane = max(lane, -(-int(sizes.sum()) // most))
        self.lanes = np.maximum(1, sizes // lane)
        self.first = np.cumsum(self.lanes) - self.lanes  # a phase's first lane
        self.sequences = np.cumsum([0, *(self._count(j) for j in range(int(self.lanes.sum())))])

    def _phase(self, lane: int) -> int:
        return int(np.searchsorted(self.first, lane, "right")) - 1

    def shares(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each queue's share of the lane starts, how many tokens it has)."""
        k = self._phase(lane)
        size, n, j = self.ends[k] - self.begins[k], int(self.lanes[k]), lane - int(self.first[k])
        return self.begins[k] + size * j // n, size * (j + 1) // n - size * j // n

    def _count(self, lane: int) -> int:
        whole, rest = divmod(int(self.shares(lane)[1].sum()), WINDOW)
        return whole + rest.bit_count()

    def of(self, queue: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(lane, begin, end) of the parts of a span of a queue's tokens."""
        while begin < end:
            k = int(np.searchsorted(self.ends[:, queue], begin, "right"))
            low, n = int(self.begins[k, queue]), int(self.lanes[k])
            size = int(self.ends[k, queue]) - low
            j = ((begin - low + 1) * n - 1) // size
            stop = min(end, low + size * (j + 1) // n)
            yield int(self.first[k]) + j, begin, stop
            begin = stop


class _Queue:
    def __init__(self, number: int, share: int):
        self.number, self.share, self.left, self.credit = number, share, share, 0
        self.rows: deque[list] = deque()  # [doc_id, start in the document, its tokens, bytes of the ids, tokens gone]


def round_robin(shares: np.ndarray, rows: Iterator[tuple], packet: int = PACKET, window: int = WINDOW) -> Iterator[tuple]:
    """(sequence, offset, doc_id, start, doc_tokens, ids) pieces of one lane, sequences numbered from 0.

    For each sequence a queue is credited its share of the tokens, in whole fractions of the lane's total, and sends documents while the credit
    covers `packet` tokens or the rest of a document; what is left over is carried to the next sequence. Room that
    is left goes to the queue with most credit, which then owes. Sequences are full; the last tokens make up
    sequences of powers of two. `rows` are (queue, doc_id, start, doc_tokens, ids) in the order of their places in the queues' shares, so that few wait.
    """
    queues = {q: _Queue(q, int(s)) for q, s in enumerate(shares.tolist()) if s}
    ring, total = list(queues.values()), int(shares.sum())
    left, sequence = total, 0

    def head(queue: _Queue) -> list:
        while not queue.rows:
            q, doc_id, start, n, ids = next(rows)
            queues[q].rows.append([doc_id, start, n, ids, 0])
        return queue.rows[0]

    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        room = size
        last = None  # a piece that may grow

        def send(queue: _Queue, row: list, take: int) -> Iterator[tuple]:
            nonlocal room, last
            begin = row[4]
            row[4] += take
            queue.left -= take
            queue.credit -= take * total
            if last is not None and last[0] is row:
                last[2] += take
            else:
                if last is not None:
                    yield piece()
                last = [row, begin, take, size - room]
            room -= take
            if 4 * row[4] == len(row[3]):
                queue.rows.popleft()

        def piece() -> tuple:
            row, begin, n, offset = last
            return sequence, offset, row[0], row[1] + begin, row[2], row[3][4 * begin : 4 * (begin + n)]

        for queue in ring:
            queue.credit += size * queue.share
        for queue in ring:
            while room and queue.left:
                can = queue.credit // total
                if can < 1:
                    break
                row = head(queue)
                rest = len(row[3]) // 4 - row[4]
                if can < min(packet, rest):
                    break
                yield from send(queue, row, min(can, room, rest))
        while room:
            queue = max((q for q in ring if q.left), key=lambda q: q.credit)
            row = head(queue)
            yield from send(queue, row, min(packet, room, len(row[3]) // 4 - row[4]))
        yield piece()
        left -= size
        sequence += 1
        ring.append(ring.pop(0))  # the next sequence starts with another queue
        ring = [q for q in ring if q.left]


def pack(docs: DataFrame, path: str, weights: dict[str | None, float] | None = None, lane: int = LANE, packet: int = PACKET, most_queues: int = MOST_QUEUES) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, source) pieces: all documents, each ended by END, cut into
    sequences of WINDOW tokens that all hold the sources in the target proportions.

    Needs doc_id, text and source; other columns are not looked at. `ids` are little-endian unsigned 32-bit numbers. The targets are each source's share of
    all tokens, so that no source runs dry before the others; `weights` sets others, which hold until a source runs dry, when the rest share its place
    by their weights. Each sequence is within about one packet of the target for each source, and the difference is carried on.

    Every source is a queue of documents in the order of the table's partitions. A document's place in its queue
    is the sum of what comes before it: within its task, and of the tasks before. Lanes take an equal share of every queue,
    cutting documents at their borders, and each is packed by a task that streams its rows in order of their places.
    No sequence is padded: a lane's last tokens make up sequences of powers of two.

    Null and empty texts are END alone; a null source is a queue like others; rows that repeat, and a null doc_id, are packed as any other;
    long texts are encoded whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string"))
    known = [r["source"] for r in docs.groupBy("source").count().orderBy(F.desc("count"), "source").limit(most_queues).collect()]
    names = sorted((s for s in known if s is not None), key=str) + [None] * (None in known)
    number = {s: i for i, s in enumerate(names)}
    others = len(names)  # the queue of sources beyond the most frequent

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, part, sums = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = [number.get(s, others) for s in batch["source"]]
            ids = [np.append(token_ids(t, encoding), np.uint32(END)) for t in batch["text"]]
            before = []
            for q, x in zip(queues, ids, strict=True):
                before.append(sums.get(q, 0))
                sums[q] = before[-1] + len(x)
            short = encoding.n_vocab <= 1 << 16
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "source": batch["source"],
                    "queue": queues,
                    "part": part,
                    "before": before,
                    "n": [len(x) for x in ids],
                    "ids": [x.astype("<u2" if short else "<u4").tobytes() for x in ids],
                }
            )

    encoded = cut(docs.mapInPandas(tokens, "doc_id long, source string, queue int, part int, before long, n long, ids binary"))
    sums = encoded.groupBy("queue", "part").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sums = sums.withColumn("offset", F.sum("tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("tokens"))  # a row for each task
    totals = [0] * (others + 1)
    for r in sums.groupBy("queue").agg(F.sum("tokens").alias("n")).collect():  # a row for each queue
        totals[r["queue"]] = r["n"]
    lanes = Lanes(phases(totals, [weights.get(s, 0.0) for s in names] + [0.0] if weights else None), lane, MOST_LANES)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                begin = int(row.offset + row.before)
                wide = len(row.ids) // row.n
                for j, a, z in lanes.of(row.queue, begin, begin + row.n):
                    starts, sizes = lanes.shares(j)
                    place = (a - int(starts[row.queue])) / int(sizes[row.queue])
                    out.append((j, place, row.queue, row.doc_id, row.source, a - begin, row.n, row.ids[(a - begin) * wide : (z - begin) * wide]))
            yield pd.DataFrame(out, columns=["lane", "place", "queue", "doc_id", "source", "start", "doc_tokens", "ids"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = "<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4"
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        held: list = []  # the first row of the next lane

        def lane_rows(j: int) -> Iterator[tuple]:
            for row in rows:
                if row.lane != j:
                    held.append(row)
                    return
                yield row.queue, (row.doc_id, row.source), row.start, row.doc_tokens, np.frombuffer(row.ids, wide).astype("<u4").tobytes()

        while True:
            first = held.pop() if held else next(rows, None)
            if first is None:
                return
            j, out, size = int(first.lane), [], 0
            own = (first.queue, (first.doc_id, first.source), first.start, first.doc_tokens, np.frombuffer(first.ids, wide).astype("<u4").tobytes())
            found = lane_rows(j)
            base = int(lanes.sequences[j])
            for sequence, offset, (doc_id, source), start, doc_tokens, ids in round_robin(lanes.shares(j)[1], _chained(own, found), packet):
                out.append((doc_id, start, len(ids) // 4, ids, doc_tokens, base + sequence, offset, source))
                size += len(ids)
                if size >= 1 << 22:
                    yield _pieces(out)
                    out, size = [], 0
            yield _pieces(out)
            for _ in found:  # nothing is left but the first row of the next lane
                raise RuntimeError("a lane has more rows than tokens")

    placed = joined(encoded, sums.select("queue", "part", "offset", "rows"), ["queue", "part"], "rows", keep=False)
    dealt = placed.select("doc_id", "source", "queue", "before", "n", "ids", "offset").mapInPandas(
        deal, "lane int, place double, queue int, doc_id long, source string, start long, doc_tokens long, ids binary"
    )
    return dealt.repartition("lane").sortWithinPartitions("lane", "place", "queue", "doc_id").mapInPandas(
        fill, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"
    )


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _pieces(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"])
    return frame.astype({"doc_id": "Int64"})


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) rows: the ids of each sequence in order, of at most WINDOW tokens. Lengths are WINDOW or a lesser power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one sequence
    whole = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
