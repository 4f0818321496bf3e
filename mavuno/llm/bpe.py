"""Byte-level BPE encoding and decoding of whole texts, by a tree of halves."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

LEAF = 512  # characters below which a range is not halved, and ids that are decoded at once
CACHED = 1 << 18  # ids of so many matches of at most 64 characters are kept by a worker
SETTLED = 256  # parts up to which a window inside one match grows on a side
AT_ONCE = 1 << 19  # ids that a worker holds before it passes them on; Python's integers take about 36 bytes each


def joined_pairs(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that are left of raw: of all neighbours the pair of least rank is joined, the first of equal ones, until no
    pair has a rank. From 33 bytes on a heap of pairs makes that n log n."""
    n = len(raw)
    if n <= 32:
        none, get, last = len(ranks) + 1, ranks.get, n - 2
        parts = [raw[i : i + 1] for i in range(n)]
        pairs = [get(raw[i : i + 2], none) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            part = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < last:
                pairs[i] = get(part + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + part, none)
            last -= 1
        return parts
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue  # one of the two has been joined to another part since
        alive[j] = False
        end[i], before[e] = e, i
        for a in (i, before[i]):
            if a >= 0 and end[a] < n and (r := ranks.get(raw[a : end[end[a]]])) is not None:
                heappush(heap, (r, a, end[end[a]]))
    out, i = [], 0
    while i < n:
        out.append(raw[i : end[i]])
        i = end[i]
    return out


def tree_parts(raw: bytes, ranks: dict[bytes, int], leaf: int = LEAF) -> list[bytes] | None:
    """What `joined_pairs` gives, by a tree of halves; None if a border does not settle within SETTLED parts.

    At a border a window of parts on either side is joined anew. What lies outside of it is proven to stay once the window's
    first and last part stand beside their outer neighbours, that is, if joining the bytes of the two gives these two parts again: a
    list of parts is the result for its bytes if, and only if, this holds for each two neighbours. For before the first join
    across a border between parts, the bytes of the two parts beside it are joined in the order in which they would be joined alone, and the
    pair across the border would be the least there, too. Until then the window grows on the side that does not stand.
    """
    if len(raw) <= leaf:
        return joined_pairs(raw, ranks)
    half = len(raw) // 2
    left = tree_parts(raw[:half], ranks, leaf)
    right = tree_parts(raw[half:], ranks, leaf) if left else None
    if not left or not right:
        return None
    i = j = 1
    while True:
        window = joined_pairs(b"".join(left[-i:] + right[:j]), ranks)
        before = i == len(left) or joined_pairs(left[-i - 1] + window[0], ranks) == [left[-i - 1], window[0]]
        after = j == len(right) or joined_pairs(window[-1] + right[j], ranks) == [window[-1], right[j]]
        if before and after:
            return left[:-i] + window + right[j:]
        if max(0 if before else i, 0 if after else j) >= SETTLED:
            return None
        i, j = i if before else min(2 * i, len(left)), j if after else min(2 * j, len(right))


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern. A long match whose borders do not settle, such as one letter repeated, is joined in one piece."""
    if raw in ranks:
        return [ranks[raw]]
    parts = joined_pairs(raw, ranks) if len(raw) <= LEAF else tree_parts(raw, ranks) or joined_pairs(raw, ranks)
    return [ranks[x] for x in parts]


class _Matches(dict):
    """The ids of each match of the pattern that was met lately."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, match: str) -> list[int]:
        ids = merged(match.encode(), self.ranks)
        if len(match) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[match] = ids
        return ids


@dataclass(frozen=True)
class Vocabulary:
    encode: Callable[[str], list[int]]  # of a range at once: every match of the pattern by itself
    tokens: list[bytes]
    lengths: list[int]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Once per worker process. The rank file is read where it lies and never copied."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    split, matches = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall, _Matches(ranks)
    return Vocabulary(lambda text: list(chain.from_iterable(map(matches.__getitem__, split(text)))), tokens, [len(t) for t in tokens])


_STABLE = regex.compile(r"\S(?= )|\p{L}(?=[^\p{L}\p{M}'’])|\p{N}(?=[^\p{N}\p{M}])")


def _stable_near(text: str, start: int, middle: int, end: int) -> tuple[int, int]:
    """The last stable place up to `middle` and the first one from it, or start and end.

    A place is stable if a blank follows something else there, or a run of letters or of digits ends, but not before a mark or an
    apostrophe: every match of the pattern ends there, whatever stands around. No alternative holds a blank after
    another character, or anything but letters after a letter, or but digits after a digit, so no match crosses it; none looks back,
    so what follows depends on the rest alone; and what stands before it ends with a match that cannot be longer. The search
    before `middle` grows by doubling.
    """
    after = _STABLE.search(text, max(start, middle - 1), end)
    b = after.end() if after and after.end() < end else end
    if b == middle:
        return b, b
    width = 64
    while True:
        low = max(start, middle - width)
        a = max((m.end() for m in _STABLE.finditer(text, low, middle) if m.end() < middle), default=start)
        if a > start or low == start:
            return a, b
        width *= 2


def encode_tree(text: str, start: int, end: int, encode: Callable[[str], list[int]], lengths: list[int], leaf: int = LEAF) -> list[int]:
    """Ids of text[start:end], equal to those of encoding it in one go.

    Halves are encoded by themselves. At their border a window is encoded anew; it grows on either side until it
    reaches a stable place or the end of that half, beyond which no id can change. A range without any stable place, mostly
    a single match, is not halved here: long matches have a tree of their own (`tree_parts`).
    """
    if end - start <= leaf or not _STABLE.search(text, start, end):
        return encode(text[start:end])
    middle = (start + end) // 2
    middle = max(middle, text.find(" ", middle, min(end, middle + 64)))  # few words are cut
    left = encode_tree(text, start, middle, encode, lengths, leaf)
    right = encode_tree(text, middle, end, encode, lengths, leaf)
    a, b = _stable_near(text, start, middle, end)
    if a == b:
        return left + right
    drop, kept = len(text[a:middle].encode()), len(left)
    while drop > 0:
        kept -= 1
        drop -= lengths[left[kept]]
    drop, first = len(text[middle:b].encode()), 0
    while drop > 0:
        drop -= lengths[right[first]]
        first += 1
    return left[:kept] + encode(text[a:b]) + right[first:]


def decode_tree(ids: list[int], tokens: list[bytes], leaf: int = LEAF) -> bytes:
    """The bytes of ids, concatenated up a tree of halves."""
    if len(ids) <= leaf:
        return b"".join([tokens[i] for i in ids])
    half = len(ids) // 2
    return decode_tree(ids[:half], tokens, leaf) + decode_tree(ids[half:], tokens, leaf)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """Add `ids`, the token ids of each whole text, to df; null counts as the empty text, which has no ids.

    With `decoded` a column of that name gets the bytes that the ids decode to, in the same pass; without `keep_text` the
    text is left out of the result. Any other column stays, unless it is named like a new one, which replaces it.
    Nothing is shuffled, and a worker holds about AT_ONCE ids or one text's. Repeated texts get equal ids; a text of
    any length, unbroken ones too, is encoded in n log n.
    """
    arrow_batches(df.sparkSession)
    new = [ids, *([decoded] if decoded else [])]
    df = df.drop(*new).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    kept = [c for c in df.columns if keep_text or c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for batch in batches:
            out, back, held, since = [], [], 0, 0
            for row, t in enumerate(batch.column(text).to_pylist(), 1):
                found = encode_tree(t, 0, len(t), known.encode, known.lengths)
                out.append(pa.array(found, pa.int32()))
                held += len(found)
                if decoded:
                    back.append(decode_tree(found, known.tokens))
                if held >= AT_ONCE or row == batch.num_rows:
                    sizes = pa.array([0, *map(len, out)], pa.int32())
                    lists = pa.ListArray.from_arrays(pa.compute.cumulative_sum(sizes), pa.concat_arrays(out))
                    columns = [*[batch.column(c).slice(since, row - since) for c in kept], lists, *([pa.array(back, pa.binary())] if decoded else [])]
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *new])
                    out, back, held, since = [], [], 0, row

    made = df.select(*kept).withColumn(ids, F.lit(None).cast("array<int>"))
    return df.mapInArrow(work, (made.withColumn(decoded, F.lit(None).cast("binary")) if decoded else made).schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add `decoded`, the bytes that `ids` stand for, to df; null counts as no ids. An unknown id fails the job."""
    arrow_batches(df.sparkSession)
    df = df.drop(decoded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path, pattern).tokens
        for batch in batches:
            out = [decode_tree(x or [], tokens) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, decoded])

    return df.mapInArrow(work, df.withColumn(decoded, F.lit(None).cast("binary")).schema)
