"""Texts as ordered lines: blocks that start at some lines, within a text without a shuffle or across the pages of a book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .ordered import counted

_HEAD, _BODY = "\u0001", "\u0002"
Mark = Callable[[Column], Column]


def sections(lines: Column, is_head: Mark, head: Mark | None = None) -> Column:
    """Blocks of an array of lines as structs (head, body), in order; what stands before the first head has a null head.

    Heads are marked in place and the joined text is split at the marks, so a text never leaves its row. `head` may
    give the text after the head on its own line by returning `head STX rest`; by default the whole line is the head.
    """
    put = head or (lambda x: F.concat(x, F.lit(_BODY)))
    return _cut(F.transform(lines, lambda x: F.when(is_head(x), F.concat(F.lit(_HEAD), put(x))).otherwise(x)))


def labelled(lines: Column, key: Mark, rest: Mark) -> Column:
    """As `sections`, where `key` names the block that a line starts, null for other lines, and is computed once a line."""

    def mark(x: Column) -> Column:
        return F.element_at(F.transform(F.array(key(x)), lambda k: F.when(k.isNotNull(), F.concat(F.lit(_HEAD), label_then_text(k, rest(x)))).otherwise(x)), 1)

    return _cut(F.transform(lines, mark))


def _cut(marked: Column) -> Column:
    parts = F.split(F.array_join(marked, "\n"), _HEAD)
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(i > 0, F.substring_index(p, _BODY, 1)).alias("head"),
            strip(F.when(i > 0, F.substring_index(p, _BODY, -1)).otherwise(p)).alias("body"),
        ),
    )


def label_then_text(label: Column, rest: Column) -> Column:
    """For the `head` of sections: a label, and what stands behind it on its line."""
    return F.concat(label, F.lit(_BODY), rest)


def blocks(lines: DataFrame, text: list[str], order: list[str], starts: Column, into: str = "block") -> DataFrame:
    """Number the blocks of each text: 0 before the first start. A text of any size is dealt over ranges of its lines."""
    return counted(lines, text, order, starts, into)


def parts_at(lines: Column, is_head: Mark) -> Column:
    """Blocks of an array of lines as structs (head, lines), in order; the first has a null head and may have no lines. They are
    cut at the places of the heads, so nothing is put into the text; each line is tested once."""

    def parts(l: Column, starts: Column) -> Column:
        rest = lambda at, k: F.slice(l, at + 2, F.coalesce(F.get(starts, k + 1), F.size(l)) - at - 1)
        return F.transform(starts, lambda at, k: F.struct(F.get(l, at).alias("head"), rest(at, k).alias("lines")))

    def places(l: Column) -> Column:
        return F.concat(F.array(F.lit(-1)), F.filter(F.transform(l, lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull()))

    return let(lines, lambda l: let(places(l), lambda starts: parts(l, starts)))


def put_together(parts: DataFrame, keys: list[str], order: list[str], lines: str = "lines") -> DataFrame:
    """The arrays of lines of each group of keys as one text `body`, in order; null lines are left out, groups without lines go."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(lines).alias("_lines"))))
    return parts.filter(F.size(lines) > 0).groupBy(*keys).agg(F.array_join(F.flatten(F.transform(ordered, lambda x: x["_lines"])), "\n").alias("body"))
