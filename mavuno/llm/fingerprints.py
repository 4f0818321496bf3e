"""Document fingerprints of closed syncmers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges
from .secret_scan import _let

#: Words: runs of letters, digits and marks; of scripts written without spaces each character is a word.
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+"
K, S = 5, 2


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a whole text in order, each as hash * 2^20 + its place: a 32-bit hash and the number of its first
    word, modulo 2^20.

    The alphabet is words. A k-mer is a closed syncmer if the least hash of its inner s-mers is that of its first or
    its last s-mer. The choice depends on the k words alone, so whatever an edit leaves alone keeps its anchors.
    A text of fewer than k words gives one k-mer of all its words; one without words, one of the whole string; an
    empty or null text gives none.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    placed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), PLACE_BITS).bitwiseOR((i % (1 << PLACE_BITS)).cast("long"))

    def pick(x: Column) -> Column:
        h, inner = x["h"], x["inner"]
        last = k - s

        def choose(first: Column, i: Column) -> Column:
            others = [F.get(inner, i + j) for j in range(1, last + 1)]
            return F.when(F.least(first, *others).isin(first, others[-1]), placed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))

        return F.array_compact(F.transform(F.slice(inner, 1, F.size(inner) - last), choose))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    with_inner = _let(
        hashes,
        lambda h: F.struct(h.alias("h"), F.when(F.size(h) >= k, F.transform(F.slice(h, 1, F.size(h) - (s - 1)), lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))).alias("inner")),
    )
    one = lambda *x: F.array(placed(F.xxhash64(*x), F.lit(0)))
    short = lambda x: F.when(F.size(x["h"]) > 0, one(x["h"])).when(t != "", one(t)).otherwise(F.array().cast("array<bigint>"))
    return _let(with_inner, lambda x: F.when(F.size(x["h"]) >= k, pick(x)).otherwise(short(x)))


PLACE_BITS = 20


def links(found: Column) -> Column:
    """What two texts are matched by: each anchor together with the next one and the number of words between them; the last
    anchor stands alone. A link is there wherever the same two anchors stand at the same distance, so matching is by
    relative place: moved texts match, shuffled words do not."""
    mask = F.lit((1 << PLACE_BITS) - 1)

    def link(x: Column, i: Column) -> Column:
        following = F.get(found, i + 1)
        gap = (following - x).bitwiseAND(mask)
        return F.xxhash64(F.shiftright(x, PLACE_BITS), F.shiftright(following, PLACE_BITS), gap)  # nulls are left out of a hash

    return F.transform(found, link)


def as_text(found: Column) -> Column:
    """Of each anchor eight hexadecimal digits and, after the first one, the distance from the one before: abcdef01+3.01234567"""

    def said(x: Column, i: Column) -> Column:
        digits = F.lpad(F.hex(F.shiftright(x, PLACE_BITS)), 8, "0")
        return F.when(i == 0, digits).otherwise(F.concat(F.lit("+"), (x - F.get(found, i - 1)).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("string"), F.lit("."), digits))

    return F.array_join(F.transform(found, said), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the links of two texts that both have, exactly, over all links of both; 1 for two texts without any."""
    both = F.size(F.array_intersect(a, b))
    each = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(each == 0, F.lit(1.0)).otherwise(both / (each - both))


def chained(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited text, whose last quarter is replaced by the start of the next document.

    A fingerprint is the whole list of a text's anchors with their distances, however long the text. The order is
    ascending doc_id, after the last the first; repeated ids are ordered by their text. A row without a doc_id has no
    place in the order: its edited text just loses the last quarter, and its likeness to the next is 0. Null texts count
    as empty; equal texts have equal fingerprints. Other columns are left out.

    The table is dealt once, into doc_id ranges. A cut is an id that occurs, so the row that starts a range is known
    beforehand and is also dealt, as a guest, into the range before it: no range looks into another, and no task
    holds more than a range. Rows that share one id are not split.
    """
    cuts = ranges(docs, "doc_id")
    last = len(cuts.cuts)
    t = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select("doc_id", t.alias("text"), F.length(t).cast("long").alias("n_chars"))
    number = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(256))).otherwise(cuts.number(F.col("doc_id"))).cast("int")
    place = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    also = []
    if cuts.cuts:
        starts = F.coalesce(cuts.number(F.col("doc_id")) > cuts.number(F.try_subtract("doc_id", F.lit(1))), F.lit(False))
        also.append(F.when(starts, place(F.col("_number") - 1, True)))
    if cuts.first is not None:
        also.append(F.when(F.col("doc_id") == cuts.first, place(F.lit(last), True)))
    dealt = lean.withColumn("_number", number).withColumn("_place", F.explode(F.array_compact(F.array(place(F.col("_number"), False), *also))))
    dealt = dealt.select("doc_id", "text", "n_chars", "_place.*")
    near = Window.partitionBy("range").orderBy("guest", "doc_id", "n_chars", F.xxhash64("text"))
    dealt = dealt.withColumn("_wanted", F.floor(F.lag("n_chars").over(near) / 4).cast("int"))
    dealt = dealt.withColumn("_given", F.expr("left(text, coalesce(_wanted, 0))")).withColumn("_own", anchors(F.col("text")))
    dealt = dealt.withColumn("_links", links(F.col("_own")))
    linked = F.col("doc_id").isNotNull()
    dealt = dealt.withColumn("_taken", F.when(linked, F.lead("_given").over(near))).withColumn("_next", F.when(linked, F.lead("_links").over(near)))
    dealt = dealt.filter(~F.col("guest")).withColumn("_edited", F.concat(F.expr("left(text, int(n_chars - n_chars div 4))"), F.coalesce("_taken", F.lit(""))))
    dealt = dealt.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_own", "_links", anchors(F.col("_edited")).alias("_other"), "_next")
    return dealt.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_links"), links(F.col("_other"))).alias("near_edited"),
        F.coalesce(likeness(F.col("_links"), F.col("_next")), F.lit(0.0)).alias("near_next"),
    )
