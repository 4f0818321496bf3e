"""Secrets in text: three fixed patterns, and high-entropy strings beside them. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract, and the order of kinds in listings.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum")

#: Strings that look random but are known not to be secrets: identifiers in canonical form, alphabets and dummies.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|(?i:example|sample|dummy|placeholder|changeme|redacted)"
    r"|(?i:abcdefgh|qwertyui|01234567|98765432)"
    r"|^[0-9_.=+/-]+$"
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy, in bits a character, of the best window of each class.
LEAST = {"entropy_hex": 3.2, "entropy_alnum": 3.8}
#: Strings of letters of one case and digits alone, which are listed as entropy_alnum too; random keys of 20 characters over 36 or 32 have about 3.8.
LEAST_ONE_CASE = 3.5
#: Strings of letters of both cases without digits; joined words stay below.
LEAST_LETTERS = 3.9
_ONE_CASE = ("0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHABET = {"entropy_hex": "0123456789abcdef", "entropy_alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, needs: Column) -> Column:
    """All leftmost non-overlapping matches as structs (s, e, m); code points, end exclusive.

    Spark has no function for the places of all matches; they follow from the lengths of the matches and of the gaps.
    `needs` is cheap to test and holds for every text with a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    before = lambda x: F.transform(x["m"], lambda _, i: F.get(x["g"], i) + F.when(i > 0, F.length(F.get(x["m"], i - 1))).otherwise(0))

    def spans(x: Column) -> Column:
        return F.transform(x["m"], lambda m, i: F.struct(F.get(x["s"], i).alias("s"), (F.get(x["s"], i) + F.length(m)).alias("e"), m.alias("m")))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    placed = lambda x: _let(F.struct(x["m"].alias("m"), running_sums(before(x)).alias("s")), spans)
    some = _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(F.struct(m.alias("m"), gaps.alias("g")), placed)))
    return F.when(needs, some).otherwise(none)


def running(values: Column, join, block: int = 256) -> Column:
    """Sums, maxima or the like (`join`, which has 0 as its neutral value) of a non-empty array's values up to each place, block by
    block, so that no long array is copied once a value."""

    def walk(x: Column, start: Column) -> Column:
        add = lambda acc, v: _let(join(acc["at"], v), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
        return F.aggregate(x, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        return _let(parts, ends)

    def ends(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: join(acc, v)))
        return _let(walk(totals, F.lit(0)), lambda end: F.flatten(F.transform(b, lambda x, k: walk(x, F.when(k > 0, F.get(end, k - 1)).otherwise(0)))))

    return _let(values, blocks)


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def _outside(spans: Column, base: Column) -> Column:
    """The spans that lie in none of `base`: those that end behind all base spans that start no later. Both are sorted once."""
    event = lambda own: lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x["kind"].alias("kind"))
    events = F.array_sort(F.concat(F.transform(base, event(False)), F.transform(spans, event(True))))

    def kept(v: Column) -> Column:
        reach = running(F.transform(v, lambda x: F.when(x["own"], 0).otherwise(x["e"])), F.greatest)
        return _let(reach, lambda m: F.filter(v, lambda x, i: x["own"] & (F.get(m, i) < x["e"])))

    own = F.transform(_let(events, kept), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(own)


_PACKED, _BITS = 12, 5  # counts in a long integer, and bits of each: a window has fewer than 32 characters


def window_entropy(s: Column, alphabet: str, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any window of `width` characters of s; characters outside the alphabet share one count.

    The walk keeps a count of each character of the alphabet, twelve to a long, and sum(c * log2 c), and changes both by the
    one character that enters and the one that leaves. It is linear in s.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(width + 2)])
    right = lambda value, by: F.call_function("shiftright", value, by)
    place = lambda p: F.struct(F.floor(p / _PACKED).cast("int").alias("j"), (p % _PACKED * _BITS).alias("by"), F.call_function("shiftleft", F.lit(1).cast("long"), p % _PACKED * _BITS).alias("one"))

    def bump(acc: Column, at: Column, sign: int) -> Column:
        count = right(F.get(acc["w"], at["j"]), at["by"]).bitwiseAND(F.lit(31)).cast("int")
        return F.struct(
            F.transform(acc["w"], lambda v, j: F.when(j == at["j"], v + sign * at["one"]).otherwise(v)).alias("w"),
            _let(count, lambda c: acc["f"] - F.get(terms, c) + F.get(terms, c + sign)).alias("f"),
            acc["best"].alias("best"),
        )

    def walk(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            entered = bump(acc, F.get(places, i), 1)
            moved = _let(entered, lambda x: F.when(i < width, x).otherwise(bump(x, F.get(places, i - width), -1)))
            return _let(moved, lambda x: F.struct(x["w"].alias("w"), x["f"].alias("f"), F.when(i + 1 < width, x["best"]).otherwise(F.greatest(x["best"], F.lit(math.log2(width)) - x["f"] / width)).alias("best")))

        words = F.array_repeat(F.lit(0).cast("long"), len(alphabet) // _PACKED + 1)
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), F.struct(words.alias("w"), F.lit(0.0).alias("f"), F.lit(0.0).alias("best")), step)["best"]

    found = F.transform(F.regexp_extract_all(s, F.lit("."), F.lit(0)), lambda c: place(F.instr(F.lit(alphabet), c)))  # 0: outside
    return _let(found, walk)


def _entropy_spans(text: Column) -> Column:
    """Candidate strings whose best window is as random as keys are, by character class."""

    def judged(x: Column) -> Column:
        m = x["m"]
        is_hex = m.rlike(r"^[0-9a-fA-F]+$") & m.rlike(r"[0-9]")
        lower, upper = m.rlike(r"^[0-9a-z]+$") & m.rlike(r"[0-9]"), m.rlike(r"^[0-9A-Z]+$") & m.rlike(r"[0-9]")
        mixed = m.rlike(r"[a-z]") & m.rlike(r"[A-Z]")
        entropy = F.when(is_hex, window_entropy(F.lower(m), _ALPHABET["entropy_hex"])).when(lower, window_entropy(m, _ONE_CASE[0])).when(upper, window_entropy(m, _ONE_CASE[1])).when(mixed, window_entropy(m, _ALPHABET["entropy_alnum"])).otherwise(F.lit(0.0))
        least = F.when(is_hex, LEAST["entropy_hex"]).when(lower | upper, LEAST_ONE_CASE).when(m.rlike(r"[0-9]"), LEAST["entropy_alnum"]).otherwise(LEAST_LETTERS)
        return _let(
            F.struct(F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_alnum")).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), entropy.alias("h"), least.alias("least")),
            lambda y: F.when(y["h"] >= y["least"] - 1e-9, F.struct(y["kind"].alias("kind"), y["s"].alias("s"), y["e"].alias("e"))),
        )

    judgeable = lambda m: ~m.rlike(ALLOWED) & m.rlike(r"[0-9]|[a-z].*[A-Z].*[A-Z]")
    return F.array_compact(F.transform(F.filter(_matches(text, CANDIDATE, F.length(text) >= WINDOW), lambda x: judgeable(x["m"])), judged))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns `base` and `spans` to df: arrays of (kind, s, e) by start, then kind as listed in KINDS.

    `base` holds what the three patterns find: an assignment with a value of 12 characters or more, an access key of
    18 or more, lower-case hexadecimal of 16 or more. `spans` adds candidate strings whose sliding-window entropy is
    high for their class (hexadecimal; letters of one case and digits; letters of both cases, with digits and other marks or
    without), unless they are allow-listed or lie inside a base span. Letters of one case alone are never judged, as
    words would be found. A null text counts as empty and has no spans; equal texts have equal ones. The work is linear
    in a text, however long a candidate or however many matches it has. Columns named base and spans are replaced, all
    others stay, whatever their names; nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda m: F.length(m) - F.length(F.regexp_extract(m, ASSIGN_HEAD, 0))
    named = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    assign = named("assign", F.filter(_matches(t, ASSIGN, F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))), lambda x: value(x["m"]) >= 12))
    base = F.concat(assign, named("access", _matches(t, ACCESS, F.contains(t, F.lit("AKIA")))), named("hex", _matches(t, HEX, F.length(t) >= 16)))
    rank = lambda x: F.element_at(F.create_map(*[y for i, k in enumerate(KINDS) for y in (F.lit(k), F.lit(i))]), x["kind"])
    ordered = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["s"].alias("s"), rank(x).alias("r"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    random = "_random"
    while random in df.columns:
        random += "_"
    out = df.withColumn("base", ordered(base)).withColumn(random, _entropy_spans(t))
    return out.withColumn("spans", ordered(F.concat("base", _outside(F.col(random), F.col("base"))))).drop(random)


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


_BLOCK = 1024  # code points of a text's blocks, from which the pieces between spans are cut


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the spans (by start) cover, overlapping ones as one, by `mark`; texts without spans stay as they are.

    Texts are cut into blocks once, and each piece between spans is taken from its blocks, so that the work is linear in a
    text and its spans."""
    t = F.col(text)

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(part, start - first * _BLOCK + 1, end - start)).otherwise("")

    def done(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["m"], i - 1)).otherwise(0)
        pieces = F.transform(x["v"], lambda v, i: F.when(v["s"] >= before(i), F.concat(piece(x["b"], before(i), v["s"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), piece(x["b"], F.element_at(x["m"], -1), F.length(t)))

    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda v: v["e"]), F.greatest)
    whole = _let(F.struct(F.col(spans).alias("v"), reach.alias("m"), blocks.alias("b")), done)
    return df.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(t))
