"""Fingerprints, secret scans and shards against plain Python."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from mavuno.llm import fingerprints, secret_scan, shards
from mavuno.llm.common import ranges

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 20] for i in range(4000))
TEXTS = {3: "one two", 1: "", 7: None, 2: "abc déf " * 40, 9: "abc déf " * 40, 12: LONG, 13: LONG + " more", 20: "!!!", 30: "中文字符没有空格", 31: "x" * 5000}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "src", 1.0, ["clash"], 5, 0) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, spans array<string>, size long, range long").repartition(5)


def edited(rows):
    out, order = {}, sorted(rows)
    for i, k in enumerate(order):
        t, nxt = rows[k] or "", rows[order[(i + 1) % len(order)]] or ""
        cut = len(t) // 4
        out[k] = t[: len(t) - cut] + nxt[:cut]
    return out


def test_edited_texts_and_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in fingerprints.chained(docs).collect()}
    want = edited(TEXTS)
    assert {k: r["edited_sha256"] for k, r in got.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert {k: r["n_chars"] for k, r in got.items()} == {k: len(t or "") for k, t in TEXTS.items()}
    assert got[2]["fingerprint"] == got[9]["fingerprint"] != got[12]["fingerprint"]
    assert got[1]["fingerprint"] == got[7]["fingerprint"] == "" != got[20]["fingerprint"]
    assert got[12]["near_next"] > 0.9 and got[3]["near_next"] == 0.0
    assert all(0 <= r["near_edited"] <= 1 for r in got.values())


def test_the_order_does_not_depend_on_ranges(spark):
    rows = {i * 3: f"text {i} " * (i % 9 + 1) for i in range(300)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert len(ranges(df, "doc_id", rows_each=5).cuts) > 40
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.chained(df).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in edited(rows).items()}


def test_single_repeated_and_missing_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.chained(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.chained(spark.createDataFrame([(5, "abcdefgh")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(1, "a b"), (1, "a b"), (None, "c d e f"), (None, None)]
    got = fingerprints.chained(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and {r["near_next"] for r in got if r["doc_id"] is None} == {0.0}


def test_syncmers_are_context_free_anchors(spark):
    a, b = LONG[:9000].rsplit(" ", 1)[0], "other words stand here instead of those"
    hashes = F.transform(fingerprints.anchors(F.col("t")), lambda x: F.shiftright(x, 20))
    df = spark.createDataFrame([(a,), (a + " " + b,), (b + " " + a,)], "t string").select(hashes.alias("s"))
    alone, before, after = (r["s"] for r in df.collect())
    n = len(re.findall(r"\w+", a)) - 4
    assert 0.35 < len(alone) / n < 0.65  # two of four inner places
    assert before[: len(alone)] == alone and after[-len(alone) :] == alone


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def anchored(t):
    """(place, hash) of the closed syncmers by their definition."""
    t = (t or "").lower()
    h = [hashed(w) for w in regex.findall(r"[\p{Han}]|[\p{L}\p{N}\p{M}--[\p{Han}]]+", t, regex.V1)]
    if len(h) < 5:
        return [(0, hashed(*h) % 2**64 >> 32)] if h else [(0, hashed(t) % 2**64 >> 32)] if t else []
    out = []
    for i in range(len(h) - 4):
        inner = [hashed(*h[i + j : i + j + 2]) for j in range(4)]
        if min(inner) in (inner[0], inner[3]):
            out.append((i, hashed(*h[i : i + 5]) % 2**64 >> 32))
    return out


def linked(t):
    a = anchored(t)
    return {(h, a[i + 1][1], a[i + 1][0] - p) if i + 1 < len(a) else (h,) for i, (p, h) in enumerate(a)}


def test_fingerprints_and_likeness_equal_brute_force(spark):
    moved = "a few words before " + LONG[:20_000]
    shuffled = " ".join(random.Random(1).sample(LONG.split()[:3000], 3000))
    rows = dict(enumerate([*TEXTS.values(), LONG[:20_000], moved, shuffled, LONG * 8, LONG * 8 + " x"]))
    texts = edited(rows)
    got = fingerprints.chained(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect()
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0

    def said(t):
        a = anchored(t)
        return "".join((f"+{p - a[i - 1][0]}." if i else "") + f"{h:08X}" for i, (p, h) in enumerate(a))

    for r in got:
        k = r["doc_id"]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (said(rows[k]), said(texts[k]))
        assert abs(r["near_edited"] - share(linked(rows[k]), linked(texts[k]))) < 1e-9
        assert abs(r["near_next"] - share(linked(rows[k]), linked(rows[(k + 1) % len(rows)]))) < 1e-9
    near = {r["doc_id"]: r["near_next"] for r in got}
    first = len(TEXTS)
    assert near[first] > 0.95 and near[first + 1] < 0.1 and near[first + 3] > 0.95  # moved, shuffled, very long


SECRETS = [
    'password = "abcdEFGH1234" and TOKEN:xyz and Api_Key=ABCDEFGHIJKL/=',
    "secret: short secret: longenoughvalue passwd=token=abcdefghijklmnop",
    "AKIAABCDEFGHIJKLMN AKIASHORT xAKIA12345678901234Z",
    "deadbeefdeadbeef 0123456789abcdef0 DEADBEEFDEADBEEF feed",
    "key 9f86D081884c7d659A2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 and Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6 end",
    "id 123e4567-e89b-12d3-a456-426614174000 EXAMPLEzx9Qw3Er7Ty1Ui5Op2As8D aaaaaaaaaaaaaaaaaaaaaaaaaaA1",
    "token = é token='ünder' ſecret=abcdefghijklmnopq",
    "letters QwErTyuIoPaSdFgHjKlZ and getTheElementsByTheirTagName and Donaudampfschifffahrt",
    "",
    None,
    "plain words only " * 500 + 'token = "0a1b2c3d4e5f6a7b8c9d"',
]


def base_spans(t):
    out = []
    head = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [("assign", m.start(), m.end()) for m in head.finditer(t) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return out


def entropy(s, width=secret_scan.WINDOW):
    return max(-sum(c / width * math.log2(c / width) for c in Counter(s[i : i + width]).values()) for i in range(len(s) - width + 1))


def all_spans(t):
    base = base_spans(t)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        s = m[0]
        if not re.search("[0-9]|[a-z].*[A-Z].*[A-Z]", s) or re.search(secret_scan.ALLOWED, s) or any(a <= m.start() and m.end() <= b for _, a, b in base_spans(t)):
            continue
        kind, h, digits = "entropy_alnum", entropy(s), re.search("[0-9]", s)
        if re.fullmatch("[0-9a-fA-F]+", s) and digits:
            kind, h, least = "entropy_hex", entropy(s.lower()), secret_scan.LEAST["entropy_hex"]
        elif re.fullmatch("[0-9a-z]+|[0-9A-Z]+", s):
            least = secret_scan.LEAST_ONE_CASE
        elif re.search("[a-z]", s) and re.search("[A-Z]", s):
            least = secret_scan.LEAST["entropy_alnum"] if digits else secret_scan.LEAST_LETTERS
        else:
            continue
        if h >= least - 1e-9:
            base.append((kind, m.start(), m.end()))
    return base


def ordered(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], secret_scan.KINDS.index(x[0]), x[2])))


def test_secret_spans(spark):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(SECRETS)], "doc_id long, text string, base string")
    got = {r["doc_id"]: (r["b"], r["s"]) for r in secret_scan.scan(df).select("doc_id", secret_scan.listed("base").alias("b"), secret_scan.listed("spans").alias("s")).collect()}
    for i, t in enumerate(SECRETS):
        assert got[i] == (ordered(base_spans(t or "")), ordered(all_spans(t or ""))), t
    assert "entropy_hex" in got[4][1] and "entropy_alnum" in got[4][1] and "entropy" not in got[5][1]


def test_window_entropy_is_that_of_the_best_window(spark):
    texts = ["0123456789abcdef0123456789abcdef", "a" * 30 + "0123456789abcdef0123", "deadbeef" * 4, "ab" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.window_entropy(F.col("t"), "0123456789abcdef").alias("h"))
    for r in df.collect():
        assert abs(r["h"] - entropy(r["t"])) < 1e-9


def test_redaction_covers_overlapping_spans_once(spark):
    df = spark.createDataFrame([('a token = "00112233445566778899aabb" b',), ("clean",), ("",), (None,)], "text string")
    got = [r["text"] for r in secret_scan.redact(secret_scan.scan(df)).collect()]
    assert got == ['a [SECRET]" b', "clean", "", None]


def test_shards_are_contiguous_and_balanced(spark):
    rows = [(i * 7 % 5003, "x" * (i * i % 400 + (20_000 if i == 77 else 0))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("crc", F.crc32("text"))
    got = sorted((r["doc_id"], r["shard"], r["slot"], r["size"], r["crc"]) for r in shards.byte_shards(df, 40, F.octet_length("text") + 16, payload=("crc",)).collect())
    want = {k: len(t) + 16 for k, t in rows}
    assert {g[0]: g[3] for g in got} == want and {g[0]: g[4] for g in got} == {k: zlib.crc32(t.encode()) for k, t in rows}
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    sums, slots = Counter(), {}
    for _, s, slot, size, _ in got:
        sums[s] += size
        slots.setdefault(s, []).append(slot)
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(abs(v - sum(want.values()) / 40) for v in sums.values()) <= max(want.values())


def test_shards_of_odd_tables(spark):
    schema = "doc_id long, text string"
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    assert shards.byte_shards(spark.createDataFrame([], schema), 40, size).count() == 0
    got = shards.byte_shards(spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "")], schema), 2, size).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)] and [r["shard"] for r in got if r["doc_id"] is None] == [0]


def test_random_keys_of_one_case_are_found(spark):
    keys = ["k7q2m9x4vb1z8w3n5t6r", "QZ7X2MK4VB3WN5TR6YHD", "k7q2m9x4vb1z8w3n5t6rk7q2m9x4vb1z"]
    plain = ["zzzzzzzzzzzzzzzzzzzzz1", "internationalization2", "A1A1A1A1A1A1A1A1A1A1A1"]
    df = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(keys + plain)], "doc_id long, text string")
    got = [r["s"] for r in secret_scan.scan(df).orderBy("doc_id").select(secret_scan.listed("spans").alias("s")).collect()]
    assert got == [*(f"entropy_alnum:4:{4 + len(k)}" for k in keys), "", "", ""]


def test_long_candidates_and_many_matches_take_linear_time(spark):
    rng = random.Random(3)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1 << 20))
    many = " ".join(f"{i:016x}" for i in range(20_000))
    df = spark.createDataFrame([(1, blob, "mine"), (2, many, "mine")], "doc_id long, text string, _random string")
    began = time.perf_counter()
    got = secret_scan.scan(df)
    assert "_random" in got.columns
    rows = {r["doc_id"]: r for r in got.select("doc_id", F.size("base").alias("n"), F.try_element_at("base", F.lit(-1))["e"].alias("e"), secret_scan.listed("spans").alias("s")).collect()}
    assert f"entropy_alnum:0:{1 << 20}" in rows[1]["s"] and rows[2]["n"] == 20_000 and rows[2]["e"] == len(many)
    assert time.perf_counter() - began < 60


def test_running_sums(spark):
    rows = [([1],), (list(range(1000)),), ([0] * 256,), ([5] * 257,)]
    for r in spark.createDataFrame(rows, "v array<int>").select("v", secret_scan.running_sums(F.col("v")).alias("s")).collect():
        assert r["s"] == list(itertools.accumulate(r["v"]))


def plain_redaction(text, spans):
    at, out = 0, []
    for start, end in spans:
        if end > at:
            out += [text[at:start], "[SECRET]"] if start >= at else []
            at = end
    return "".join(out) + text[at:]


def test_redaction_equals_a_plain_one(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("ab\U0001f600é\n ") for _ in range(rng.choice([1, 40, 1024, 2048, 5000])))
        starts = sorted(rng.randrange(len(text)) for _ in range(rng.choice([1, 3, 40])))
        rows.append((text, [(s, min(len(text), s + rng.choice([1, 5, 60, 1500]))) for s in starts]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<s:int,e:int>>").withColumn("was", F.col("text"))
    for r in secret_scan.redact(df).collect():
        assert r["text"] == plain_redaction(r["was"], [tuple(x) for x in r["spans"]])


def test_many_random_spans_beside_many_base_spans_take_linear_time(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    text = " ".join(f"{rng.getrandbits(64):016x} {key()} token={key()}" for _ in range(16_000))
    df = spark.createDataFrame([(text,)], "text string")
    began = time.perf_counter()
    found = secret_scan.scan(df).withColumn("was", F.col("text"))
    row = secret_scan.redact(found).first()
    assert time.perf_counter() - began < 40
    assert len(row["base"]) == 32_000 and 40_000 < len(row["spans"]) <= 48_000
    base = [(b["s"], b["e"]) for b in row["base"]]
    assert sum(b["kind"].startswith("entropy") for b in row["spans"]) == len(row["spans"]) - len(base)
    assert row["text"] == plain_redaction(text, [(x["s"], x["e"]) for x in row["spans"]])
