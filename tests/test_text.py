from pyspark.sql import functions as F

from mavuno.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()
    return row["x"]


def test_white_space_in_the_unicode_sense(spark):
    assert one(spark, T.squash_ws("t"), t="  a  \n b\t") == "a b"
    assert one(spark, T.squash_ws("t"), t="") == ""
    assert one(spark, T.squash_ws("t"), t=None) is None


def test_blocks_and_paragraphs(spark):
    assert one(spark, T.clean_block("t"), t="so­ft hy-\nphen \n\n\n\nnext  one ") == "soft hyphen\n\nnext one"
    lines = F.array(*map(F.lit, ["Chapter 12", "7", "a long win-", "dow opens", "• bullet", "after it", "goes on"]))
    assert one(spark, T.join_paragraphs(lines), t="") == "a long window opens\n• bullet\nafter it goes on"


def test_headings(spark):
    kinds = {"header": "Basic Rules", "page": "BASIC RULES", "section": "Some few words", "book": "DEBILITY (WEAK)"}
    for kind, line in kinds.items():
        assert one(spark, T.is_heading("t", kind), t=line), kind
    assert not one(spark, T.is_heading("t", "book"), t="SECTION FOUR")
    assert not one(spark, T.is_heading("t", "header"), t="Ends in a stop.")


def test_sentences_and_snippets(spark):
    assert one(spark, T.first_sentence("t"), t="One. Two.") == "One.…"
    assert one(spark, T.first_sentence("t"), t="x" * 200) == "x" * 160 + "…"
    assert one(spark, T.context_snippet("t", F.lit("needle"), 3), t="some needle here") == "… me nee …"
    assert one(spark, T.context_snippet("t", F.lit("absent")), t="some") is None
    assert one(spark, T.shorten("t", 10), t="whole words only") == "whole …"


def test_matches_do_not_overlap(spark):
    got = one(spark, T.match_spans("t", F.lit("aa")), t="AAaa.aa")
    assert [(x["start"], x["end"]) for x in got] == [(0, 2), (2, 4), (5, 7)]
    assert one(spark, T.match_spans("t", F.lit("")), t="abc") == []
    assert [(x["start"], x["end"]) for x in one(spark, T.match_spans("t", F.lit("a.")), t="a.ab")] == [(0, 2)]


def test_tokens_and_slugs(spark):
    assert one(spark, T.tokens("t", "hybrid"), t="L'Été a B2 b2") == ["l'été", "b2"]
    assert one(spark, T.tokens("t", "answer"), t="to be to") == ["to", "be", "to"]
    assert one(spark, T.slugify("t"), t="  Wild Mint! ") == "wild-mint"
    assert one(spark, T.slugify_decomposed("t"), t="Créé") == "cre-e"
    assert one(spark, T.section_slug("t"), t="Symptoms & Causes") == "symptoms-causes"
    assert one(spark, T.section_slug("t"), t="!!") == "section"


def test_bullets_and_blocks(spark):
    assert one(spark, T.bullet_items("t"), t="• a\n- b\nplain") == ["a", "b", "plain"]
    assert one(spark, T.bullet_items("t"), t="• a\nplain\nplain") == []
    assert one(spark, T.strip_blocks("t"), t="keep\nENCOURAGEMENT—gone\nmore\n\nkept") == "keep\nkept"
