"""Translation as data work: worklists, segments, a shared memory of lines, protected terms, merging by id. The model is a
plug-in: a function from a list of texts to a list of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import cut

Translator = Callable[[list[str]], list[str]]
MOST_CHARS = 4500
STRUCTURE = r"^\s*([#>\-*\d.)]+)\s*$"


def worklist(items: DataFrame, most: int | None = None) -> DataFrame:
    """Items with a source text and no translation; with `most`, the first by id."""
    rows = items.filter(T.blank_to_null("content_en").isNotNull() & T.blank_to_null("content_sw").isNull())
    return rows if most is None else rows.orderBy("id").limit(most)


def resume(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """Take non-blank translations and their status from an earlier output by id; what an item has already stays."""
    old = earlier.select("id", T.blank_to_null("content_sw").alias("_sw"), F.col("status").alias("_status")).filter(F.col("_sw").isNotNull())
    rows = items.join(old, "id", "left")
    fill = T.blank_to_null("content_sw").isNull() & F.col("_sw").isNotNull()
    rows = rows.withColumn("_fill", fill).withColumn("status", F.when(F.col("_fill"), F.coalesce("_status", "status")).otherwise(F.col("status")))
    return rows.withColumn("content_sw", F.when(F.col("_fill"), F.col("_sw")).otherwise(F.col("content_sw"))).select(items.columns)


def status_after(filled: Column, status: Column) -> Column:
    """`original` becomes `machine` when a translation is filled in; any other state, a human's for instance, stays."""
    return F.when(filled & (status == "original"), F.lit("machine")).otherwise(status)


def sentence_packs(texts: DataFrame, key: str, text: str, most: int = 300) -> DataFrame:
    """(key, paragraph, place, segment): paragraphs to sentences to packs of at most `most` characters."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), T.strip), lambda x: x != "")
    rows = texts.select(key, F.posexplode(paragraphs).alias("paragraph", "_p"))
    sentences = F.filter(F.split(F.regexp_replace("_p", r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: x != "")
    return rows.select(key, "paragraph", F.posexplode(T.pack(sentences, most)).alias("place", "segment"))


def word_windows(texts: DataFrame, key: str, text: str, words: int = 480, most_chars: int | None = None) -> DataFrame:
    """(key, place, segment): consecutive windows of words of the whole text, or of its first `most_chars` characters."""
    whole = F.col(text) if most_chars is None else F.substring(F.col(text), 1, most_chars)
    w = F.filter(F.split(whole, r"\s+"), lambda x: x != "")
    rows = texts.select(key, w.alias("_w")).filter(F.size("_w") > 0)
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / words).cast("int"))))
    return rows.select(key, "place", F.array_join(F.slice("_w", F.col("place") * words + 1, F.lit(words)), " ").alias("segment"))


def stitch(segments: DataFrame, key: str, text: str, by: str = "\n", paragraph: str | None = None) -> DataFrame:
    """Segments joined in order; with a paragraph column, by a space inside and a blank line between paragraphs."""
    if paragraph:
        inner = segments.groupBy(key, paragraph).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text))), lambda s: s[text]), " ").alias(text))
        return stitch(inner.withColumnRenamed(paragraph, "place"), key, text, "\n\n")
    return segments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text))), lambda s: s[text]), by).alias(text))


def pieces(text: str, most: int = MOST_CHARS) -> list[str]:
    """A text cut into pieces of at most `most` characters that give it back when joined; cut behind white space where there is some."""
    out = []
    while len(text) > most:
        at = next((i for i in range(most, most // 2, -1) if text[i - 1].isspace()), most)
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def translate(df: DataFrame, text: str, translator: Translator, into: str = "translated", failed: str | None = None) -> DataFrame:
    """Add translations, batch by batch; a batch that fails keeps its source, which `failed`, a column of that name, tells. Texts beyond the model's length are translated
    in pieces and joined."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [pieces(x or "") for x in batch[text]]
            source = [p.rstrip() if i + 1 < len(ps) else p for ps in parts for i, p in enumerate(ps)]
            lost = False
            try:
                out = translator(source)
            except Exception:  # a plug-in may raise anything; the source text stands in
                out, lost = source, True
            done = iter([t or s for s, t in zip(source, out, strict=True)])
            told = {failed: lost} if failed else {}
            yield batch.assign(**told, **{into: ["".join(next(done) + (p[len(p.rstrip()) :] if i + 1 < len(ps) else "") for i, p in enumerate(ps)) for ps in parts]})

    shape = df.withColumn(failed, F.lit(False)) if failed else df
    return df.mapInPandas(work, shape.withColumn(into, F.lit("")).schema)


def remembered(spark: SparkSession, path: str) -> DataFrame:
    """(line, translated) rows of a stored memory; none where nothing has been stored."""
    try:
        return spark.read.schema("line string, translated string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line string, translated string")


def line_memory(texts: DataFrame, key: str, text: str, translator: Translator, memory: str | None = None) -> DataFrame:
    """Translate texts line by line, each distinct line once: (key, translated). Lines of marks alone stay as they are.

    With `memory`, a table that lasts, lines that it knows are not translated again, and those translated now are added to it, so a
    run over the same texts translates nothing. Lines of a batch that failed are not remembered; they stand as they are until the next run.

    Distinct lines are counted. Those that hold more than 1 / (8 p) of all lines, p the number of shuffle partitions, are at
    most 8 p, and their translations are broadcast; the others are joined by hash and line, so no line makes a long task.
    """
    spark = texts.sparkSession
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))
    plain = (F.trim("line") != "") & ~F.col("line").rlike(STRUCTURE)
    counts = cut(lines.filter(plain).groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1000, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if memory:
        fresh = counts.join(remembered(spark, memory), "line", "left_anti").select("line")
        made = translate(fresh, "line", translator, failed="failed").filter("NOT failed").select("line", "translated")
        made.write.mode("append").parquet(memory)
        known = remembered(spark, memory).dropDuplicates(["line"])  # two runs at a time may add a line each
        known = counts.join(known, "line")
    else:
        known = cut(translate(counts, "line", translator))
    hot = F.broadcast(known.filter(F.col("n") > least).select("line", F.col("translated").alias("_hot")))
    cold = known.filter(F.col("n") <= least).select("line", "translated", F.lit(0).cast("long").alias("_part"))
    marked = lines.join(hot, "line", "left").withColumn("_part", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("place", "_hot"), F.lit(1024))).cast("long"))
    done = marked.join(cold, ["line", "_part"], "left")
    return stitch(done.select(key, "place", F.coalesce("_hot", "translated", "line").alias("translated")), key, "translated")


def protector(terms: list[str]) -> Callable[[list[str]], tuple[list[str], list[list[tuple[str, str]]]]]:
    """Replace terms by [[T0]], [[T1]], ... in order of term, then of match, whatever the case."""
    splitters = [re.compile(f"({re.escape(t)})", re.IGNORECASE) for t in terms if t]

    def one(text: str) -> tuple[str, list[tuple[str, str]]]:
        marks: list[tuple[str, str]] = []
        for splitter in splitters:
            parts = splitter.split(text)  # what stands between, and every second part a match
            tokens = [f"[[T{len(marks) + i}]]" for i in range(len(parts) // 2)]
            marks += zip(tokens, parts[1::2], strict=True)
            parts[1::2] = tokens
            text = "".join(parts)
        return text, marks

    def protect(texts: list[str]) -> tuple[list[str], list[list[tuple[str, str]]]]:
        done = [one(t) for t in texts]
        return [t for t, _ in done], [m for _, m in done]

    return protect


def protect(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Add `protected` and `marks` (token, original) to df. terms come from a small glossary."""
    do = protector(terms)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, marks = do([x or "" for x in batch[text]])
            yield batch.assign(protected=out, marks=[[{"token": a, "original": b} for a, b in m] for m in marks])

    empty = F.array().cast("array<struct<token:string,original:string>>")
    return df.mapInPandas(work, df.withColumn("protected", F.lit("")).withColumn("marks", empty).schema)


def restore(text: Column | str, marks: Column | str) -> Column:
    """Put the originals back, the last token first, as a term may stand inside a later one's place."""
    return F.aggregate(F.reverse(marks), F.col(text) if isinstance(text, str) else text, lambda a, m: F.replace(a, m["token"], m["original"]))


def apply_glossary(text: Column | str, pairs: list[tuple[str, str]], whole_words: bool = False) -> Column:
    """Replace each mapped term, whatever the case, in the glossary's order."""
    out = F.col(text) if isinstance(text, str) else text
    for term, by in pairs:
        edge = r"\b" if whole_words else ""
        out = F.regexp_replace(out, rf"(?i){edge}\Q{term}\E{edge}", by.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def apply_by_id(items: DataFrame, rows: DataFrame, force: bool = False, blank_too: bool = False) -> DataFrame:
    """Write translations (file_key, id, content_sw, pos) into items by file and id; the last row of an id counts. Only blank
    ones are filled, all with `force`; rows without id or text are left out, but `blank_too` lets empty texts overwrite."""
    usable = rows.filter(T.blank_to_null("id").isNotNull() & (F.lit(blank_too) | T.blank_to_null("content_sw").isNotNull()))
    last = usable.groupBy("file_key", F.trim("id").alias("id")).agg(F.max_by("content_sw", "pos").alias("_sw"))
    put = F.col("_sw").isNotNull() & (F.lit(force or blank_too) | T.blank_to_null("content_sw").isNull())
    out = items.join(last, ["file_key", "id"], "left").withColumn("updated", put)
    return out.withColumn("content_sw", F.when(F.col("updated"), F.col("_sw")).otherwise(F.col("content_sw"))).select(*items.columns, "updated")


def file_key(stem: Column) -> Column:
    """A file's name without what marks it as cleaned or translated."""
    t = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.regexp_replace(t, r"(_(cleaned|translations?|swa?|sw_ke|sw_tz))+$", "")


def match_files(files: DataFrame) -> DataFrame:
    """Of files (path, stem, rows) with the same key the one with most rows, then the first path."""
    w = Window.partitionBy("file_key").orderBy(F.desc("rows"), "path")
    return files.filter("rows > 0").withColumn("file_key", file_key(F.col("stem"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def translate_sections(items: DataFrame, translator: Translator, glossary: list[tuple[str, str]] = (), memory: str | None = None) -> DataFrame:
    """(id, sections_sw, content_sw, needs_review) of every item, through the line memory.

    items: id, content_en, content_sw, sections (titles and bodies, null or empty where there are none), needs_review. Where there are
    sections, their translations are the text, as blocks of a title, a blank line and a body, empty parts left out; else a text that is there
    stays, and a missing one is translated from content_en. The glossary is applied last. Review is over when both sides are
    there; otherwise it stays as it was.
    """
    parts = items.select("id", F.posexplode("sections").alias("place", "s"))
    parts = parts.select("id", "place", F.explode(F.create_map(F.lit("title"), F.trim("s.title"), F.lit("body"), T.strip(F.col("s.body")))).alias("k", "v"))
    whole = items.filter(T.blank_to_null("content_sw").isNull()).select("id", F.lit(-1).alias("place"), F.lit("text").alias("k"), F.col("content_en").alias("v"))
    keyed = parts.unionByName(whole).withColumn("v", F.coalesce("v", F.lit(""))).withColumn("_key", F.struct("id", "place", "k"))
    done = line_memory(keyed, "_key", "v", translator, memory).select("_key.*", apply_glossary("translated", list(glossary)).alias("v"))
    rows = done.groupBy("id", "place").pivot("k", ["title", "body", "text"]).agg(F.first("v"))
    section = F.when(F.col("place") >= 0, F.struct("place", F.struct("title", "body").alias("s")))
    built = rows.groupBy("id").agg(F.array_sort(F.collect_list(section)).alias("_s"), F.max("text").alias("_text"))  # of one item
    made = F.transform("_s", lambda x: x["s"])
    block = lambda s: T.strip(F.when(s["title"] != "", F.concat(s["title"], F.lit("\n\n"), s["body"])).otherwise(s["body"]))
    blocks = F.array_join(F.filter(F.transform(made, block), lambda x: x != ""), "\n\n")
    rebuilt = F.when(T.blank_to_null(blocks).isNotNull(), blocks)
    out = items.join(built, "id", "left")
    own = F.when(T.blank_to_null("content_sw").isNotNull(), apply_glossary("content_sw", list(glossary)))
    out = out.withColumn("_sw", F.coalesce(rebuilt, own, F.col("_text"), F.lit("")))
    both = T.blank_to_null("content_en").isNotNull() & T.blank_to_null("_sw").isNotNull()
    return out.select("id", F.when(F.size("_s") > 0, made).alias("sections_sw"), F.col("_sw").alias("content_sw"), F.when(both, F.lit(False)).otherwise(F.col("needs_review")).alias("needs_review"))


def backcheck(items: DataFrame, order: str, translator: Translator, most: int = 50) -> DataFrame:
    """The translations among the first `most` items in order, translated back, for whoever checks the quality."""
    sample = items.orderBy(order).limit(most).filter(T.blank_to_null("content_sw").isNotNull())
    return translate(sample, "content_sw", translator, into="back")
