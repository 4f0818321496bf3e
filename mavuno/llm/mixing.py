"""Mixing a corpus to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, arrow_batches, cut, joined, unit_hash
from .latent import TERMS, _trigrams, sampled, unit

TOPICS, DIMS = 8, 32
START_TEXTS = 1024  # bound of the sample that the starting centres are drawn from; every later step sums over all texts
TEMPER = 0.7  # a category's target share, unless stated, is its share of the tokens to this power, scaled to 1
KEEP = 0.8  # share of the tokens that the sample should hold
ROUNDS, CLOSE = 20, 5e-4  # raking ends when no margin is further from its target than this share of the sample, or hardly moves
MARGINS = ("source", "lang", "topic")
OTHERS = "*"  # in stated targets: all categories that are not named, together


@dataclass(frozen=True)
class Topics:
    """Topics as centres of projected letter trigrams, less the mean of the text's language, so that topics do not repeat what
    the languages say. The projection is fixed; means and centres are learned from all texts."""

    languages: dict[str, int]  # those with a mean of their own: a hundredth of all texts at least; all others share the first
    means: np.ndarray
    centres: np.ndarray

    def of(self, texts: list[str | None], languages: list[str | None]) -> np.ndarray:
        """The nearest centre of each whole text; -1 for an empty or null one."""
        x, some = projected(texts)
        return np.where(some, self.nearest(x, np.array([self.languages.get(n, 0) for n in languages], int)), -1).astype(np.int32)

    def unit(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        return unit(x - self.means[group])

    def nearest(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        return (self.unit(x, group) @ self.centres.T).argmax(axis=1) if len(x) else np.zeros(0, int)


@lru_cache(1)
def projection(seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TERMS, DIMS)) / np.sqrt(DIMS)


def projected(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Projected square roots of the relative frequencies of hashed letter trigrams, and which texts have any."""
    rows = np.zeros((len(texts), TERMS))
    for i, t in enumerate(texts):
        if t:
            raw = np.frombuffer(t.lower().encode(), np.uint8).astype(np.uint32)
            rows[i] = np.sqrt(_trigrams(raw, 7) / max(1, len(raw) - 2))
    return rows @ projection(), rows.any(axis=1)


def learn_topics(docs: DataFrame, text: str = "text", lang: str = "lang", topics: int = TOPICS, rounds: int = 10, seed: int = 3) -> Topics:
    """Spherical k-means of all texts: each round assigns every text and sums up by topic in Spark; only starting centres
    come from a bounded sample. A row of DIMS numbers for each text is written in between. Empty texts take no part."""
    arrow_batches(docs.sparkSession)
    counts = docs.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    large = counts.filter((F.col("n") >= n / 100) & F.col(lang).isNotNull()).orderBy(lang).collect()  # a hundred at most
    groups = {str(r[lang]): i + 1 for i, r in enumerate(large)}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, some = projected(list(batch[text]))
            yield pd.DataFrame({"x": pd.Series(list(x[some]), dtype=object), "g": np.array([groups.get(v, 0) for v in batch[lang]], int)[some]})

    vectors = cut(docs.select(text, F.col(lang).cast("string").alias(lang)).mapInPandas(project, "x array<double>, g int"))

    def summed(told: Topics | None, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and vector sums of all texts by topic, or by language where no topics are told."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count, sums = np.zeros(size, int), np.zeros((size, DIMS))
            for batch in batches:
                if len(batch):
                    x, g = np.stack(list(batch["x"])), batch["g"].to_numpy()
                    at = told.nearest(x, g) if told else g
                    np.add.at(count, at, 1)
                    np.add.at(sums, at, told.unit(x, g) if told else x)
            yield pd.DataFrame({"k": np.arange(size), "n": count, "sums": list(sums)})

        parts = vectors.mapInPandas(add, "k int, n long, sums array<double>").select("k", "n", F.posexplode("sums").alias("at", "value"))
        count, sums = np.zeros(size, int), np.zeros((size, DIMS))
        for r in parts.groupBy("k", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():  # size x DIMS
            count[r["k"]], sums[r["k"], r["at"]] = r["n"], r["value"]
        return count, sums

    count, sums = summed(None, len(groups) + 1)
    whole = sums.sum(axis=0) / max(count.sum(), 1)
    means = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], whole).round(9)
    told = Topics(groups, means, np.zeros((topics, DIMS)))
    start = sorted((tuple(r["x"]), r["g"]) for r in sampled(vectors, START_TEXTS, F.col("x"), seed=9).collect())
    x = told.unit(np.array([v for v, _ in start]).reshape(-1, DIMS), np.array([g for _, g in start], int))
    rng, far, centres = np.random.default_rng(seed), np.full(len(x), 2.0), told.centres.copy()
    for k in range(min(topics, len(np.unique(x, axis=0)))):  # as far apart as chance has it
        centres[k] = x[rng.choice(len(x), p=far / far.sum())]
        far = np.minimum(far, np.maximum(0, 1 - x @ centres[k]) + 1e-12)
    for _ in range(rounds if len(x) else 0):
        count, sums = summed(Topics(groups, means, centres), topics)
        fresh = np.where(count[:, None] > 0, unit(sums), centres).round(9)
        if np.abs(fresh - centres).max() < 1e-3:
            break
        centres = fresh
    return Topics(groups, means, centres)


def tell_topics(df: DataFrame, topics: Topics, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the column topic to df; a column of that name is replaced, all others stay."""
    arrow_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(topics)
    df = df.drop("topic")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(topic=sent.value.of(list(batch[text]), list(batch[lang])))

    return df.mapInPandas(work, df.withColumn("topic", F.lit(0)).schema)


def tokens(text: Column | str) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"\S+")), F.lit(0)).cast("long")


def category(name: str) -> Column:
    """A margin's value; null is a category of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit("(none)"))


def goals(cells: DataFrame, margin: str, stated: dict[str, float] | None, keep: float, temper: float = TEMPER) -> DataFrame:
    """(margin, _goal, _n) for each category: the tokens that the sample should hold of it, and its cells.

    Stated weights are scaled to 1 over the categories that occur; what OTHERS weighs is spread over the categories that are
    not named by their tokens, and without OTHERS they get nothing. Without stated weights a category's share is its
    share of the tokens to the power `temper`, but no more than all of its tokens; what that cuts off goes to the others.
    """
    sums = cut(cells.groupBy(margin).agg(F.sum("tokens").alias("_all"), F.count(F.lit(1)).alias("_n")))
    whole = float(sums.agg(F.sum("_all")).first()[0] or 0)
    if stated is not None:
        named = [F.lit(x) for k, v in stated.items() if k != OTHERS for x in (str(k), float(v))]
        own = F.element_at(F.create_map(*named), F.col(margin)) if named else F.lit(None).cast("double")
        rest = sums.filter(own.isNull()).agg(F.sum("_all")).first()[0] or 0
        weight = F.coalesce(own, F.col("_all") * F.lit(float(stated.get(OTHERS, 0)) / rest if rest else 0.0))
        total = sums.agg(F.sum(weight)).first()[0] or 1.0
        goal = weight / F.lit(float(total)) * F.lit(keep * whole)
    else:
        weight, scale = F.pow("_all", F.lit(temper)), 0.0
        for _ in range(50):
            over = F.col("_all") < F.lit(scale) * weight
            taken, free = sums.agg(F.sum(F.when(over, F.col("_all")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(weight))).first()
            fresh = (keep * whole - (taken or 0)) / free if free else scale
            if fresh <= scale * (1 + 1e-12):
                break
            scale = fresh
        goal = F.least(F.col("_all").cast("double"), F.lit(scale) * weight)
    return sums.select(margin, goal.alias("_goal"), "_n")


def rake(cells: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> tuple[DataFrame, float]:
    """Fit `taken`, tokens to take of every cell (source, lang, topic, tokens), so that the margins of what is taken meet
    their `goals`; and the residual, the largest distance of a margin from its goal as a share of the sample.

    `taken` starts as `keep` of each cell and is scaled to each margin in turn. No cell gives more than it has: what full
    cells cannot give, the other cells of the category do. Rounds end when all margins are CLOSE or hardly move any
    more, which is so if the goals contradict each other or the corpus. Cells, one for each triple that occurs, and
    sums stay on the cluster; sums are joined back by broadcast while there are few, and each round is cut.
    """
    cells = cut(cells.filter(F.col("tokens") > 0))
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = cells.withColumn("taken", F.lit(keep) * F.col("tokens"))
    wanted = {m: cut(goals(cells, m, (targets or {}).get(m), keep, temper)) for m in MARGINS}
    every = reduce(DataFrame.unionByName, [wanted[m].select(F.lit(m).alias("_margin"), F.col(m).alias("_category"), "_goal") for m in MARGINS])
    few = {m: wanted[m].count() <= MOST_BROADCAST for m in MARGINS}
    if not whole:
        return fitted, 0.0
    last = None
    for _ in range(ROUNDS):
        for m in MARGINS:
            full = F.col("taken") >= F.col("tokens") * (1 - 1e-12)
            sums = fitted.groupBy(m).agg(F.sum(F.when(full, F.col("taken")).otherwise(0.0)).alias("_full"), F.sum(F.when(full, 0.0).otherwise(F.col("taken"))).alias("_free"))
            sums = sums.join(wanted[m], m)
            fitted = fitted.join(F.broadcast(sums), m) if few[m] else joined(fitted, sums, [m], "_n", keep=False)
            up = F.when(full | (F.col("_free") <= 0), 1.0).otherwise((F.col("_goal") - F.col("_full")) / F.col("_free"))
            ratio = F.when(F.col("_goal") < F.col("_full") + F.col("_free"), F.col("_goal") / (F.col("_full") + F.col("_free"))).otherwise(up)
            fitted = fitted.select(*MARGINS, "tokens", F.least(F.col("tokens").cast("double"), F.col("taken") * ratio).alias("taken"))
        fitted = cut(fitted)
        residual = (gaps(fitted, every).agg(F.max(F.abs(F.col("_now") - F.col("_goal")))).first()[0] or 0.0) / (keep * whole)
        if residual < CLOSE or last is not None and residual > 0.9 * last:
            break
        last = residual
    return fitted, residual


def gaps(fitted: DataFrame, goals: DataFrame) -> DataFrame:
    """What the categories (_margin, _category) should hold (`_goal`) and do hold (`_now`)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("_margin"), F.col(m).alias("_category")) for m in MARGINS])).alias("_one")
    return fitted.select(each, "taken").groupBy("_one._margin", "_one._category").agg(F.sum("taken").alias("_now")).join(goals, ["_margin", "_category"])


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, keep_text: bool = True) -> DataFrame:
    """Add topic, tokens, p, kept and residual to df: the chance of each document, whether the sample takes it, and how far the
    expected mix stays from its targets (`rake`).

    df has source and lang; null counts as a category. A document is taken if a hash of its key, or of its text if it has no
    key, falls below p, so the sample does not depend on partitions, and equal rows go or stay together. Documents
    without tokens have p = 0; an empty table gives none. Columns named like a new one are replaced, any others stay;
    without `keep_text` the text is left out and topics are told once. Of each document only its cell and tokens are
    shuffled, pre-aggregated; chances are joined back by `joined`.
    """
    mark = "_"
    while any(f"{mark}{m}" in df.columns for m in (*MARGINS, "draw")):
        mark += "_"
    df = df.drop("topic", "tokens", "p", "kept", "residual")
    draw = unit_hash(F.coalesce(F.col(key).cast("long"), F.xxhash64(F.lit("no key"), text)), seed=31)
    told = tell_topics(df, learn_topics(df, text), text).withColumn("tokens", tokens(text)).withColumn(f"{mark}draw", draw)
    told = told if keep_text else cut(told.drop(text))
    named = {m: f"{mark}{m}" for m in MARGINS}
    told = told.withColumns({c: category(m) for m, c in named.items()})
    cells = cut(told.groupBy(*named.values()).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias(f"{mark}n")))
    fitted, residual = rake(cells.select(*[F.col(c).alias(m) for m, c in named.items()], "tokens"), keep, targets)
    chance = fitted.select(*[F.col(m).alias(c) for m, c in named.items()], (F.col("taken") / F.col("tokens")).alias("p"))
    chance = cells.select(*named.values(), f"{mark}n").join(chance, list(named.values()))
    out = joined(told, chance, list(named.values()), f"{mark}n", how="left", spread=F.col(f"{mark}draw"))
    p = F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("p", p).withColumn("kept", F.col(f"{mark}draw") < F.col("p")).withColumn("residual", F.lit(residual))
    return out.drop(*named.values(), f"{mark}draw", f"{mark}n")
