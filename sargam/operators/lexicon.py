"""Word lists against free text: dictionary joins, mood detection, segment reports, spelling repair by frequency."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import BROADCAST_LIMIT_BYTES


def dictionary_hits(df: DataFrame, ident: str, hay: list[str], dictionary: DataFrame, name: str, ord_col: str, spellings: str) -> DataFrame:
    """(ident, names): entries any of whose spellings stands anywhere in the columns, in dictionary order, case-blind.

    A spelling can stand only where each of its letter triples stands (shorter ones: the whole of it), so texts and spellings meet
    by an equi-join on the triple of the spelling that fewest spellings have, and 'contains' verifies. The spellings
    are broadcast where their counted number allows it.
    """
    words = dictionary.select(F.col(name).alias("__name"), F.col(ord_col).alias("__ord"), F.explode(spellings).alias("__w")).select("__name", "__ord", F.lower("__w").alias("__w")).where("__w <> ''").distinct()
    triples = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.col(c).substr(i, F.lit(k) if isinstance(k, int) else k)))
    length = F.least(F.lit(3), F.length("__w"))
    grams = words.select("*", F.explode(triples("__w", length)).alias("__g"))
    known = grams.groupBy("__g").agg(F.count("*").alias("__n"))
    keyed = grams.join(known, "__g").groupBy("__name", "__ord", "__w").agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g"))
    sizes = [r[0] for r in words.select(length).distinct().collect()]  # three numbers at most
    text = df.select(ident, F.lower(F.concat_ws(" ", *hay)).alias("__t"))
    none = F.array().cast("array<string>")
    there = F.concat(*[F.when(F.length("__t") >= k, triples("__t", k)).otherwise(none) for k in sizes], none)
    small = keyed.count() * 256 <= BROADCAST_LIMIT_BYTES
    hits = text.select(ident, "__t", F.explode(there).alias("__g")).join(F.broadcast(keyed) if small else keyed, "__g").where("contains(__t, __w)").select(ident, "__ord", "__name").distinct()
    return hits.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("__ord", "__name"))), lambda s: s["__name"]).alias("names"))


def word_frequency(df: DataFrame, column: str, pattern: str = "[ঀ-৿]+") -> DataFrame:
    words = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dotless_fixes(counts: DataFrame, least: int = 3, times: int = 3) -> DataFrame:
    """(word, fixed): words whose spelling with one dot put under DA, DHA or YA is clearly the usual one: at least ``least``
    times and ``times`` as frequent. Of several places the last that qualifies."""
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.col("word").substr(i, F.lit(1)).isin("ড", "ঢ", "য") & (F.col("word").substr(i + 1, F.lit(1)) != X.NUKTA))
    variants = counts.select("word", "n", F.explode(places).alias("at")).withColumn("variant", F.concat(F.expr("substring(word, 1, at)"), F.lit(X.NUKTA), F.expr("substring(word, at + 1, length(word))")))
    usual = counts.select(F.col("word").alias("variant"), F.col("n").alias("vn"))
    return variants.join(usual, "variant").where(F.col("vn") >= F.greatest(F.lit(least), times * F.col("n"))).groupBy("word").agg(F.max_by("variant", "at").alias("fixed"))


def replace_words(df: DataFrame, ident: str, column: str, fixes: DataFrame, pattern: str = "[ঀ-৿]+") -> DataFrame:
    """(ident, column) with the words of ``fixes`` replaced; only texts that hold one are taken apart."""
    parts = F.expr(f"regexp_extract_all({column}, '({pattern}|[^ঀ-৿]+)', 1)")
    exploded = df.select(ident, F.posexplode_outer(parts).alias("pos", "word")).join(fixes, "word", "left")
    back = exploded.groupBy(ident).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", "word").alias("w")))), lambda s: s["w"]), "").alias("__new"))
    return df.select(ident, column).join(back, ident, "left").select(ident, F.when(F.col(column).isNull(), None).otherwise(F.coalesce("__new", F.lit(""))).alias(column))


def segment_report(df: DataFrame, ident: str, order: str, title: str, generic: str, channel: str | None = None, least: int = 2, top: int = 40) -> DataFrame:
    """(segment, n, example): title parts that may be names, and names of automatic artist channels, in how many rows, with the
    first row's title; the ``top`` most frequent, of equals the first seen."""
    parts = X.title_segments(title, generic)
    if channel:
        artist = F.regexp_extract(F.coalesce(F.col(channel), F.lit("")), X.TOPIC_CHANNEL, 1)
        parts = F.concat(F.when(artist != "", F.array(F.concat(artist, F.lit(" (Topic channel)")))).otherwise(F.array().cast("array<string>")), parts)
    rows = df.select(ident, order, title, F.posexplode(parts).alias("at", "segment"))
    counted = rows.groupBy("segment").agg(F.count("*").alias("n"), F.min_by(F.left(title, F.lit(80)), order).alias("example"), F.min(F.struct(order, "at")).alias("first"))
    return counted.where(F.col("n") >= least).orderBy(F.col("n").desc(), "first").limit(top).drop("first")


class MoodLexicon:
    """Patterns of mood and season words. A trailing * stands for any ending; native words match anywhere, others as whole words."""

    def __init__(self, moods: list[tuple[str, list[str]]], seasons: list[tuple[str, list[str]]], negations: list[str], positive: set[str], negated_mood: str, negated_weight: float = 0.8):
        self.entries = sorted(((mood, w) for mood, words in moods for w in words), key=lambda e: -len(e[1]))
        self.compiled = [(mood, self._pattern(w), self._native(w)) for mood, w in self.entries]
        self.seasons = [(s, [self._pattern(w) for w in words]) for s, words in seasons]
        self.negated = re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, negations)) + r")\s+(?:\S+\s+)?$") if negations else None
        self.positive, self.negated_mood, self.negated_weight = positive, negated_mood, negated_weight

    @staticmethod
    def _native(word: str) -> bool:
        return any("ঀ" <= c <= "৿" for c in word)

    @classmethod
    def _pattern(cls, word: str) -> re.Pattern:
        if cls._native(word):
            return re.compile(re.escape(word))
        stem, any_end = (word[:-1], "[a-z']*") if word.endswith("*") else (word, "")
        return re.compile(rf"(?<![a-z]){re.escape(stem.lower())}{any_end}(?![a-z])")

    def hits(self, text: str | None) -> list[tuple[str, str, float]]:
        """(mood, word, weight), longest entries first; a place counts for one entry only. A negation up to one word before
        turns a positive mood into ``negated_mood`` and takes any other out; the place is used up all the same."""
        lowered = X.unicodedata.normalize("NFC", text or "").lower()
        free = lowered
        found = []
        for mood, pattern, native in self.compiled:
            for m in pattern.finditer(free):
                before = lowered[max(0, m.start() - 25) : m.start()]
                negated = not native and self.negated is not None and self.negated.search(before) is not None
                if not negated:
                    found.append((mood, m[0].strip(), 1.0))
                elif mood in self.positive:
                    found.append((self.negated_mood, "not " + m[0].strip(), self.negated_weight))
            free = pattern.sub(lambda m: " " * len(m[0]), free)
        return found

    def season(self, text: str | None) -> str | None:
        """Season with most word matches, the first listed of equals; null without any."""
        lowered = X.unicodedata.normalize("NFC", text or "").lower()
        counts = [(sum(len(p.findall(lowered)) for p in patterns), name) for name, patterns in self.seasons]
        best = max(counts, key=lambda c: c[0], default=(0, None))
        return best[1] if best[0] else None


def detect_moods(df: DataFrame, ident: str, text: str, lexicon: MoodLexicon, share: float = 0.34, top: int = 4) -> DataFrame:
    """(ident, mood, weight, place): moods scored by their hits, those of ``share`` of the best or more, ``top`` of them.

    Taking places away is stateful within a text, so one Arrow UDF finds the hits; sums, the cut and the order are built-in. Ties
    keep the order of first hits.
    """
    kind = T.ArrayType(T.StructType([T.StructField("mood", T.StringType()), T.StructField("word", T.StringType()), T.StructField("weight", T.DoubleType())]))

    @F.pandas_udf(kind)
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("mood", "word", "weight"), h)) for h in lexicon.hits(t if isinstance(t, str) else None)] for t in texts], dtype=object)

    summed = df.select(ident, F.posexplode(hits(text)).alias("pos", "h")).groupBy(ident, "h.mood").agg(F.sum("h.weight").alias("score"), F.min("pos").alias("pos"))
    w = Window.partitionBy(ident)
    return (
        summed.withColumn("best", F.max("score").over(w))
        .where(F.col("score") >= share * F.col("best"))
        .withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc(), "pos")))
        .where(F.col("place") <= top)
        .select(ident, "mood", (F.col("score") / F.col("best")).alias("weight"), "place")
    )


def merge_weights(explicit: DataFrame, inferred: DataFrame, ident: str, cap: float = 0.8, top: int = 4) -> DataFrame:
    """(ident, mood, weight, place): explicit weights in full, inferred ones capped where an id has explicit moods, the greater on overlap."""
    capped = inferred.join(explicit.select(ident).distinct().withColumn("__e", F.lit(True)), ident, "left").select(ident, "mood", F.when(F.col("__e"), F.least(F.lit(cap), "weight")).otherwise(F.col("weight")).alias("wi"))
    both = explicit.select(ident, "mood", F.col("weight").alias("we")).join(capped, [ident, "mood"], "full_outer")
    w = Window.partitionBy(ident).orderBy(F.col("weight").desc(), "mood")
    return both.select(ident, "mood", F.greatest("we", "wi").alias("weight")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
