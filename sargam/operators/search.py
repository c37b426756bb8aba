"""Tiered, spelling-tolerant search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Least skeleton letters for titles, lyrics and names.
TITLE_LETTERS, LYRICS_LETTERS, NAME_LETTERS = 4, 5, 3


def search_projection(df: DataFrame, native: str, latin: str, lyrics: str) -> DataFrame:
    """Adds title_norm, lyrics_norm, skeletons and lyrics_skeleton; worth writing once per catalogue."""
    return df.withColumns(
        {
            "title_norm": X.norm(F.concat_ws(" ", F.col(native), F.col(latin))),
            "lyrics_norm": X.norm(F.coalesce(F.col(lyrics), F.lit(""))),
            "skeletons": F.filter(F.array(X.skeleton_native(native), X.skeleton_latin(latin)), lambda s: s != ""),
            "lyrics_skeleton": X.skeleton_native(lyrics),
        }
    )


def tier(title: Column, lyrics: Column, skeletons: Column, lyrics_skeleton: Column, q: Column, qs: Column) -> Column:
    """First tier that matches: 1 title begins with q, 2 contains it, 3 a skeleton begins with qs, 4 contains it,
    5 lyrics contain q or their skeleton qs. Tiers 3 and 4 need 4 skeleton letters, the lyrics' 5. Null: no match or empty query."""
    long_enough = F.length(qs) >= TITLE_LETTERS
    return (
        F.when(q == "", None)
        .when(title.startswith(q), 1)
        .when(title.contains(q), 2)
        .when(long_enough & F.exists(skeletons, lambda s: s.startswith(qs)), 3)
        .when(long_enough & F.exists(skeletons, lambda s: s.contains(qs)), 4)
        .when(lyrics.contains(q) | ((F.length(qs) >= LYRICS_LETTERS) & lyrics_skeleton.contains(qs)), 5)
    )


def search(projected: DataFrame, query: str) -> DataFrame:
    """Rows that match one query with their tier; order by tier, then the catalogue's order."""
    q = X.norm(F.lit(unicodedata.normalize("NFC", query)), composed=True)
    qs = X.skeleton_native(F.lit(query)) if any("\u0980" <= c <= "\u09ff" for c in query) else X.skeleton_latin(F.lit(query))
    found = tier(F.col("title_norm"), F.col("lyrics_norm"), F.col("skeletons"), F.col("lyrics_skeleton"), q, qs)
    return projected.withColumn("tier", found).where("tier is not null")


def name_bucket(name: Column, skeleton: Column, query: str, query_skeleton: str) -> Column:
    """0 prefix, 1 substring, 2 skeleton (3 letters or more), null no match; an empty query matches everything with 0."""
    if not query:
        return F.lit(0)
    similar = skeleton.contains(query_skeleton) if len(query_skeleton) >= NAME_LETTERS else F.lit(False)
    return F.when(name.startswith(query), 0).when(name.contains(query), 1).when(similar, 2)
