"""User state: ordered sets, replica merge, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _arr(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def union_ordered(first: Column | str, second: Column | str) -> Column:
    """Both lists, first seen first, each value once."""
    return F.array_distinct(F.concat(_arr(first), _arr(second)))


def without(values: Column | str, removed: Column | str) -> Column:
    return F.array_except(_arr(values), _arr(removed))


def toggled(on: Column | str, off: Column | str, item: Column) -> tuple[Column, Column]:
    """Two lists after an item is toggled in the first: put in or taken out there, always out of the second."""
    on, off = _arr(on), _arr(off)
    return F.when(F.array_contains(on, item), F.array_remove(on, item)).otherwise(F.array_append(on, item)), F.array_remove(off, item)


def rows_of_list(lists: DataFrame, by: str, ids: str, items: DataFrame, ident: str) -> DataFrame:
    """Rows of the items of each list with their place; unknown ids are left out, places stay those of the list."""
    return lists.select(by, F.posexplode(ids).alias("place", ident)).join(items, ident)


def merged_state(local: DataFrame, remote: DataFrame, key: str, first_link: bool) -> DataFrame:
    """One row for each key of two replicas (likes, never, recent, filters, prefs_at, session, session_at).

    On the first link likes and never are united, remote first, never without likes; later the newer side's lists hold. Filters
    and recent come from the newer preferences, the session from the newer session; equal times keep the local side.
    """
    l, r = local.alias("l"), remote.alias("r")
    j = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    newer = F.coalesce(F.col("r.prefs_at"), F.lit(0)) > F.coalesce(F.col("l.prefs_at"), F.lit(0))
    newer_session = F.coalesce(F.col("r.session_at"), F.lit(0)) > F.coalesce(F.col("l.session_at"), F.lit(0))
    pick = lambda c: F.when(newer, F.coalesce(f"r.{c}", f"l.{c}")).otherwise(F.coalesce(f"l.{c}", f"r.{c}"))
    united = union_ordered("r.likes", "l.likes")
    likes = united if first_link else F.when(newer, _arr("r.likes")).otherwise(_arr("l.likes"))
    never = without(union_ordered("r.never", "l.never"), united) if first_link else F.when(newer, _arr("r.never")).otherwise(_arr("l.never"))
    session = lambda c: F.when(newer_session, F.col(f"r.{c}")).otherwise(F.coalesce(f"l.{c}", f"r.{c}"))
    return j.select(
        F.coalesce(f"l.{key}", f"r.{key}").alias(key), likes.alias("likes"), never.alias("never"), pick("recent").alias("recent"), pick("filters").alias("filters"),
        F.greatest(F.coalesce("l.prefs_at", F.lit(0)), F.coalesce("r.prefs_at", F.lit(0))).alias("prefs_at"), session("session").alias("session"), session("session_at").alias("session_at"),
    )


def restored(sessions: DataFrame, by: str, items: DataFrame, back: float = 3) -> DataFrame:
    """(by, history, item, medium, start) of saved sessions (by, history array, item, medium, at, playing) and playable items (item, media array of ids).

    Unknown and unplayable items leave the history (an array of struct(item, medium), each with its first medium, in order) and make item null; a
    medium that the item lacks gives way to its first; where playing goes on, it starts ``back`` seconds earlier, at 0 at the least.
    """
    first = items.select("item", F.col("media")[0].alias("medium"))
    past = sessions.select(by, F.posexplode("history").alias("place", "item")).join(first, "item")
    kept = past.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item", "medium"))), lambda s: F.struct(s["item"].alias("item"), s["medium"].alias("medium"))).alias("history"))
    now = sessions.drop("history").join(items, "item", "left")
    known = F.col("media").isNotNull()
    now = now.select(
        by,
        F.when(known, F.col("item")).alias("item"),
        F.when(known, F.when(F.array_contains("media", F.coalesce("medium", F.lit(""))), F.col("medium")).otherwise(F.col("media")[0])).alias("medium"),
        F.when(known, F.when(F.col("playing"), F.greatest(F.lit(0.0), F.coalesce("at", F.lit(0.0)) - back)).otherwise(F.coalesce("at", F.lit(0.0)))).alias("start"),
    )
    empty = F.array().cast(kept.schema["history"].dataType)
    return now.join(kept, by, "left").withColumn("history", F.coalesce("history", empty))


def valid_sessions(sessions: DataFrame, at: str, now, days: int, item: str, items: DataFrame, ident: str, page: str) -> DataFrame:
    """Sessions of the last ``days`` whose item is known or whose page is not empty."""
    known = items.select(F.col(ident).alias("__known")).distinct()
    recent = sessions.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    return recent.join(known, F.col(item) == F.col("__known"), "left").where(F.col("__known").isNotNull() | (F.coalesce(F.col(page), F.lit("")) != "")).drop("__known")
