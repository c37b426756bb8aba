"""Screening, ranking and denormalising candidate media per item; refresh, prune and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.similarity import relevance_udf
from .ranking import with_position

# Shortest and longest length in seconds, least relevance, media kept per item.
MIN_SECONDS, MAX_SECONDS, MIN_RELEVANCE, KEPT = 60, 720, 0.8, 3


def screened(candidates: DataFrame, deny: str | None = None, seconds: str = "seconds", embeddable: str = "embeddable", title: str = "title", bounds: tuple[float, float] = (MIN_SECONDS, MAX_SECONDS)) -> DataFrame:
    """Candidates that can be embedded, are of a length within the bounds (inclusive) and have no denied word in the title.

    Nulls in length or embeddable fail; a null title has no denied word. All predicates are built-in,
    so the numeric ones reach the scan.
    """
    kept = candidates.where(F.col(embeddable) & F.col(seconds).between(*bounds))
    return kept.where(~F.coalesce(F.col(title), F.lit("")).rlike(deny)) if deny else kept


def needles(native: str, latin: str, full: int = 10, least: int = 4) -> Column:
    """array<struct(needle, words)> of a song's titles: native, its first four words, Latin without number; skeletons cut to ``full``."""
    def trimmed(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, r"[,;:!?।॥—–\-‘’'\"()\s]+", " "))

    words = F.filter(F.split(trimmed(X.repair_vowels(F.coalesce(F.col(native), F.lit("")))), " "), lambda w: w != "")
    plain = F.regexp_replace(F.coalesce(F.col(latin), F.lit("")), r"\s+\d+$", "")
    all_of = F.struct(X.skeleton_native(F.array_join(words, " "), "pipeline").alias("needle"), F.size(words).alias("words"))
    first = F.struct(F.when(F.size(words) > 4, X.skeleton_native(F.array_join(F.slice(words, 1, 4), " "), "pipeline")).otherwise("").alias("needle"), F.lit(4).alias("words"))
    other = F.struct(X.skeleton_latin(plain).alias("needle"), F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != "")).alias("words"))
    short = F.transform(F.array(all_of, first, other), lambda s: F.struct(F.left(s["needle"], F.lit(full)).alias("needle"), s["words"].cast("int").alias("words")))
    return F.filter(short, lambda s: F.length(s["needle"]) >= least)


def relevance(needle_array: Column, title: str, channel: str, marker: str) -> Column:
    """How well a medium's title holds one of the needles; ``marker`` is a pattern that names the author."""
    text = X.repair_vowels(F.coalesce(F.col(title), F.lit("")))
    hays = F.array(X.skeleton_native(text, "pipeline"), X.skeleton_latin(F.regexp_replace(text, "[ঀ-৿]", " ")))
    marked = F.concat_ws(" ", F.col(title), F.col(channel)).rlike(marker)
    return relevance_udf(F.transform(needle_array, lambda s: s["needle"]), F.transform(needle_array, lambda s: s["words"]), hays, marked)


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """First n rows of each key in the given total order; the window's limit is pushed below the shuffle by Catalyst."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def nest(df: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """(key, name array<struct>) with the rows of each key in ``order``; meant for rows already limited per key."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *fields)))
    return df.groupBy(key).agg(F.transform(packed, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def has_media(column: Column | str) -> Column:
    """Null (not searched) and [] (none found) are false."""
    return F.coalesce(F.size(F.col(column) if isinstance(column, str) else column), F.lit(0)) > 0


def refreshed(nested: DataFrame, key: str, media: str, snapshot: DataFrame) -> DataFrame:
    """(key, media) with current figures: media missing from the snapshot or no longer embeddable are removed, the
    snapshot's non-null values win, order by views descending, then the old order. Null media stay null; no new screening."""
    fields = [f.name for f in nested.schema[media].dataType.elementType.fields]
    fresh = snapshot.where("embeddable").select("id", *[F.col(c).alias(f"new_{c}") for c in snapshot.columns if c not in ("id", "embeddable") and c in fields])
    rows = nested.where(F.col(media).isNotNull()).select(key, F.posexplode(media).alias("pos", "m")).select(key, "pos", "m.*").join(fresh, "id")
    merged = rows.select(key, "pos", *[F.coalesce(f"new_{f}", f).alias(f) if f"new_{f}" in fresh.columns else F.col(f) for f in fields])
    packed = F.array_sort(F.collect_list(F.struct((-F.coalesce(F.col("views"), F.lit(0))).alias("v"), "pos", F.struct(*fields).alias("m"))))
    kept = merged.groupBy(key).agg(F.transform(packed, lambda s: s["m"]).alias("kept"))
    return nested.select(key, media).join(kept, key, "left").select(key, F.when(F.col(media).isNotNull(), F.coalesce("kept", F.array().cast(nested.schema[media].dataType))).alias(media))


def pruned(df: DataFrame, column: str, fetched: str, cutoff) -> DataFrame:
    """Empties an array column of rows fetched before ``cutoff``; nulls and empty arrays stay as they are."""
    return df.withColumn(column, F.when((F.col(fetched) < F.lit(cutoff)) & (F.size(column) > 0), F.slice(column, 1, 0)).otherwise(F.col(column)))


def drop_empty(df: DataFrame, keep_empty: tuple[str, ...] = ("videos",)) -> DataFrame:
    """Empty strings and empty arrays to null, but for ``keep_empty``; JSON then omits them."""
    out = []
    for field in df.schema:
        c = F.col(field.name)
        kind = field.dataType.typeName()
        out.append((F.nullif(c, F.lit("")) if kind == "string" else F.when(F.size(c) > 0, c) if kind == "array" and field.name not in keep_empty else c).alias(field.name))
    return df.select(*out)


def catalogue_rows(base: DataFrame, media: DataFrame, popular: DataFrame, moods: DataFrame, canonical_modes: dict[str, str]) -> DataFrame:
    """The published fields of ``base`` with its dimensions: rank and alias (``popular``: id, pop, alias), moods (id, moods; [] where none), media (id, videos; null where
    never searched). The romanised text is left out. Dimensions are joined as Catalyst sees fit."""
    j = base.join(popular.select("id", "pop", "alias"), "id", "left").join(moods.select("id", "moods"), "id", "left").join(media.select("id", "videos"), "id", "left")
    season = F.when(F.col("parjay") == "Prakriti", F.col("season"))
    return j.select(
        "id", F.col("title_bn").alias("bn"), F.col("title_en").alias("en"), "parjay", F.col("sub_parjay").alias("sub"), season.alias("season"), "drama", X.simplify_mode("raag_full", canonical_modes).alias("raag"), F.col("raag_full").alias("raagFull"),
        "taal", "written", F.col("lyrics_bn").alias("lyrics"), "source", F.coalesce("moods", F.array().cast("array<string>")).alias("moods"), "pop", "alias", "videos",
    )


def export_document(df: DataFrame, name: str, order: str, meta: Column | None = None) -> DataFrame:
    """One row, one column ``document``: {"meta": {..., "count": n}, name: [rows in order]}, as a small published file needs.

    The whole table goes into one value, so it is for published catalogues only; write large tables by rows.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*df.columns).alias("r"))))
    packed = df.agg(F.count("*").alias("count"), F.transform(rows, lambda s: s["r"]).alias("rows"))
    about = F.struct(F.col("count"), *( [meta.alias("info")] if meta is not None else []))
    return packed.select(F.to_json(F.struct(about.alias("meta"), F.col("rows").alias(name))).alias("document"))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The same rows; raises at once if a key occurs twice. Keys are counted before the shuffle, and rows stay where they are."""
    twice = duplicates(df.select(key), key).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0][key]}")
    return df


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both with the latest version of each key; of equal versions the newer input's."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return top_per_key(both, key, [F.col(version).desc_nulls_last(), F.col("__new").desc()], 1).drop("rank", "__new")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def within_budget(df: DataFrame, order: list[Column], cost: Column, budget: int, room: int) -> DataFrame:
    """Rows of a work queue in order while what went before leaves ``room`` in the budget; adds used_before.

    The running total goes over range partitions (``with_position``), so a queue of any length is no single task.
    """
    placed = with_position(df.withColumn("cost", cost), order, F.col("cost"))
    return placed.withColumnRenamed("total_before", "used_before").where(F.col("used_before") + room <= budget)


def first_filled(df: DataFrame, group: str, order: list[Column], fields: list[str]) -> DataFrame:
    """One row per group: of each field the first value that is neither null nor empty, in ascending order of the columns given.

    A mergeable aggregate, so a group of any size is combined before the shuffle."""
    filled = lambda f: F.nullif(F.col(f), F.lit("")) if dict(df.dtypes)[f] == "string" else F.col(f)
    return df.groupBy(group).agg(*[F.min_by(f, F.when(filled(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])


def id_batches(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """(batch, keys, digest): distinct keys in order, ``size`` to a batch, with the md5 of the keys joined by '|' as cache key."""
    numbered = with_position(df.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key).asc()]).withColumnRenamed("position", "n")
    grouped = numbered.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", key))), lambda s: s[key]).alias("keys"))
    return grouped.withColumn("digest", F.md5(F.concat_ws("|", "keys")))
