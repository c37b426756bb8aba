"""Frames and SQL that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..session import table

DENY = r"(?i)compilation|full album|live 20\d\d"


def kept_videos(spark: SparkSession, root: str) -> DataFrame:
    """The three most viewed of each song's videos that pass the screen."""
    videos = table(spark, root, "videos").where("song_id is not null and id is not null")
    order = [F.coalesce("views", F.lit(-1)).desc(), F.col("ord").asc()]
    return catalog.top_per_key(catalog.screened(videos, DENY), "song_id", order, 3)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Songs with their kept videos nested; null where none was ever fetched, [] where none passed."""
    videos = catalog.nest(kept_videos(spark, root), "song_id", "rank", ["id", "title", "channel", "views", "likes", "seconds"], "kept")
    seen = table(spark, root, "videos").where("song_id is not null and id is not null").select("song_id").distinct().withColumn("seen", F.lit(True))
    songs = table(spark, root, "songs").join(seen, F.col("id") == F.col("song_id"), "left").drop("song_id")
    joined = songs.join(videos, F.col("id") == F.col("song_id"), "left").drop("song_id")
    empty = F.array().cast(joined.schema["kept"].dataType)
    return joined.withColumn("videos", F.when(F.col("seen"), F.coalesce("kept", empty))).drop("kept", "seen").withColumn("playable", catalog.has_media("videos"))


def flagged(spark: SparkSession, root: str) -> DataFrame:
    """Songs with ``playable`` only: whether any video passes the screen. Ranking and nesting are not needed for that."""
    videos = table(spark, root, "videos").where("song_id is not null and id is not null")
    some = catalog.screened(videos, DENY).select("song_id").distinct().withColumn("some", F.lit(True))
    songs = table(spark, root, "songs")
    return songs.join(some, songs.id == some.song_id, "left").withColumn("playable", F.coalesce("some", F.lit(False))).drop("song_id", "some")


KEPT_SQL = """
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY coalesce(views, -1) DESC, ord) AS rank
    FROM videos
    WHERE song_id IS NOT NULL AND id IS NOT NULL AND embeddable AND seconds BETWEEN 60 AND 720
      AND NOT regexp_matches(coalesce(title, ''), '(?i)compilation|full album|live 20\\d\\d')
  ) WHERE rank <= 3
), seen AS (SELECT DISTINCT song_id FROM videos WHERE song_id IS NOT NULL AND id IS NOT NULL),
cat AS (
  SELECT s.*, k.song_id IS NOT NULL AS playable, e.song_id IS NOT NULL AS searched, coalesce(k.n, 0) AS n_videos, k.top_views, k.ids
  FROM songs s
  LEFT JOIN (SELECT song_id, count(*) AS n, max(views) AS top_views, string_agg(id, ',' ORDER BY rank) AS ids FROM kept GROUP BY 1) k ON s.id = k.song_id
  LEFT JOIN seen e ON s.id = e.song_id
)
"""
