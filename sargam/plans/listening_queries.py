"""Queries over singers, listeners' choices, saved sessions and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, facets, lexicon, ranking, state, vectors
from ..session import table
from .catalog_queries import uniform_sql
from .registry import query
from .shared import KEPT_SQL, flagged, kept_videos

GENERIC = r"(?i)various|unknown|release"

SUNG_SQL = """
hits AS (SELECT ord, list(name ORDER BY so) AS l FROM (SELECT DISTINCT v.ord, w.name, w.so FROM videos v JOIN (SELECT s.name, s.ord AS so, unnest(s.spellings) AS w FROM singers s) w
  ON contains(lower(concat_ws(' ', v.title, v.channel)), lower(w.w))) GROUP BY 1),
topic AS (SELECT ord, list_filter(list_transform(string_split_regex(n, '\\s*[|,&]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS l
  FROM (SELECT ord, regexp_extract(channel, '^(.+?) - Topic$', 1) AS n FROM videos WHERE channel LIKE '% - Topic') WHERE n <> '' AND NOT regexp_matches(n, '(?i)various|unknown|release')),
sung AS (SELECT v.ord, v.song_id, v.id, coalesce(h.l, CASE WHEN len(t.l) <= 2 THEN t.l ELSE t.l[1:1] END, []) AS singers FROM videos v LEFT JOIN hits h USING (ord) LEFT JOIN topic t USING (ord))
"""


def sung(spark, root, videos):
    """Videos with ``singers``: entries of the dictionary that title or channel holds, else the performers an automatic artist channel names."""
    hits = lexicon.dictionary_hits(videos, "ord", ["title", "channel"], table(spark, root, "singers"), "name", "ord", "spellings")
    return videos.join(hits, "ord", "left").withColumn("singers", F.coalesce("names", X.topic_performers("channel", GENERIC))).drop("names")


def sung_catalogue(spark, root):
    """Songs with ``singers``, those of their kept videos, each once."""
    kept = sung(spark, root, kept_videos(spark, root))
    per_song = kept.select("song_id", F.explode("singers").alias("singer")).distinct().groupBy("song_id").agg(F.array_sort(F.collect_list("singer")).alias("singers"))
    songs = flagged(spark, root)
    return songs.join(per_song, songs.id == per_song.song_id, "left").drop("song_id").withColumn("singers", F.coalesce("singers", F.array().cast("array<string>")))


_SUNG_CAT = f"""{KEPT_SQL}, {SUNG_SQL},
by_song AS (SELECT k.song_id, list(DISTINCT s.x) AS singers FROM kept k JOIN (SELECT ord, unnest(singers) AS x FROM sung) s USING (ord) GROUP BY 1),
sc AS (SELECT cat.*, coalesce(b.singers, []) AS singers FROM cat LEFT JOIN by_song b ON b.song_id = cat.id)"""


@query(f"WITH {SUNG_SQL} SELECT ord, array_to_string(singers, '|') AS singers FROM sung")
def video_singers(spark, root):
    return sung(spark, root, table(spark, root, "videos")).select("ord", F.array_join("singers", "|").alias("singers"))


@query(f"WITH {_SUNG_CAT} SELECT value, count(*) AS n, sum(playable::INT)::BIGINT AS rec, floor(100.0 * sum(playable::INT) / count(*) + 0.5)::BIGINT AS share FROM (SELECT id, playable, unnest(singers) AS value FROM sc) GROUP BY 1")
def singer_browse(spark, root):
    """Singers with the songs that a kept video has them on."""
    c = sung_catalogue(spark, root)
    return facets.browse_groups(c, F.col("singers"), F.col("playable"))


@query(f"WITH {_SUNG_CAT} SELECT id FROM sc WHERE list_contains(singers, 'Bemala Chhoguho') OR list_contains(singers, 'Salekha Phidhurana')")
def sung_by(spark, root):
    """Songs that a kept video of one of two singers has: a semi-join."""
    kept = sung(spark, root, kept_videos(spark, root)).where(F.arrays_overlap("singers", F.array(F.lit("Bemala Chhoguho"), F.lit("Salekha Phidhurana"))))
    return table(spark, root, "songs").join(kept.select(F.col("song_id").alias("id")), "id", "left_semi").select("id")


CHOICE = facets.FacetState({"moods": ["calm", "devotion", "joy", "sorrow", "longing"]})
_NEVER, _LIKED = "id IN (SELECT song_id FROM videos WHERE views < 20 AND song_id IS NOT NULL)", "id IN (SELECT song_id FROM videos WHERE likes >= 100 AND song_id IS NOT NULL)"


def _choices(spark, root):
    v = table(spark, root, "videos")
    lists = [v.where(c).select(F.col("song_id").alias("id")).where("id is not null").distinct() for c in ("views < 20", "likes >= 100")]
    return sung_catalogue(spark, root), *lists


def _facets(c):
    return [facets.Facet("moods", facets.values_of(c, "moods")), facets.Facet("singer", F.col("singers")), facets.Facet("raag", facets.values_of(c, "raag"))]


_MOODS = "list_has_any(coalesce(moods, []::VARCHAR[]), ['calm', 'devotion', 'joy', 'sorrow', 'longing'])"


@query(f"WITH {_SUNG_CAT} SELECT id FROM sc WHERE playable AND NOT ({_NEVER}) AND {_LIKED} AND {_MOODS} AND len(singers) > 0 AND list_contains(singers, (SELECT value FROM (SELECT unnest(singers) AS value FROM sc) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")
def listener_pool(spark, root):
    """What a listener may hear with all terms set: playable, not hidden, liked, of a mood, and by the most frequent singer."""
    c, never, liked = _choices(spark, root)
    top = c.select(F.explode("singers").alias("s")).groupBy("s").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "s").limit(1).collect()  # one name
    chosen = CHOICE.with_value("singer", [r["s"] for r in top] or [""])
    return facets.facet_pool(facets.for_listener(c, "id", never, liked), _facets(c), chosen, F.col("playable")).select("id")


@query(f"""WITH {_SUNG_CAT}, p AS (SELECT * FROM sc WHERE playable AND NOT ({_NEVER}))
SELECT 'moods' AS facet, value, count(*) AS n FROM (SELECT DISTINCT id, unnest(moods) AS value FROM p) GROUP BY value
UNION ALL SELECT 'singer', value, sum(hit)::BIGINT FROM (SELECT unnest(singers) AS value, ({_MOODS})::INT AS hit FROM p) GROUP BY value
UNION ALL SELECT 'raag', raag, sum(({_MOODS})::INT)::BIGINT FROM p WHERE raag <> '' GROUP BY raag""")
def listener_counts(spark, root):
    c, never, _ = _choices(spark, root)
    return facets.facet_counts(facets.for_listener(c, "id", never), _facets(c), CHOICE, F.col("playable"))


@query(f"""WITH {KEPT_SQL} SELECT id, row_number() OVER (ORDER BY playable DESC, ord) - 1 AS place FROM cat""")
def playable_first(spark, root):
    """Songs with recordings before those without, both in catalogue order."""
    placed = ranking.with_position(flagged(spark, root).select("id", "ord", "playable"), [F.col("playable").desc(), F.col("ord").asc()])
    return placed.select("id", F.col("position").alias("place"))


@query(f"""WITH {KEPT_SQL} SELECT song_id, arg_min(id, (-ln({uniform_sql(5, 'song_id', 'id')}) / sqrt(coalesce(views, 0) + 1), id)) AS id FROM kept GROUP BY 1""")
def recording_pick(spark, root):
    """One recording for each song, by the square root of its views."""
    kept = kept_videos(spark, root).select("song_id", "id", "views")
    return ranking.picked_per_key(kept, "song_id", "id", F.sqrt(F.coalesce("views", F.lit(0)) + 1), 5).select("song_id", "id")


@query(f"""WITH {KEPT_SQL}, media AS (SELECT s.ord AS k, s.id AS item, list(v.id ORDER BY v.rank) AS media FROM kept v JOIN songs s ON s.id = v.song_id GROUP BY 1, 2),
e AS (SELECT user_id, event_id, ts, value, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
past AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM e QUALIFY back BETWEEN 2 AND 31),
hist AS (SELECT user_id, string_agg(item || ':' || media[1], ',' ORDER BY back) AS history FROM past JOIN media USING (k) GROUP BY 1)
SELECT l.user_id, m.item, CASE WHEN l.event_type IN ('view', 'click') THEN m.media[len(m.media)] ELSE m.media[1] END AS medium,
CASE WHEN m.item IS NOT NULL THEN CASE WHEN l.event_type = 'view' THEN greatest(0.0, l.value - 3) ELSE l.value END END AS start, coalesce(h.history, '') AS history
FROM last l LEFT JOIN media m USING (k) LEFT JOIN hist h ON h.user_id = l.user_id""")
def session_restore(spark, root):
    """Each user's last event as a saved session, the thirty before it as history; some sessions name a medium, some an unknown one."""
    kept = catalog.nest(kept_videos(spark, root), "song_id", "rank", ["id"], "kept")
    songs = table(spark, root, "songs").select("id", F.col("ord").alias("k"))
    media = kept.join(songs, kept.song_id == songs.id).select("k", F.col("id").alias("item"), F.transform("kept", lambda v: v["id"]).alias("media"))
    e = table(spark, root, "events").select("user_id", "event_id", "ts", "value", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    named = e.join(media.select("k", "item", F.element_at("media", -1).alias("last")), "k", "left").withColumn("item", F.coalesce("item", F.lit("unknown")))
    recent = catalog.top_per_key(named, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 31)
    sessions = recent.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "item")))), lambda s: s["item"]).alias("history"),
        *[F.max(F.when(F.col("rank") == 1, c)).alias(n) for n, c in (("item", F.col("item")), ("medium", F.when(F.col("event_type").isin("view", "click"), F.col("last")).otherwise(F.lit("gone"))), ("at", F.col("value")), ("playing", F.col("event_type") == "view"))],
    )
    back = state.restored(sessions, "user_id", media.select("item", "media"))
    return back.select("user_id", "item", "medium", "start", F.array_join(F.transform("history", lambda s: F.concat(s["item"], F.lit(":"), s["medium"])), ",").alias("history"))


@query("""WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY length(coalesce(text, '')), doc_id) - 1 AS k FROM documents)
SELECT k // 32 AS batch, count(*) AS n, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest FROM p GROUP BY 1""")
def length_batches(spark, root):
    batches = ranking.length_batches(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    return batches.groupBy("batch").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query("""WITH q AS (SELECT label AS entry, list(embedding) AS e FROM embeddings GROUP BY label), m AS (SELECT entry, list_transform(range(1, 65), lambda i: (list_sum(list_transform(e, lambda v: v[i]::DOUBLE)) / len(e))) AS v FROM q),
a AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT vec_id, entry, list_inner_product(x, v) AS sim FROM a, m),
moods AS (SELECT vec_id, 'mood' AS kind, entry::BIGINT AS entry, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, entry) AS place, sim >= max(sim) OVER (PARTITION BY vec_id) - 0.05 AS picked FROM s QUALIFY place <= 3 OR picked),
t AS (SELECT a.vec_id, e.vec_id AS entry, list_inner_product(a.x, e.embedding::DOUBLE[]) * CASE WHEN d.text <> '' THEN 1 ELSE 0 END AS sim FROM a, embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
texts AS (SELECT vec_id, 'text' AS kind, entry, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, entry) AS place, false AS picked FROM t QUALIFY place <= 4)
SELECT vec_id, kind, entry, round(sim, 6) AS sim, place, picked FROM moods UNION ALL SELECT vec_id, kind, entry, round(sim, 6), place, picked FROM texts""")
def vector_evaluation(spark, root):
    """For every twentieth vector as a question: the nearest moods, which of them are picked, and the nearest rows that have a text."""
    e = table(spark, root, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("asked"), "embedding")
    centres = vectors.centroids(e, "label", "embedding", "v").withColumnRenamed("label", "entry")
    has_text = table(spark, root, "documents").where("text <> ''").select(F.col("doc_id").alias("vec_id"), F.lit(1.0).alias("has"))
    songs = vectors.similarities(e, "vec_id", "embedding", asked, "asked", "embedding").join(has_text, "vec_id", "left").withColumn("sim", F.col("sim") * F.coalesce("has", F.lit(0.0)))
    moods = vectors.similarities(asked, "asked", "embedding", centres, "entry", "v").select(F.col("asked").alias("vec_id"), F.col("entry").cast("bigint").alias("entry"), "sim")
    return vectors.evaluation(moods, songs.select(F.col("asked").alias("vec_id"), F.col("vec_id").alias("entry"), "sim"), "vec_id", "entry", 0.05)
