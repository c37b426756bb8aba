"""Queries over the catalogue: build, browse, facets, search, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, facets, ranking, search
from ..session import table
from .registry import query
from .shared import KEPT_SQL, catalogue, flagged

MOOD_WEIGHTS = {"calm": 1.0, "sorrow": 0.7, "devotion": 0.4, "joy": 0.6}


@query(f"""WITH {KEPT_SQL}
SELECT id, coalesce(nullif(bn, ''), nullif(en, ''), id) AS title, parjay, pop, CASE WHEN searched THEN n_videos END AS n_videos, playable, top_views, ids AS video_ids, coalesce(array_to_string(moods, ','), '') AS mood_list
FROM cat""")
def catalog_build(spark, root):
    c = catalogue(spark, root)
    return c.select(
        "id", X.display_title("bn", "en", "id").alias("title"), "parjay", "pop",
        F.when(F.col("videos").isNotNull(), F.size("videos")).cast("bigint").alias("n_videos"), "playable",
        F.array_max(F.transform("videos", lambda v: v["views"])).alias("top_views"),
        F.when(F.col("playable"), F.array_join(F.transform("videos", lambda v: v["id"]), ",")).alias("video_ids"),
        F.coalesce(F.array_join("moods", ","), F.lit("")).alias("mood_list"),
    )


@query("""SELECT l_partkey, l_extendedprice, rank FROM (
  SELECT l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS rank
  FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag <> 'R') WHERE rank <= 3""")
def topk_candidates(spark, root):
    rows = table(spark, root, "lineitem").where("l_quantity between 10 and 12 and l_returnflag <> 'R'").select("l_partkey", "l_extendedprice")
    return catalog.top_per_key(rows, "l_partkey", [F.col("l_extendedprice").desc()], 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH k AS (
  SELECT l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS rank
  FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag <> 'R') WHERE rank <= 3)
SELECT p_brand, count(*) AS n, count(n_media) AS rec, floor(100.0 * count(n_media) / count(*) + 0.5)::BIGINT AS share
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_media FROM k GROUP BY 1) ON p_partkey = l_partkey GROUP BY p_brand""")
def star_catalog(spark, root):
    kept = catalog.top_per_key(table(spark, root, "lineitem").where("l_quantity between 10 and 12 and l_returnflag <> 'R'").select("l_partkey", "l_extendedprice"), "l_partkey", [F.col("l_extendedprice").desc()], 3)
    media = catalog.nest(kept, "l_partkey", "rank", ["l_extendedprice"], "media")
    parts = table(spark, root, "part").select("p_partkey", "p_brand").join(media, F.col("p_partkey") == F.col("l_partkey"), "left")
    return facets.browse_groups(parts, F.array("p_brand"), catalog.has_media("media")).withColumnRenamed("value", "p_brand")


@query(f"""WITH {KEPT_SQL}
SELECT value, count(*) AS n, sum(playable::INT)::BIGINT AS rec, floor(100.0 * sum(playable::INT) / count(*) + 0.5)::BIGINT AS share
FROM (SELECT DISTINCT id, playable, unnest(moods) AS value FROM cat) GROUP BY value""")
def group_browse(spark, root):
    c = flagged(spark, root)
    return facets.browse_groups(c, facets.values_of(c, "moods"), F.col("playable"))


@query("""SELECT parjay, sub AS value, count(*) AS n FROM songs WHERE sub <> '' GROUP BY 1, 2""")
def sub_groups(spark, root):
    songs = table(spark, root, "songs").where("sub <> ''")
    return songs.groupBy("parjay", F.col("sub").alias("value")).agg(F.count("*").alias("n")).orderBy("parjay", F.col("n").desc(), ranking.name_order("value"))


@query("SELECT id, pop FROM songs WHERE pop IS NOT NULL ORDER BY pop, ord")
def popular_order(spark, root):
    return table(spark, root, "songs").where("pop is not null").orderBy("pop", "ord").select("id", "pop")


@query("""SELECT season, count(*) AS n, list_position(['Grishma', 'Barsha', 'Sharat', 'Hemanta', 'Sheet', 'Basanta'], season)::BIGINT AS place
FROM songs WHERE season <> '' GROUP BY 1""")
def season_order(spark, root):
    from ..functions.calendar import SEASONS

    seasons = table(spark, root, "songs").where("season <> ''").groupBy("season").agg(F.count("*").alias("n"))
    return seasons.withColumn("place", ranking.enumerated_order("season", [s for s, _ in SEASONS]).cast("bigint")).orderBy("place")


def _facets(c):
    return [facets.Facet(n, facets.values_of(c, n)) for n in ("moods", "parjay", "season", "raag")]


STATE = facets.FacetState({"moods": ["calm", "devotion", "joy"], "parjay": ["Puja", "Prem"]})
_MOODS = "list_has_any(coalesce(moods, []::VARCHAR[]), ['calm', 'devotion', 'joy'])"
_PARJAY = "coalesce(parjay IN ('Puja', 'Prem'), false)"


@query(f"WITH {KEPT_SQL} SELECT id FROM cat WHERE playable AND {_MOODS} AND {_PARJAY}")
def facet_pool(spark, root):
    c = flagged(spark, root)
    return facets.facet_pool(c, _facets(c), STATE, F.col("playable")).select("id")


@query(f"""WITH {KEPT_SQL}, p AS (SELECT * FROM cat WHERE playable)
SELECT 'moods' AS facet, value, sum(hit)::BIGINT AS n FROM (SELECT DISTINCT id, unnest(moods) AS value, {_PARJAY}::INT AS hit FROM p) GROUP BY value
UNION ALL SELECT 'parjay', parjay, sum(({_MOODS})::INT)::BIGINT FROM p WHERE parjay <> '' GROUP BY parjay
UNION ALL SELECT 'season', season, sum(({_MOODS} AND {_PARJAY})::INT)::BIGINT FROM p WHERE season <> '' GROUP BY season
UNION ALL SELECT 'raag', raag, sum(({_MOODS} AND {_PARJAY})::INT)::BIGINT FROM p WHERE raag <> '' GROUP BY raag""")
def facet_counts(spark, root):
    c = flagged(spark, root)
    return facets.facet_counts(c, _facets(c), STATE, F.col("playable"))


@query("""WITH f AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer)
SELECT c_custkey, 'moods' AS facet, m AS value FROM (SELECT c_custkey, unnest(CASE WHEN c_nationkey % 3 = 0 THEN ['calm', 'joy'] WHEN c_nationkey % 3 = 1 THEN ['sorrow'] ELSE [] END) AS m FROM f)
UNION ALL SELECT c_custkey, 'raag', c_mktsegment FROM f WHERE c_acctbal > 0
UNION ALL SELECT c_custkey, 'liked', 'true' FROM f WHERE c_nationkey % 2 = 0""")
def active_filters(spark, root):
    """The filters that each listener has set, a row for each that can be taken off."""
    c = table(spark, root, "customer")
    none = F.array().cast("array<string>")
    moods = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("calm"), F.lit("joy"))).when(F.col("c_nationkey") % 3 == 1, F.array(F.lit("sorrow"))).otherwise(none)
    saved = c.select("c_custkey", moods.alias("moods"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("raag"), (F.col("c_nationkey") % 2 == 0).alias("liked"))
    return facets.active_filters(saved, "c_custkey", ["moods", "raag", "liked"])


@query(f"""WITH {KEPT_SQL}
SELECT season, count(*) AS total, sum(playable::INT)::BIGINT AS playable FROM cat WHERE season <> '' GROUP BY season""")
def season_counts(spark, root):
    return flagged(spark, root).where("season <> ''").groupBy("season").agg(F.count("*").alias("total"), F.sum(F.col("playable").cast("int")).alias("playable"))


@query(f"""WITH {KEPT_SQL}
SELECT 'mood' AS kind, value, count(*) AS n FROM (SELECT DISTINCT id, unnest(moods) AS value FROM cat) GROUP BY value
UNION ALL SELECT 'parjay', parjay, count(*) FROM cat WHERE parjay <> '' GROUP BY parjay
UNION ALL SELECT 'taal', taal, count(*) FROM cat WHERE taal <> '' GROUP BY taal""")
def kinds_explode(spark, root):
    c = flagged(spark, root)
    def tagged(kind, column):
        return F.transform(F.array_distinct(facets.values_of(c, column)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    kinds = F.flatten(F.array(tagged("mood", "moods"), tagged("parjay", "parjay"), tagged("taal", "taal")))
    return c.select(F.explode(kinds).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


@query("""SELECT raag AS value, count(*) AS n FROM songs WHERE raag <> '' GROUP BY 1
QUALIFY row_number() OVER (ORDER BY (raag = 'Mebela') DESC, raag) <= 10""")
def name_pills(spark, root):
    counts = table(spark, root, "songs").where("raag <> ''").groupBy(F.col("raag").alias("value")).agg(F.count("*").alias("n"))
    return facets.name_options(counts, F.lit(0), "Mebela", 10).select("value", "n")


_RUNS = "list_reduce(string_split(%s, ''), lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END)"


def latin_skeleton_sql(c: str) -> str:
    out = f"regexp_replace(lower(coalesce({c}, '')), '[^a-z]', '', 'g')"
    for a, b in X.LATIN_REWRITES:
        out = f"replace({out}, '{a}', '{b}')"
    return _RUNS % f"regexp_replace({out}, '[aeiouh]', '', 'g')"


def native_skeleton_sql(c: str, variant: str = "site") -> str:
    out = f"coalesce({c}, '')"
    for one, base in (("ড়", "ড"), ("ঢ়", "ঢ"), ("য়", "য")):
        out = f"replace({out}, '{one}', '{base}়')"
    out = f"replace({out}, 'য়', '')"
    if variant == "site":
        out = f"replace(replace({out}, 'ড়', 'র'), 'ঢ়', 'র')"
    letters = "".join(X.SKELETON_CLASSES[variant].values())
    to = "".join(k * len(v) for k, v in X.SKELETON_CLASSES[variant].items())
    return _RUNS % f"translate(regexp_replace({out}, '[^{letters}]', '', 'g'), '{letters}', '{to}')"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(nfc_normalize({c})), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT ord, id, {norm_sql("concat_ws(' ', bn, en)")} AS title, {norm_sql("coalesce(lyrics, '')")} AS words,
  {native_skeleton_sql("bn")} AS s1, {latin_skeleton_sql("en")} AS s2, {native_skeleton_sql("lyrics")} AS sl FROM songs),
q AS (SELECT 'nodi pothe' AS q, {latin_skeleton_sql("'nodi pothe'")} AS qs)
SELECT id, tier::BIGINT AS tier FROM (SELECT id, CASE WHEN starts_with(title, q) THEN 1 WHEN contains(title, q) THEN 2
  WHEN length(qs) >= 4 AND ((s1 <> '' AND starts_with(s1, qs)) OR (s2 <> '' AND starts_with(s2, qs))) THEN 3
  WHEN length(qs) >= 4 AND (contains(s1, qs) OR contains(s2, qs)) THEN 4
  WHEN contains(words, q) OR (length(qs) >= 5 AND contains(sl, qs)) THEN 5 END AS tier FROM t, q) WHERE tier IS NOT NULL""")
def search_tiers(spark, root):
    projected = search.search_projection(table(spark, root, "songs").select("ord", "id", "bn", "en", "lyrics"), "bn", "en", "lyrics")
    return search.search(projected, "Nodi  Pothe").orderBy("tier", "ord").select("id", F.col("tier").cast("bigint").alias("tier"))


SEARCHES = ("saastil", "Sastil", "সাস্তিল", "haowa", "হাওয়া", "prithik", "tellagher", "টেলাঘের", "মনে আসে", "")


def _search_sql(q: str) -> str:
    native = any("\u0980" <= c <= "\u09ff" for c in q)
    skeleton = native_skeleton_sql(f"'{q}'") if native else latin_skeleton_sql(f"'{q}'")
    return f"""SELECT '{q}' AS query, id, CASE WHEN starts_with(title, q) THEN 1 WHEN contains(title, q) THEN 2
  WHEN length(qs) >= 4 AND ((s1 <> '' AND starts_with(s1, qs)) OR (s2 <> '' AND starts_with(s2, qs))) THEN 3
  WHEN length(qs) >= 4 AND (contains(s1, qs) OR contains(s2, qs)) THEN 4
  WHEN contains(words, q) OR (length(qs) >= 5 AND contains(sl, qs)) THEN 5 END::BIGINT AS tier FROM t, (SELECT {norm_sql(f"'{q}'")} AS q, {skeleton} AS qs) WHERE q <> ''"""


@query(f"""WITH t AS (SELECT ord, id, {norm_sql("concat_ws(' ', bn, en)")} AS title, {norm_sql("coalesce(lyrics, '')")} AS words,
  {native_skeleton_sql("bn")} AS s1, {latin_skeleton_sql("en")} AS s2, {native_skeleton_sql("lyrics")} AS sl FROM songs)
SELECT * FROM ({' UNION ALL '.join(map(_search_sql, SEARCHES))}) WHERE tier IS NOT NULL""")
def searches(spark, root):
    """Ten searches in either script, misspelled ones among them, that reach every tier; an empty one finds nothing."""
    projected = search.search_projection(table(spark, root, "songs").select("ord", "id", "bn", "en", "lyrics"), "bn", "en", "lyrics")
    found = [search.search(projected, q).select(F.lit(q).alias("query"), "id", F.col("tier").cast("bigint").alias("tier")) for q in SEARCHES]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


@query(f"""WITH n AS (SELECT ord, name, {norm_sql("name")} AS w, {latin_skeleton_sql("name")} AS s FROM singers)
SELECT name, CASE WHEN starts_with(w, 'jhi') THEN 0 WHEN contains(w, 'jhi') THEN 1 WHEN contains(s, 'jk') AND length('jk') >= 3 THEN 2 END AS bucket
FROM n WHERE contains(w, 'jhi')""")
def name_search(spark, root):
    names = table(spark, root, "singers").withColumn("w", X.norm("name")).withColumn("s", X.skeleton_latin("name"))
    return names.withColumn("bucket", search.name_bucket(F.col("w"), F.col("s"), "jhi", "j")).where("bucket is not null").orderBy("bucket", "ord").select("name", "bucket")


@query(f"""WITH {KEPT_SQL}, f AS (SELECT id, ord, coalesce(moods, []::VARCHAR[]) AS m, nullif(raag, '') AS md, nullif(parjay, '') AS ca, nullif(sub, '') AS su, nullif(season, '') AS se, nullif(taal, '') AS be, playable, pop FROM cat),
p AS (SELECT a.id AS item, b.id AS other, b.ord AS o2, b.playable AS pl, b.pop IS NOT NULL AS po,
  3.0 * len(list_filter(b.m, lambda x: list_contains(a.m, x))) + CASE WHEN a.md = b.md THEN 3 ELSE 0 END
  + CASE WHEN a.su = b.su AND a.ca = b.ca THEN 2 WHEN a.ca = b.ca THEN 1 ELSE 0 END + CASE WHEN a.se = b.se THEN 2 ELSE 0 END + CASE WHEN a.be = b.be THEN 0.5 ELSE 0 END AS base
  FROM f a JOIN f b ON a.id <> b.id)
SELECT item, other, (base + CASE WHEN pl THEN 1.5 ELSE 0 END + CASE WHEN po THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM p WHERE base >= 4
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, o2) <= 10""")
def related_items(spark, root):
    c = flagged(spark, root)
    return ranking.related(c, "id", "ord", "moods", "raag", "parjay", "sub", "season", "taal", F.col("playable"), F.col("pop").isNotNull()).select("item", "other", "score")


_W = "CASE x WHEN 'calm' THEN 1.0 WHEN 'sorrow' THEN 0.7 WHEN 'devotion' THEN 0.4 WHEN 'joy' THEN 0.6 ELSE 0 END"


@query(f"""WITH {KEPT_SQL}, f AS (SELECT id, ord, season, pop, list_sum(list_transform(coalesce(moods, []::VARCHAR[]), lambda x, i: ({_W})::DOUBLE * CASE WHEN i = 1 THEN 1 ELSE 0.75 END)) AS fit, coalesce(season = 'Barsha', false) AS ins FROM cat WHERE playable)
SELECT id, round(2 * coalesce(fit, 0) + ins::INT + CASE WHEN pop > 0 THEN 0.4 * (1 - pop / 400.0) ELSE 0 END, 6) AS score FROM f WHERE fit > 0 OR ins
QUALIFY row_number() OVER (ORDER BY round(2 * coalesce(fit, 0) + ins::INT + CASE WHEN pop > 0 THEN 0.4 * (1 - pop / 400.0) ELSE 0 END, 9) DESC, ord) <= 25""")
def playlist_score(spark, root):
    c = flagged(spark, root)
    return ranking.playlist(c, MOOD_WEIGHTS, "Barsha", 25).select("id", F.round("score", 6).alias("score"))


@query("""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY pop, ord) - 1 AS p, count(*) OVER () AS n FROM songs WHERE pop IS NOT NULL) WHERE p = dayofyear(DATE '2024-03-15') % n""")
def item_of_day(spark, root):
    songs = table(spark, root, "songs").withColumn("by", F.struct("pop", "ord")).where("pop is not null")
    return ranking.item_of_day(songs, "by", "2024-03-15").select("id")


@query(f"""WITH {KEPT_SQL}, q AS (SELECT id, bn, pop, row_number() OVER (ORDER BY ord) - 1 AS place FROM cat WHERE playable AND season = 'Barsha')
SELECT id, row_number() OVER (ORDER BY CASE place WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END, coalesce(pop, 9999), id) AS nth FROM q
QUALIFY nth <= 25""")
def queue_order(spark, root):
    q = ranking.with_position(flagged(spark, root).where("playable and season = 'Barsha'").select("id", "pop", "ord"), [F.col("ord").asc()]).withColumnRenamed("position", "place")
    order = ranking.queue_order(F.col("place"), F.lit(3), F.col("pop"), "id")
    return ranking.with_position(q, order).where("position < 25").select("id", (F.col("position") + 1).alias("nth"))


@query("SELECT id FROM songs ORDER BY ord LIMIT 300 OFFSET 120")
def second_page(spark, root):
    return ranking.page(table(spark, root, "songs"), [F.col("ord").asc()], number=1).select("id")


@query(f"""WITH {KEPT_SQL}, q AS (SELECT id, ord, CASE WHEN pop IS NOT NULL THEN 0 WHEN season = 'Sharat' THEN 1 WHEN season = 'Hemanta' THEN 2 ELSE 3 END AS tier, season, pop FROM songs),
r AS (SELECT *, 101 * CASE WHEN tier = 0 THEN 2 ELSE 1 END AS cost, row_number() OVER (ORDER BY tier, (coalesce(season, '') = '')::INT, coalesce(pop, 9999), ord) AS k FROM q)
SELECT id, used_before::BIGINT AS used_before FROM (SELECT id, coalesce(sum(cost) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM r) WHERE used_before + 202 <= 9800""")
def budget_cutoff(spark, root):
    tier = F.when(F.col("pop").isNotNull(), 0).when(F.col("season") == "Sharat", 1).when(F.col("season") == "Hemanta", 2).otherwise(3)
    queue = table(spark, root, "songs").select("id", "ord", "season", "pop", tier.alias("tier"))
    order = [F.col("tier").asc(), (F.coalesce("season", F.lit("")) == "").cast("int").asc(), F.coalesce("pop", F.lit(9999)).asc(), F.col("ord").asc()]
    return catalog.within_budget(queue, order, F.when(F.col("tier") == 0, 202).otherwise(101), 9800, 202).select("id", F.col("used_before").cast("bigint").alias("used_before"))


@query("""WITH old AS (SELECT song_id, id, ord, views FROM (SELECT song_id, id, min(ord) AS ord, max(views) AS views FROM videos WHERE song_id IS NOT NULL AND id IS NOT NULL AND ord < (SELECT max(ord) // 2 FROM videos) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY coalesce(views, -1) DESC, ord) <= 3),
fresh AS (SELECT id, max(views) AS views FROM videos WHERE id IS NOT NULL AND ord >= (SELECT max(ord) // 2 FROM videos) AND embeddable GROUP BY 1)
SELECT song_id, string_agg(o.id, ',' ORDER BY coalesce(f.views, o.views, 0) DESC, coalesce(o.views, -1) DESC, o.ord) AS ids, sum(coalesce(f.views, o.views, 0))::BIGINT AS views FROM old o JOIN fresh f USING (id) GROUP BY 1""")
def refresh_upsert(spark, root):
    """Each song's kept media of the first half of arrivals, brought up to date by the second half."""
    v = table(spark, root, "videos").where("id is not null")
    half = (v.agg(F.max("ord")).first()[0] or 0) // 2
    old = v.where(F.col("song_id").isNotNull() & (F.col("ord") < half)).groupBy("song_id", "id").agg(F.min("ord").alias("ord"), F.max("views").alias("views"))
    kept = catalog.top_per_key(old, "song_id", [F.coalesce("views", F.lit(-1)).desc(), F.col("ord").asc()], 3)
    packed = catalog.nest(kept, "song_id", "rank", ["id", "views"], "videos")
    fresh = v.where((F.col("ord") >= half) & F.col("embeddable")).groupBy("id").agg(F.max("views").alias("views")).withColumn("embeddable", F.lit(True))
    done = catalog.refreshed(packed, "song_id", "videos", fresh).where("size(videos) > 0")
    views = F.aggregate("videos", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["views"], F.lit(0)))
    return done.select("song_id", F.array_join(F.transform("videos", lambda x: x["id"]), ",").alias("ids"), views.alias("views"))


@query("""WITH k AS (SELECT song_id, id, fetched FROM videos WHERE song_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY coalesce(views, -1) DESC, ord) <= 3)
SELECT song_id, CASE WHEN min(fetched) < TIMESTAMP '2024-06-01' THEN 0 ELSE count(*) END AS n FROM k GROUP BY 1""")
def prune_ttl(spark, root):
    import datetime

    v = table(spark, root, "videos").where("song_id is not null and id is not null")
    kept = catalog.top_per_key(v, "song_id", [F.coalesce("views", F.lit(-1)).desc(), F.col("ord").asc()], 3)
    lists = kept.groupBy("song_id").agg(F.collect_list("id").alias("candidates"), F.min("fetched").alias("fetched"))
    return catalog.pruned(lists, "candidates", "fetched", datetime.datetime(2024, 6, 1)).select("song_id", F.size("candidates").cast("bigint").alias("n"))


@query("SELECT id FROM songs WHERE id NOT IN (SELECT song_id FROM videos WHERE song_id IS NOT NULL)")
def resume_anti(spark, root):
    return catalog.not_done(table(spark, root, "songs").select("id"), table(spark, root, "videos").select(F.col("song_id").alias("id")), "id")


@query("""WITH k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM videos WHERE id IS NOT NULL))
SELECT n // 50 AS batch, count(*) AS n, md5(string_agg(id, '|' ORDER BY n)) AS digest FROM k GROUP BY 1""")
def id_batches(spark, root):
    return catalog.id_batches(table(spark, root, "videos"), "id").select("batch", F.size("keys").cast("bigint").alias("n"), "digest")


@query("""WITH b AS (SELECT parjay, title_bn, title_en, taal, row_number() OVER (PARTITION BY parjay ORDER BY (lyrics_bn IS NOT NULL AND lyrics_bn <> '')::INT DESC, ord) AS r FROM songs_base WHERE parjay IS NOT NULL)
SELECT parjay, min_by(title_bn, r) FILTER (title_bn <> '') AS title_bn, min_by(title_en, r) FILTER (title_en <> '') AS title_en, min_by(taal, r) FILTER (taal <> '') AS taal FROM b GROUP BY parjay""")
def first_nonempty(spark, root):
    b = table(spark, root, "songs_base").where("parjay is not null")
    filled = (F.coalesce("lyrics_bn", F.lit("")) != "").cast("int")
    return catalog.first_filled(b, "parjay", [-filled, F.col("ord")], ["title_bn", "title_en", "taal"])


@query("""SELECT count(*) AS songs, count(*) FILTER (lyrics <> '') AS with_lyrics, count(*) FILTER (pop IS NOT NULL) AS ranked, count(DISTINCT raag) AS raags FROM songs""")
def build_metrics(spark, root):
    return table(spark, root, "songs").agg(F.count("*").alias("songs"), F.count_if(F.col("lyrics") != "").alias("with_lyrics"), F.count_if(F.col("pop").isNotNull()).alias("ranked"), F.count_distinct("raag").alias("raags"))


@query("SELECT id, count(*) AS n FROM videos WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_keys(spark, root):
    return catalog.duplicates(table(spark, root, "videos").where("id is not null"), "id")


@query("""SELECT id, CASE WHEN fetched >= TIMESTAMP '2024-07-01' THEN 1 ELSE 0 END AS newer, views FROM videos WHERE id IS NOT NULL AND fetched IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched DESC, ord DESC) = 1""")
def upsert_latest(spark, root):
    v = table(spark, root, "videos").where("id is not null and fetched is not null").withColumn("version", F.struct("fetched", "ord"))
    old, new = v.where("fetched < timestamp_ntz'2024-07-01'"), v.where("fetched >= timestamp_ntz'2024-07-01'")
    return catalog.upsert_latest(old.withColumn("newer", F.lit(0)), new.withColumn("newer", F.lit(1)), "id", "version").select("id", "newer", "views")


@query()
def media_relevance(spark, root):
    """Screen with the title check: an Arrow UDF over skeletons after the built-in predicates."""
    songs = table(spark, root, "songs").select(F.col("id").alias("song_id"), catalog.needles("bn", "en").alias("needles"))
    v = catalog.screened(table(spark, root, "videos"), r"(?i)compilation|full album").select("ord", "song_id", "title", "channel", "views")
    scored = v.join(songs, "song_id").withColumn("relevance", catalog.relevance(F.col("needles"), "title", "channel", r"(?iu)songdir|গান"))
    kept = catalog.top_per_key(scored.where(F.col("relevance") >= catalog.MIN_RELEVANCE), "song_id", [F.coalesce("views", F.lit(-1)).desc(), F.col("ord").asc()], 3)
    return kept.select("song_id", "ord", "relevance", "rank")


def uniform_sql(seed: int, *keys: str) -> str:
    return f"((('0x' || left(md5({seed} || '|' || {" || '|' || ".join(keys)}), 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query(f"SELECT id FROM songs ORDER BY -ln({uniform_sql(7, 'id')}) / CASE WHEN pop IS NOT NULL THEN 4.0 ELSE 1.0 END, id LIMIT 20")
def weighted_pick(spark, root):
    """Twenty songs with four times the chance for ranked ones, the same for any partitioning."""
    songs = table(spark, root, "songs")
    return ranking.weighted_pick(songs, "id", F.when(F.col("pop").isNotNull(), 4.0).otherwise(1.0), 20, seed=7).select("id")


@query("""WITH v AS (SELECT song_id, ord, embeddable, seconds FROM videos WHERE song_id IS NOT NULL) SELECT song_id, min(ord) AS ord FROM v WHERE embeddable AND seconds BETWEEN 60 AND 720 GROUP BY 1""")
def first_playable(spark, root):
    return catalog.screened(table(spark, root, "videos").where("song_id is not null")).groupBy("song_id").agg(F.min("ord").alias("ord"))


@query("""WITH r AS (SELECT song_id, id, ord, row_number() OVER (PARTITION BY song_id ORDER BY ord) AS r FROM videos WHERE song_id IS NOT NULL AND id IS NOT NULL)
SELECT song_id, id, min(ord) AS ord FROM r GROUP BY 1, 2""")
def append_unseen(spark, root):
    v = table(spark, root, "videos").where("song_id is not null and id is not null").select("song_id", "id", "ord")
    both = v.where("ord % 2 = 0").unionByName(v.where("ord % 2 = 1"))
    first = catalog.top_per_key(both.withColumn("key", F.struct("song_id", "id")), "key", [F.col("ord").asc()], 1)
    return first.select("song_id", "id", "ord")
