"""Queries over logs, lists, vectors and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, linkage, ranking, state, vectors
from ..operators.lexicon import merge_weights as merge
from ..session import table
from .registry import query


@query("""WITH l AS (SELECT user_id, floor(value)::BIGINT AS item, max(struct_pack(a := ts, b := event_id)) AS last FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM l QUALIFY place <= 12""")
def recent_distinct(spark, root):
    log = table(spark, root, "events").where("event_type = 'click'").select("user_id", F.floor("value").cast("bigint").alias("item"), "ts", "event_id")
    return ranking.latest_distinct(log, "user_id", "item", ["ts", "event_id"], 12).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
SELECT user_id, min(place) AS place FROM e WHERE place > 5 AND event_type <> 'error' GROUP BY 1""")
def next_unplayed(spark, root):
    e = ranking.place_in_group(table(spark, root, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", [F.col("ts").asc(), F.col("event_id").asc()]).withColumn("place", F.col("place") + 1)
    return ranking.next_allowed(e.withColumn("current", F.lit(5)), "user_id", "place", "current", F.col("event_type") == "error")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT user_id, event_id FROM e WHERE k = 1 OR before < 200 * 0.92""")
def take_while(spark, root):
    return ranking.take_while_total(table(spark, root, "events"), "user_id", "event_id", F.col("value"), F.lit(200), 0.92).select("user_id", "event_id")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 30""")
def bounded_history(spark, root):
    return catalog.top_per_key(table(spark, root, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 30).select("user_id", "event_id", F.col("rank").cast("bigint").alias("back"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, coalesce((props::JSON ->> '$.missing')::BIGINT, -1) AS missing FROM events""")
def json_props(spark, root):
    p = F.from_json("props", "k bigint, missing bigint")
    return table(spark, root, "events").select("event_id", p.alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit(-1)).cast("bigint").alias("missing"))


@query("""WITH d AS (SELECT event_id, ts, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS day FROM events WHERE event_type = 'view')
SELECT event_id, day, used FROM (SELECT event_id, day, (count(*) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 101 AS used FROM d) WHERE used + 202 <= 9800""")
def quota_ledger(spark, root):
    from ..functions.calendar import day_in_zone

    e = table(spark, root, "events").where("event_type = 'view'").withColumn("day", day_in_zone(F.col("ts").cast("timestamp")).cast("string"))
    placed = ranking.place_in_group(e.select("event_id", "ts", "day"), "day", [F.col("ts").asc(), F.col("event_id").asc()])
    return placed.withColumn("used", (F.col("place") + 1) * 101).where("used + 202 <= 9800").select("event_id", "day", "used")


def _replica(spark, root, parity):
    e = table(spark, root, "events").where(F.col("event_id") % 2 == parity).select("user_id", "event_id", "event_type", "ts", F.get_json_object("props", "$.k").alias("k"))
    # Lists hold an item once, so they are as long as there are items, however long the log.
    once = e.groupBy("user_id", "event_type", "k").agg(F.min("event_id").alias("first"), F.max("ts").alias("ts"))
    packed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("first", "k")))), lambda s: s["k"])
    at = F.unix_millis(F.max("ts").cast("timestamp"))
    r = once.groupBy("user_id").agg(packed(F.col("event_type") == "click").alias("likes"), packed(F.col("event_type") == "error").alias("never"), packed(F.col("event_type") == "view").alias("recent"), at.alias("prefs_at"))
    return r.withColumn("filters", F.lit(f"side {parity}")).withColumn("session", F.concat(F.lit("s"), F.col("prefs_at").cast("string"))).withColumn("session_at", F.col("prefs_at") - parity * 3600000)


def _replica_sql(parity: int) -> str:
    return f"""(SELECT user_id, coalesce(list(k ORDER BY event_id) FILTER (event_type = 'click'), []) AS likes, coalesce(list(k ORDER BY event_id) FILTER (event_type = 'error'), []) AS never, epoch_us(max(ts)) // 1000 AS prefs_at, 'side {parity}' AS filters,
    's' || (epoch_us(max(ts)) // 1000)::VARCHAR AS session, epoch_us(max(ts)) // 1000 - {parity} * 3600000 AS session_at FROM (SELECT user_id, event_id, event_type, ts, props::JSON ->> '$.k' AS k FROM events WHERE event_id % 2 = {parity}) GROUP BY 1)"""


@query(f"""SELECT coalesce(l.user_id, r.user_id) AS user_id, len(list_distinct(list_concat(coalesce(r.likes, []), coalesce(l.likes, [])))) AS likes,
len(list_filter(list_distinct(list_concat(coalesce(r.never, []), coalesce(l.never, []))), lambda x: NOT list_contains(list_concat(coalesce(r.likes, []), coalesce(l.likes, [])), x))) AS never,
CASE WHEN coalesce(r.prefs_at, 0) > coalesce(l.prefs_at, 0) THEN r.filters ELSE l.filters END AS filters, CASE WHEN coalesce(r.session_at, 0) > coalesce(l.session_at, 0) THEN r.session ELSE l.session END AS session
FROM {_replica_sql(0)} l FULL JOIN {_replica_sql(1)} r ON l.user_id = r.user_id""")
def sync_merge(spark, root):
    merged = state.merged_state(_replica(spark, root, 0), _replica(spark, root, 1), "user_id", first_link=True)
    return merged.select("user_id", F.size("likes").cast("bigint").alias("likes"), F.size("never").cast("bigint").alias("never"), "filters", "session")


@query("""WITH l AS (SELECT user_id, list(k ORDER BY event_id) AS ids FROM (SELECT user_id, event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 200) GROUP BY 1),
u AS (SELECT user_id, unnest(ids) AS k, generate_subscripts(ids, 1) - 1 AS place FROM l)
SELECT user_id, place::INT AS place, p_name FROM u JOIN part ON p_partkey = k WHERE p_size < 25""")
def id_list_join(spark, root):
    e = table(spark, root, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    latest = catalog.top_per_key(e, "user_id", [F.col("event_id").desc()], 200)  # a list keeps its last 200
    lists = latest.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "k"))), lambda s: s["k"]).alias("ids"))
    return state.rows_of_list(lists, "user_id", "ids", table(spark, root, "part").where("p_size < 25").select("p_partkey", "p_name"), "p_partkey").select("user_id", "place", "p_name")


@query("""WITH s AS (SELECT b.id, coalesce(a.moods, []::VARCHAR[]) AS x, ['calm', 'devotion', 'calm'] AS y FROM songs_base b LEFT JOIN songs a ON a.id = b.id)
SELECT id, len(list_distinct(list_concat(x, y))) AS united, len(list_filter(list_distinct(x), lambda v: NOT list_contains(y, v))) AS rest, len(list_intersect(x, y)) AS shared, list_contains(x, 'devotion') AS liked FROM s""")
def list_sets(spark, root):
    s = table(spark, root, "songs_base").select("id").join(table(spark, root, "songs").select("id", "moods"), "id", "left")
    x, y = F.coalesce("moods", F.array().cast("array<string>")), F.array(F.lit("calm"), F.lit("devotion"), F.lit("calm"))
    return s.select("id", F.size(state.union_ordered(x, y)).cast("bigint").alias("united"), F.size(state.without(x, y)).cast("bigint").alias("rest"), F.size(F.array_intersect(x, y)).cast("bigint").alias("shared"), F.array_contains(x, "devotion").alias("liked"))


@query("""WITH t AS (SELECT user_id, list(DISTINCT event_type) AS x FROM events GROUP BY 1)
SELECT user_id, list_contains(x, 'click') AS was_on, len(x) + CASE WHEN list_contains(x, 'click') THEN -1 ELSE 1 END AS n_on FROM t""")
def toggled_sets(spark, root):
    t = table(spark, root, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("x"))
    on, _ = state.toggled("x", F.array().cast("array<string>"), F.lit("click"))
    return t.select("user_id", F.array_contains("x", "click").alias("was_on"), F.size(on).cast("bigint").alias("n_on"))


@query("""SELECT user_id, max(ts)::DATE::VARCHAR AS day FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAYS AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def valid_sessions(spark, root):
    import datetime

    last = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("at")).withColumn("page", F.lit(""))
    known = table(spark, root, "customer").where("c_acctbal > 0").select("c_custkey")
    return state.valid_sessions(last, "at", datetime.datetime(2024, 1, 30), 30, "user_id", known, "c_custkey", "page").select("user_id", F.to_date("at").cast("string").alias("day"))


@query("""WITH p AS (SELECT p_partkey FROM part), n AS (SELECT least(40, count(*) // 2) AS k FROM p),
r AS (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_partkey DESC) AS place FROM p)
SELECT p_partkey FROM p WHERE p_partkey NOT IN (SELECT i FROM r, n WHERE place <= k) AND p_partkey NOT IN (11, 61)""")
def recency_exclusion(spark, root):
    pool = table(spark, root, "part").select("p_partkey")
    recent = ranking.with_position(pool, [F.col("p_partkey").desc()]).withColumn("place", F.col("position") + 1)
    return ranking.recency_excluded(pool, recent, "p_partkey", "place", [11, 61])


@query("""WITH q AS (SELECT label AS entry, array_agg(embedding) AS e FROM embeddings GROUP BY label),
c AS (SELECT entry, list_transform(range(1, 65), lambda i: (list_sum(list_transform(e, lambda v: v[i]::DOUBLE)) / len(e))) AS v FROM q),
s AS (SELECT vec_id, entry, list_inner_product(embedding::DOUBLE[], v) AS sim FROM embeddings, c)
SELECT vec_id, entry, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, entry) <= 3""")
def vector_topk(spark, root):
    e = table(spark, root, "embeddings")
    centres = vectors.centroids(e, "label", "embedding", "v").withColumnRenamed("label", "entry")
    sims = vectors.similarities(e, "vec_id", "embedding", centres, "entry", "v")
    return catalog.top_per_key(sims, "vec_id", [F.col("sim").desc(), F.col("entry").asc()], 3).select("vec_id", "entry", F.round("sim", 6).alias("sim"))


@query("""WITH q AS (SELECT label AS entry, array_agg(embedding) AS e FROM embeddings GROUP BY label), m AS (SELECT entry, list_transform(range(1, 65), lambda i: (list_sum(list_transform(e, lambda v: v[i]::DOUBLE)) / len(e))) AS v FROM q),
s AS (SELECT x.vec_id, m.entry, list_inner_product(x.embedding::DOUBLE[], m.v) AS sim FROM embeddings x, m), b AS (SELECT *, max(sim) OVER (PARTITION BY vec_id) AS best FROM s)
SELECT vec_id, entry, round(1 - (best - sim) / 0.05 * 0.3, 6) AS weight FROM b WHERE sim >= best - 0.05 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, entry) <= 3""")
def margin_pick(spark, root):
    e = table(spark, root, "embeddings")
    centres = vectors.centroids(e, "label", "embedding", "v").withColumnRenamed("label", "entry")
    sims = vectors.similarities(e, "vec_id", "embedding", centres, "entry", "v")
    return vectors.within_margin(sims, "vec_id", "entry", margin=0.05).select("vec_id", "entry", F.round("weight", 6).alias("weight"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
SELECT vec_id, list_sum(list_transform(e, lambda x: greatest(-127, least(127, round_even(x / l * 127, 0)))))::BIGINT AS total FROM n""")
def quantise(spark, root):
    q = vectors.quantised(vectors.normalised("embedding"))
    return table(spark, root, "embeddings").select("vec_id", F.aggregate(q, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("""WITH x AS (SELECT user_id, event_type AS mood, least(1.0, count(*) / 2.0)::DOUBLE AS weight FROM events WHERE value > 95 GROUP BY 1, 2), y AS (SELECT user_id, event_type AS mood, least(1.0, count(*) / 15.0)::DOUBLE AS weight FROM events GROUP BY 1, 2),
c AS (SELECT y.user_id, y.mood, CASE WHEN y.user_id IN (SELECT user_id FROM x) THEN least(0.8, y.weight) ELSE y.weight END AS weight FROM y)
SELECT coalesce(x.user_id, c.user_id) AS user_id, coalesce(x.mood, c.mood) AS mood, round(greatest(x.weight, c.weight), 6) AS weight FROM x FULL JOIN c ON x.user_id = c.user_id AND x.mood = c.mood
QUALIFY row_number() OVER (PARTITION BY coalesce(x.user_id, c.user_id) ORDER BY greatest(x.weight, c.weight) DESC, coalesce(x.mood, c.mood)) <= 4""")
def merge_weights(spark, root):
    e = table(spark, root, "events")
    w = lambda rows, n: rows.groupBy("user_id", F.col("event_type").alias("mood")).agg(F.least(F.lit(1.0), F.count("*") / n).alias("weight"))
    merged = merge(w(e.where("value > 95"), 2.0), w(e, 15.0), "user_id")
    return merged.select("user_id", "mood", F.round("weight", 6).alias("weight"))


def _sides(spark, root):
    a = table(spark, root, "songs_base").select("ord", F.col("parjay_bn").alias("section"), F.col("parjay_num").alias("number"), F.col("title_en").alias("latin"), F.col("lyrics_translit").alias("translit"))
    b = table(spark, root, "source_b").select("ord", F.col("section_bn").alias("section"), F.col("num").alias("number"), F.col("title_bn").alias("native"), F.col("lyrics_bn").alias("lyrics"))
    return a, b


@query()
def fuzzy_link(spark, root):
    """Both catalogues linked by number, title, rescue and opening lines; scores have no SQL, so rows only."""
    a, b = _sides(spark, root)
    return linkage.link(a, b).select("a_ord", "b_ord", "decision", F.round("sim", 4).alias("sim"))


@query()
def line_check(spark, root):
    """Number matches with the agreement of their opening lines."""
    a, b = _sides(spark, root)
    held = linkage.resolved_claims(linkage.verified_number_matches(a, b).where("verdict = 'match'"))
    texts = held.join(a.select(F.col("ord").alias("a_ord"), "translit"), "a_ord").join(b.select(F.col("ord").alias("b_ord"), F.col("lyrics").alias("native")), "b_ord")
    return linkage.checked_links(texts).select("a_ord", "b_ord", F.round("line_sim", 4).alias("line_sim"), "doubtful")


@query()
def drama_lines(spark, root):
    """For each romanised opening the line of the other edition most like it: its page's ord, its place there from 0 on, and the likeness."""
    a, b = _sides(spark, root)
    first = F.split(F.coalesce("translit", F.lit("")), "\n")[0]
    lines = b.select("ord", F.posexplode(F.split("lyrics", "\n")).alias("at", "text")).select(F.struct("ord", "at").alias("ord"), X.skeleton_native("text", "pipeline").alias("skeleton"))
    found = linkage.best_in_block(a.select("ord", X.skeleton_latin(first).alias("skeleton")), lines)
    return found.select("query", F.col("line.ord").alias("line"), F.col("line.at").alias("at"), F.round("sim", 4).alias("sim"))


@query("""WITH b AS (SELECT num, section_bn, ord FROM source_b WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_bn, num ORDER BY ord DESC) = 1),
l AS (SELECT s.id, s.ord, b.ord AS r, nullif(s.title_bn, '') AS k FROM songs_base s LEFT JOIN b ON s.parjay_bn = b.section_bn AND s.parjay_num = b.num),
f AS (SELECT *, CASE WHEN r IS NOT NULL THEN first_value(ord) OVER (PARTITION BY r ORDER BY ord) END AS fr, CASE WHEN k IS NOT NULL THEN first_value(ord) OVER (PARTITION BY k ORDER BY ord) END AS fk, CASE WHEN k IS NOT NULL THEN first_value(r) OVER (PARTITION BY k ORDER BY ord) END AS fkr FROM l),
e AS (SELECT ord AS a, fr AS b FROM f WHERE fr < ord UNION SELECT ord, fk FROM f WHERE fk < ord AND NOT coalesce(r <> fkr, false)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT l.id, coalesce(c.cluster, l.ord) AS cluster FROM l LEFT JOIN (
  WITH RECURSIVE reach(n, m) AS (SELECT a, b FROM g UNION SELECT r.n, g.b FROM reach r JOIN g ON g.a = r.m)
  SELECT n, least(n, min(m)) AS cluster FROM reach GROUP BY n) c ON c.n = l.ord""")
def cluster_dups(spark, root):
    a = table(spark, root, "songs_base").select("id", "ord", "parjay_bn", "parjay_num", F.nullif(F.col("title_bn"), F.lit("")).alias("k"))
    b = linkage.last_per_key(table(spark, root, "source_b").where("num is not null").select("num", "section_bn", F.col("ord").alias("r")), ["section_bn", "num"], "r")
    rows = a.join(b, (F.col("parjay_bn") == F.col("section_bn")) & (F.col("parjay_num") == F.col("num")), "left").select("id", "ord", "r", "k")
    return linkage.clusters(rows, "id", "ord", "r", "k")
