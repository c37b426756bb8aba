"""Queries over the merged catalogues, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import markup as M
from ..functions import text as X
from ..operators import catalog, linkage, ranking
from ..session import cut_lineage, shared_folder, table
from ..sources import readers
from . import state_queries
from .registry import ORACLES, query
from .shared import KEPT_SQL, kept_videos
from .text_queries import MODES

_PAGES = "SELECT ord, section_bn, num, ws_title, title_bn FROM source_b WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_bn, num ORDER BY ord DESC) = 1"


@query(f"""WITH c AS ({ORACLES['cluster_dups']}), b AS ({_PAGES}),
j AS (SELECT c.cluster, s.*, b.ord AS r, b.title_bn AS page_title FROM c JOIN songs_base s USING (id) LEFT JOIN b ON s.parjay_bn = b.section_bn AND s.parjay_num = b.num),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (r IS NULL)::INT, (coalesce(drama, '') <> '')::INT, -(coalesce(raag_full, '') <> '')::INT - (coalesce(taal, '') <> '')::INT, regexp_matches(id, '-[0-9]$')::INT, length(id), ord) AS rk FROM j)
SELECT 'a' AS side, min_by(id, rk) AS id, arg_min_null(title_en, rk) AS title_en, count(*) AS members, min_by(page_title, rk) FILTER (page_title <> '') AS title_bn, min_by(raag_full, rk) FILTER (raag_full <> '') AS raag_full, min_by(taal, rk) FILTER (taal <> '') AS taal,
min_by(written, rk) FILTER (written <> '') AS written, min_by(collection, rk) FILTER (collection <> '') AS collection, string_agg(DISTINCT drama, ', ' ORDER BY drama) FILTER (drama <> '') AS drama FROM k GROUP BY cluster
UNION ALL SELECT 'b', ws_title, NULL, 1, title_bn, NULL, NULL, NULL, NULL, NULL FROM source_b WHERE ord NOT IN (SELECT r FROM j WHERE r IS NOT NULL)""")
def merged_records(spark, root):
    """One record for each song of either catalogue: duplicates under their best row, its gaps filled from the others, and pages without a song."""
    base, pages = table(spark, root, "songs_base"), table(spark, root, "source_b")
    numbered = linkage.last_per_key(pages.where("num is not null").select("num", "section_bn", F.col("ord").alias("r"), F.col("title_bn").alias("page_title")), ["section_bn", "num"], "r")
    rows = base.drop("title_bn").join(numbered, (F.col("parjay_bn") == F.col("section_bn")) & (F.col("parjay_num") == F.col("num")), "left").join(state_queries.cluster_dups(spark, root), "id")
    filled = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    rank = [F.col("r").isNull().cast("int"), filled("drama"), -filled("raag_full") - filled("taal"), F.col("id").rlike("-[0-9]$").cast("int"), F.length("id"), F.col("ord")]
    merged = linkage.representatives(rows, "cluster", rank, ["id", "title_en"], ["page_title", "raag_full", "taal", "written", "collection"], ["drama"])
    of_a = merged.drop("cluster").withColumnRenamed("page_title", "title_bn").withColumn("side", F.lit("a"))
    left = pages.join(numbered.select(F.col("r").alias("ord"), "section_bn", "num").join(base.select(F.col("parjay_bn").alias("section_bn"), F.col("parjay_num").alias("num")), ["section_bn", "num"], "left_semi").select("ord"), "ord", "left_anti")
    of_b = left.select(F.col("ws_title").alias("id"), "title_bn", F.lit(1).cast("bigint").alias("members"), F.lit("b").alias("side"))
    out = of_a.unionByName(of_b, allowMissingColumns=True)
    return out.select("side", "id", "title_en", "members", "title_bn", "raag_full", "taal", "written", "collection", "drama")


@query()
def link_audit(spark, root):
    """Every kind of decision of the linker with how many rows it has and the first of them on either side; scores have no SQL."""
    tables = readers.audit(cut_lineage(state_queries.fuzzy_link(spark, root)))  # cut: each kind reads all decisions
    parts = [t.agg(F.first("decision").alias("decision"), F.count("*").alias("n"), F.min("a_ord").alias("first_a"), F.min("b_ord").alias("first_b")) for t in tables.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query()
def drama_fill(spark, root):
    """Native text for the songs of plays, out of the lines of the other edition; scores have no SQL."""
    songs = table(spark, root, "songs_base").where("drama <> ''").select("ord", F.col("lyrics_translit").alias("translit"))
    pages = table(spark, root, "source_b").where("lyrics_bn is not null")
    lines = pages.select(F.col("ord").alias("page"), F.posexplode(F.split("lyrics_bn", "\n")).alias("at", "text")).where("trim(text) <> ''")
    return linkage.filled_from_lines(songs, lines).select("query", "title", "lyrics", F.round("sim", 4).alias("sim"))


@query(f"""WITH {KEPT_SQL}, m AS (SELECT song_id AS id, string_agg(id, ',' ORDER BY rank) AS ids FROM kept GROUP BY 1), p AS (SELECT id, row_number() OVER (ORDER BY pop, ord) AS pop FROM songs WHERE pop IS NOT NULL),
n AS (SELECT id, raag_full, trim(regexp_replace(string_split_regex(regexp_replace(trim(raag_full), '(?i)^mi?shra[- ]+', ''), '\\s*[-/,&(]\\s*')[1], '\\s+', ' ', 'g')) AS v FROM songs_base)
SELECT b.id, b.title_bn AS bn, b.title_en AS en, b.parjay, b.sub_parjay AS sub, CASE WHEN b.parjay = 'Prakriti' THEN b.season END AS season, b.drama, b.raag_full AS "raagFull", b.taal, b.written, b.lyrics_bn AS lyrics, b.source, array_to_string(coalesce(s.moods, []), ',') AS moods,
p.pop::INT AS pop, list_extract(b.aliases, 1) AS alias, m.ids AS videos, concat_ws(' · ', nullif(b.title_en, ''), nullif(list_extract(b.aliases, 1), '')) AS subtitle,
CASE WHEN n.raag_full IS NULL OR n.raag_full = '' THEN NULL WHEN regexp_matches(n.raag_full, '(?i)western|scottish|irish|english') THEN 'Western'
WHEN lower(v) = 'mebala' THEN 'Mebela' WHEN lower(v) = 'jhindusuuri' THEN 'Jhindusuri' WHEN lower(v) = 'azhekandi' THEN 'Ajhekandi' ELSE upper(v[1]) || v[2:] END AS raag
FROM songs_base b JOIN n USING (id) LEFT JOIN songs s ON s.id = b.id LEFT JOIN p ON p.id = b.id LEFT JOIN m ON m.id = b.id""")
def catalogue_rows(spark, root):
    """All published fields with popularity ranks, moods and media joined; text fields of arrays are joined by commas."""
    songs, base = table(spark, root, "songs"), table(spark, root, "songs_base")
    ranks = ranking.with_position(songs.where("pop is not null").select("id", "ord", "pop"), [F.col("pop").asc(), F.col("ord").asc()]).select("id", (F.col("position") + 1).cast("int").alias("pop"))
    aliases = base.select("id", F.try_element_at("aliases", F.lit(1)).alias("alias"))
    media = catalog.nest(kept_videos(spark, root), "song_id", "rank", ["id"], "kept").select(F.col("song_id").alias("id"), F.col("kept").alias("videos"))
    rows = catalog.catalogue_rows(base, media, aliases.join(ranks, "id", "left"), songs.select("id", "moods"), MODES)
    subtitle = F.concat_ws(" · ", F.nullif(F.col("en"), F.lit("")), F.nullif(F.col("alias"), F.lit("")))
    return rows.withColumn("subtitle", subtitle).withColumn("moods", F.array_join("moods", ",")).withColumn("videos", F.array_join(F.transform("videos", lambda v: v["id"]), ","))


@query("""SELECT ord, id, nullif(bn, '') AS bn, nullif(taal, '') AS taal, pop, CASE WHEN len(moods) > 0 THEN array_to_string(moods, ',') END AS moods FROM songs""")
def published_roundtrip(spark, root):
    """The songs written as a published table without empty fields, and read again by schema from a directory of documents."""
    songs = table(spark, root, "songs").select("ord", "id", "bn", "taal", "pop", "moods")
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    readers.write_published(catalog.drop_empty(catalog.assert_unique(songs, "id"), ()), path, {"kind": "songs"})
    counted = readers.read_document(spark, f"{path}/meta", readers.schema(count="bigint", kind="string"), lines=True).first()
    back = readers.read_directory(spark, f"{path}/rows", songs.schema, lines=True)
    assert counted["count"] == songs.count() and counted["kind"] == "songs"
    return back.select("ord", "id", "bn", "taal", "pop", F.array_join("moods", ",").alias("moods"))


_ESCAPED = "replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("""SELECT id, trim(coalesce(taal, '')) AS beat, trim(coalesce(written, '')) AS written, coalesce(lyrics_bn, '') AS words FROM songs_base""")
def parsed_pages(spark, root):
    """Pages with entities, attributes, comments and nested tags around each field, taken apart by a parser."""
    s = table(spark, root, "songs_base")
    shown = lambda c: F.expr(_ESCAPED % f"coalesce({c}, '')")
    page = F.concat(
        F.lit("<!doctype html><html><body><!-- <b>Taal</b>: none --><div class='x'><b>Taal</b>: old</div><p><b class=\"k\"><i>Ta</i>al</b> : <a href='/t?a=1&amp;b=2'>"), shown("taal"), F.lit("</a><br><b>Written:</b> <span>"), shown("written"),
        F.lit("</span></p><script>var b = '<b>no</b>';</script><pre class='lyric'><span>"), shown("lyrics_bn"), F.lit("</span></pre></body>"),
    )
    return s.select("id", readers.parsed_page(page).alias("p")).select("id", F.trim(F.col("p.fields")["Taal"]).alias("beat"), F.trim(F.col("p.fields")["Written"]).alias("written"), F.coalesce("p.text", F.lit("")).alias("words"))


@query("""SELECT id, '/song/' || id AS path, coalesce(title_en, '') AS title FROM songs_base WHERE NOT regexp_matches(coalesce(title_en, ''), '[<>&]')""")
def index_links(spark, root):
    """One index page for each song's category with its links, and the links as rows."""
    s = table(spark, root, "songs_base").where(~F.coalesce("title_en", F.lit("")).rlike("[<>&]"))
    page = F.concat(F.lit('<ul><li><a href="/song/'), "id", F.lit('">'), F.coalesce("title_en", F.lit("")), F.lit("</a></li></ul>"))
    return s.select("id", F.explode(readers.index_links(page)).alias("l")).select("id", "l.path", "l.title")


@query("""WITH s AS (SELECT o_orderkey, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM (SELECT o_orderkey, o_orderdate + INTERVAL 330 MINUTE AS o_orderdate FROM orders)),
n AS (SELECT o_orderkey, CASE WHEN md >= 1216 THEN 5 WHEN md >= 1018 THEN 4 WHEN md >= 817 THEN 3 WHEN md >= 615 THEN 2 WHEN md >= 414 THEN 1 WHEN md >= 213 THEN 6 ELSE 5 END AS k FROM s)
SELECT o_orderkey, ['গ্রীষ্ম', 'বর্ষা', 'শরৎ', 'হেমন্ত', 'শীত', 'বসন্ত'][k] AS current, ['Grishma', 'Barsha', 'Sharat', 'Hemanta', 'Sheet', 'Basanta'][k % 6 + 1] AS following FROM n""")
def seasons_ahead(spark, root):
    """Season of an instant in another zone, by its native name, and the one after it."""
    names = dict(zip([n for n, _ in C.SEASONS], ["গ্রীষ্ম", "বর্ষা", "শরৎ", "হেমন্ত", "শীত", "বসন্ত"]))
    o = table(spark, root, "orders").select("o_orderkey", C.season_now(F.col("o_orderdate").cast("timestamp")).alias("s"))
    return o.select("o_orderkey", X.localised("s.current", names).alias("current"), F.col("s.following").alias("following"))


_PLAIN = "replace(replace(replace(%s, chr(65279), ''), chr(8203), ''), chr(2494) || chr(2503), chr(2507))"


@query(f"""WITH t AS (SELECT ws_title, {_PLAIN % "(lyrics_bn || ' ' || coalesce(title_bn, ''))"} || chr(10) || 'end' AS x FROM source_b WHERE lyrics_bn IS NOT NULL AND NOT regexp_matches(lyrics_bn || coalesce(title_bn, ''), '[\\[\\]{{}}<>|=&'']')),
l AS (SELECT ws_title, list_transform(string_split(x, chr(10)), lambda v: regexp_replace(regexp_replace(v, '[ \\t\\x{{00A0}}]+', ' ', 'g'), '^[ :]+|[ :]+$', '', 'g')) AS l FROM t)
SELECT ws_title, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS words FROM l""")
def markup_nested(spark, root):
    """Pages with nested, unbalanced and special templates, references, comments and links around the text, and its plain lines."""
    s = table(spark, root, "source_b").where("lyrics_bn is not null").where(~F.concat("lyrics_bn", F.coalesce("title_bn", F.lit(""))).rlike(r"[\[\]{}<>|=&']"))
    page = F.concat(
        F.lit('<section begin="a"/>{{c|12}}other text<section end="a"/>\n<section begin="b"/><noinclude>{{rh|1|x|2}}</noinclude>{{rh|left|{{em|x}}|right}}\n{{c|১২}}\n<!-- {{ open -->{{block|{{center|style=x|'),
        "lyrics_bn", F.lit("}}}}<ref name='q'>r {{x|y}}</ref><ref name=q/>{{gap|2em}}'''[[Page:x|"), F.coalesce("title_bn", F.lit("")), F.lit("]]'''<br/>{{nop}}:{{overfloat left|en|depth=1}}".replace("{{overfloat left|en|depth=1}}", "{{sc|n=1|end}}") + '<section end="b"/>}}tail'),
    )
    plain = M.clean_markup(M.section_text(page, F.lit("b"), F.lit("b")))
    return s.select("ws_title", plain.alias("words"))


_FREE = "NOT regexp_matches(lyrics_bn, '[\\[\\]{}<>|=&'']')"


@query(rf"""WITH t AS (SELECT ord, {_PLAIN % "('অমর ও কুমার। ' || lyrics_bn)"} || chr(10) || 'রাজার প্রবেশ।' || chr(10) || '১২' AS x FROM source_b WHERE lyrics_bn IS NOT NULL AND {_FREE}),
l AS (SELECT ord, regexp_replace(regexp_replace(unnest(string_split(x, chr(10))), '[ \t\x{{00A0}}]+', ' ', 'g'), '^[ :]+|[ :]+$', '', 'g') AS x FROM t),
h AS (SELECT ord, x, split_part(x, '।', 1) AS head FROM l),
c AS (SELECT ord, trim(CASE WHEN contains(x, '।') AND len(list_filter(string_split_regex(head, '\s+ও\s+'), lambda w: w = '' OR regexp_matches(w, '\s'))) = 0 THEN substr(x, length(head) + 2) ELSE x END) AS line FROM h)
SELECT ord AS page, line FROM c WHERE NOT regexp_matches(line, '^[\s\p{{Nd}}]*$') AND NOT (length(line) <= 59 AND regexp_matches(rtrim(line, '।'), '(প্রবেশ|প্রস্থান|অন্তর্ধান)$'))""")
def ordered_lines(spark, root):
    """The lines of all pages in order, of pages that have speakers, drawn rules, stage directions and page numbers besides."""
    s = table(spark, root, "source_b").where("lyrics_bn is not null").where(~F.col("lyrics_bn").rlike(r"[\[\]{}<>|=&']"))
    text = F.concat(F.lit("<noinclude>{{rh|x}}</noinclude>অমর ও কুমার। "), "lyrics_bn", F.lit("{{rule|4em}}রাজার প্রবেশ।\n১২"))
    last = s.agg(F.max("ord")).first()[0]
    ranges = [] if last is None else [(0, last // 2), (last // 2 + 1, last)]
    return readers.ordered_lines(s.select("ord", text.alias("text")), "ord", "text", ranges).select("page", "line")
