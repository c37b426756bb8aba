"""Queries of the text, date and markup functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import text as X
from ..operators import lexicon
from ..session import table
from .catalog_queries import latin_skeleton_sql, native_skeleton_sql, norm_sql
from .registry import query

# Spellings of some modes by their canonical name, as a caller would give them.
MODES = {"mebala": "Mebela", "jhindusuuri": "Jhindusuri", "azhekandi": "Ajhekandi"}


@query(f"SELECT id, {native_skeleton_sql('title_bn')} AS site, {native_skeleton_sql('title_bn', 'pipeline')} AS pipeline, {latin_skeleton_sql('title_en')} AS latin FROM songs_base")
def skeletons(spark, root):
    s = table(spark, root, "songs_base")
    return s.select("id", X.skeleton_native("title_bn").alias("site"), X.skeleton_native("title_bn", "pipeline").alias("pipeline"), X.skeleton_latin("title_en").alias("latin"))


@query(f"SELECT p_partkey, {latin_skeleton_sql('p_name')} AS skeleton FROM part")
def skeleton_latin(spark, root):
    return table(spark, root, "part").select("p_partkey", X.skeleton_latin("p_name").alias("skeleton"))


@query(f"SELECT doc_id, {norm_sql('text')} AS words FROM documents")
def text_norm(spark, root):
    return table(spark, root, "documents").select("doc_id", X.norm("text").alias("words"))


@query("""SELECT id, regexp_replace(list_last(string_split(source, '/')), '\\.html$', '') AS page, translate(parjay_num::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯') AS native_number,
translate(translate(parjay_num::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯'), '০১২৩৪৫৬৭৮৯', '0123456789') AS latin_number FROM songs_base""")
def slug_digits(spark, root):
    s = table(spark, root, "songs_base")
    native = X.digits_to_native(F.col("parjay_num").cast("string"))
    return s.select("id", X.slug("source", ".html").alias("page"), native.alias("native_number"), X.digits_to_latin(native).alias("latin_number"))


@query("SELECT id, trim(parjay) AS name, parjay_num AS number FROM songs_base")
def split_numbers(spark, root):
    """'Name (98)' put together from the columns and taken apart again."""
    s = table(spark, root, "songs_base").withColumn("typed", F.when(F.col("parjay_num").isNotNull(), F.format_string("%s (%d)", "parjay", "parjay_num")).otherwise(F.col("parjay")))
    return s.select("id", X.split_number("typed").alias("n")).select("id", "n.*")


@query("""SELECT id, CASE WHEN parjay IN ('Puja', 'Prem', 'Prakriti') THEN parjay WHEN parjay = 'Bichitra' THEN 'plays' END AS category,
CASE WHEN parjay IN ('Puja', 'Prem', 'Prakriti') THEN parjay_num END AS number FROM songs_base WHERE parjay IS NOT NULL""")
def canonical_categories(spark, root):
    s = table(spark, root, "songs_base").where("parjay is not null")
    typed = F.when(F.col("parjay_num").isNull(), F.col("parjay")).when(F.col("parjay_num") % 2 == 0, F.format_string("%s %d", "parjay", "parjay_num")).otherwise(F.format_string("%s (%d)", "parjay", "parjay_num"))
    known = {c.lower(): c for c in ("Puja", "Prem", "Prakriti")}
    return s.select("id", X.canonical_category(typed, known, ["bichitra"]).alias("c")).select("id", "c.category", "c.number")


@query("""WITH n AS (SELECT id, raag_full, trim(regexp_replace(string_split_regex(regexp_replace(trim(raag_full), '(?i)^mi?shra[- ]+', ''), '\\s*[-/,&(]\\s*')[1], '\\s+', ' ', 'g')) AS v FROM songs_base)
SELECT id, CASE WHEN raag_full IS NULL OR raag_full = '' THEN NULL WHEN regexp_matches(raag_full, '(?i)western|scottish|irish|english') THEN 'Western'
WHEN lower(v) = 'mebala' THEN 'Mebela' WHEN lower(v) = 'jhindusuuri' THEN 'Jhindusuri' WHEN lower(v) = 'azhekandi' THEN 'Ajhekandi' ELSE upper(v[1]) || v[2:] END AS mode FROM n""")
def simplified_modes(spark, root):
    return table(spark, root, "songs_base").select("id", X.simplify_mode("raag_full", MODES).alias("mode"))


@query("""WITH d AS (SELECT ord, seconds, CASE WHEN seconds IS NULL THEN NULL ELSE 'PT' || CASE WHEN seconds >= 60 THEN (seconds // 60)::VARCHAR || 'M' ELSE '' END || CASE WHEN seconds % 60 > 0 THEN (seconds % 60)::VARCHAR || 'S' ELSE '' END END AS iso FROM videos)
SELECT ord, coalesce(seconds, 0)::INT AS seconds, CASE WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) WHEN seconds IS NOT NULL THEN printf('%d:%02d', seconds // 60, seconds % 60) END AS clock FROM d""")
def duration_parse(spark, root):
    v = table(spark, root, "videos").select("ord", "seconds")
    minutes, rest = F.floor(F.col("seconds") / 60), F.col("seconds") % 60
    iso = F.concat(F.lit("PT"), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""), F.when(rest > 0, F.concat(rest.cast("string"), F.lit("S"))).otherwise(""))
    return v.withColumn("iso", iso).select("ord", X.iso_seconds("iso").alias("seconds"), F.when(F.col("seconds").isNotNull(), X.clock("seconds")).alias("clock"))


@query("""SELECT id, views, CASE WHEN views >= 1000000 THEN (CASE WHEN views / 1e6 < 10 THEN regexp_replace(((floor(views / 1e6 * 10 + 0.5) / 10)::DECIMAL(20,1))::VARCHAR, '\\.0$', '') ELSE floor(views / 1e6 + 0.5)::BIGINT::VARCHAR END) || 'M'
WHEN views >= 1000 THEN (CASE WHEN views / 1e3 < 10 THEN regexp_replace(((floor(views / 1e3 * 10 + 0.5) / 10)::DECIMAL(20,1))::VARCHAR, '\\.0$', '') ELSE floor(views / 1e3 + 0.5)::BIGINT::VARCHAR END) || 'k' ELSE views::VARCHAR END AS shown
FROM (SELECT DISTINCT id, views FROM videos WHERE views IS NOT NULL)""")
def human_numbers(spark, root):
    return table(spark, root, "videos").where("views is not null").select("id", "views").distinct().select("id", "views", X.human_number("views").alias("shown"))


@query("""SELECT id, array_to_string(list_filter([nullif(array_to_string(list_slice(string_split(trim(regexp_replace(replace(replace(title_bn, chr(2494) || chr(2503), chr(2507)), chr(2503) || chr(2494), chr(2507)), '[,;:!?।॥—–\\-‘’''"()\\s\\p{Z}]+', ' ', 'g')), ' '), 1, 5), ' '), ''),
nullif(trim(regexp_replace(title_en, '\\s+\\d+$', '')), '')], lambda x: x IS NOT NULL), '|') AS phrases FROM songs_base""")
def search_phrases(spark, root):
    return table(spark, root, "songs_base").select("id", F.array_join(X.search_phrases("title_bn", "title_en"), "|").alias("phrases"))


@query("""SELECT id, regexp_replace(string_split(lyrics, chr(10))[1], '^[\\s\\p{Z}]+|[\\s\\p{Z},;:।॥!?.\\-–—]+$', '', 'g') AS title,
regexp_matches(lyrics, '[\\x{0980}-\\x{09FF}]') AS native,
CASE WHEN length(lyrics) > 120 THEN regexp_replace(left(lyrics, 120), '\\n[^\\n]*$', '') ELSE lyrics END AS excerpt FROM songs""")
def first_lines(spark, root):
    return table(spark, root, "songs").select("id", X.first_line_title("lyrics").alias("title"), X.is_native("lyrics").alias("native"), X.excerpt("lyrics", 120).alias("excerpt"))


@query("""WITH l AS (SELECT id, en, list_slice(list_filter(string_split(coalesce(lyrics, ''), chr(10)), lambda x: trim(x) <> ''), 1, 12) AS k FROM songs)
SELECT id, CASE WHEN len(k) > 0 THEN 'song: ' || array_to_string(k, chr(10)) ELSE coalesce(en, '') || ' (song)' END AS text, len(k) > 0 AS has_text FROM l""")
def embedding_texts(spark, root):
    return table(spark, root, "songs").select("id", X.embedding_text("lyrics", "en", "song: ", " (song)").alias("e")).select("id", "e.*")


@query("""SELECT ws_title, split_part(ws_title, '/', 1) AS book, split_part(ws_title, '/', 2) AS section, TRY_CAST(translate(split_part(ws_title, '/', 3), '০১২৩৪৫৬৭৮৯', '0123456789') AS INT) AS number FROM source_b""")
def page_paths(spark, root):
    return table(spark, root, "source_b").select("ws_title", X.path_parts("ws_title").alias("p")).select("ws_title", "p.*")


@query(f"""WITH l AS (SELECT id, array_to_string(list_slice(list_filter(string_split(coalesce(lyrics_translit, ''), chr(10)), lambda x: trim(x) <> ''), 1, 2), ' ') AS t FROM songs_base)
SELECT id, CASE WHEN length(left({latin_skeleton_sql('t')}, 30)) >= 12 THEN left({latin_skeleton_sql('t')}, 30) END AS key FROM l""")
def translit_keys(spark, root):
    return table(spark, root, "songs_base").select("id", X.translit_key("lyrics_translit").alias("key"))


@query("""WITH n AS (SELECT ord, regexp_extract(channel, '^(.+?) - Topic$', 1) AS n FROM videos WHERE channel LIKE '% - Topic'),
l AS (SELECT ord, list_filter(list_transform(string_split_regex(n, '\\s*[|,&]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS l FROM n)
SELECT ord, array_to_string(CASE WHEN len(l) <= 2 THEN l ELSE l[1:1] END, '|') AS performers FROM l""")
def topic_channels(spark, root):
    v = table(spark, root, "videos").where("channel like '% - Topic'")
    return v.select("ord", F.array_join(X.topic_performers("channel"), "|").alias("performers"))


@query("""WITH w AS (SELECT s.name, s.ord AS so, unnest(s.spellings) AS w FROM singers s)
SELECT ord, string_agg(name, '|' ORDER BY so) AS names FROM (SELECT DISTINCT v.ord, w.name, w.so FROM videos v JOIN w ON contains(lower(concat_ws(' ', v.title, v.channel)), lower(w.w))) GROUP BY 1""")
def contains_join(spark, root):
    hits = lexicon.dictionary_hits(table(spark, root, "videos"), "ord", ["title", "channel"], table(spark, root, "singers"), "name", "ord", "spellings")
    return hits.select("ord", F.array_join("names", "|").alias("names"))


GENERIC_PART = "official|video|audio|live|full|গান|records|[0-9][0-9][0-9]|#"
_BREAK = "(?i)\\s*[|।｜/]\\s*|\\s+[-–—]\\s+|\\s+by\\s+|\\(|\\)|\\[|\\]"
_CUT = "regexp_replace(trim(regexp_replace(x, '^[\\s:\\-–]+|[\\s:\\-–]+$', '', 'g')), '(?i)^(singer|voice|কণ্ঠে?|শিল্পী)\\s*[:\\-]?\\s*', '')"
_INITIALS = "array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(rf"""WITH hit AS (SELECT DISTINCT v.ord FROM videos v JOIN (SELECT unnest(spellings) AS w FROM singers) w ON contains(lower(concat_ws(' ', v.title, v.channel)), lower(w.w))),
v AS (SELECT * FROM videos WHERE ord NOT IN (SELECT ord FROM hit)),
p AS (SELECT ord, title, list_concat(CASE WHEN channel LIKE '_% - Topic' THEN [regexp_extract(channel, '^(.+?) - Topic$', 1) || ' (Topic channel)'] ELSE [] END,
  list_transform(list_filter(list_transform(string_split_regex(coalesce(title, ''), '{_BREAK}'), lambda x: {_CUT}),
    lambda x: x <> '' AND len(string_split_regex(trim(x), '\s+')) BETWEEN 1 AND 4 AND length(x) >= 4 AND NOT regexp_matches(x, '(?i){GENERIC_PART}')),
    lambda x: CASE WHEN regexp_matches(x, '^[\x00-\x7f]*$') THEN {_INITIALS} ELSE x END)) AS l FROM v WHERE title IS NOT NULL),
u AS (SELECT ord, title, segment, min(nth) AS nth FROM (SELECT ord, title, unnest(l) AS segment, generate_subscripts(l, 1) AS nth FROM p) GROUP BY 1, 2, 3)
SELECT segment, count(*) AS n, arg_min(left(title, 80), ord) AS example FROM u GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, min((ord, nth)) LIMIT 40""")
def segment_report(spark, root):
    """Title parts and artist channels in videos whose singer no dictionary spelling gives."""
    v = table(spark, root, "videos").where("title is not null")
    hits = lexicon.dictionary_hits(v, "ord", ["title", "channel"], table(spark, root, "singers"), "name", "ord", "spellings")
    return lexicon.segment_report(v.join(hits, "ord", "left_anti").withColumn("id", F.col("ord")), "id", "ord", "title", f"(?iu){GENERIC_PART}", "channel")


@query(r"""WITH t AS (SELECT CASE WHEN ord % 5 = 0 THEN replace(replace(replace(replace(lyrics_bn, chr(2492), ''), chr(2527), chr(2479)), chr(2524), chr(2465)), chr(2525), chr(2466)) ELSE replace(replace(replace(lyrics_bn, chr(2527), chr(2479) || chr(2492)), chr(2524), chr(2465) || chr(2492)), chr(2525), chr(2466) || chr(2492)) END AS x FROM songs_base),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(x, ''), '[\x{0980}-\x{09FF}]+')) AS word FROM t) GROUP BY 1),
v AS (SELECT word, n, pos, substring(word, 1, pos) || '়' || substring(word, pos + 1) AS variant FROM (SELECT c.word, c.n, unnest(range(1, length(c.word) + 1)) AS pos FROM c) WHERE substring(word, pos, 1) IN ('ড', 'ঢ', 'য') AND substring(word, pos + 1, 1) <> '়')
SELECT v.word, max_by(v.variant, v.pos) AS fixed FROM v JOIN c ON c.word = v.variant WHERE c.n >= greatest(3, 3 * v.n) GROUP BY 1""")
def scan_fixes(spark, root):
    """The fixes for texts of which a scanner lost the dots in every fifth."""
    text = F.col("lyrics_bn")
    for one, base in (("\u09df", "\u09af"), ("\u09dc", "\u09a1"), ("\u09dd", "\u09a2")):
        text = F.replace(text, F.lit(one), F.lit(base + X.NUKTA))
    scanned = table(spark, root, "songs_base").select("ord", F.when(F.col("ord") % 5 == 0, F.replace(text, F.lit(X.NUKTA), F.lit(""))).otherwise(text).alias("text"))
    return lexicon.dotless_fixes(lexicon.word_frequency(scanned, "text"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(lyrics_bn, ''), '[\\x{0980}-\\x{09FF}]+')) AS word FROM songs_base) GROUP BY 1""")
def word_frequency(spark, root):
    return lexicon.word_frequency(table(spark, root, "songs_base"), "lyrics_bn")


@query("""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(lyrics_bn, ''), '[\\x{0980}-\\x{09FF}]+')) AS word FROM songs_base) GROUP BY 1),
v AS (SELECT word, n, pos, substring(word, 1, pos) || '়' || substring(word, pos + 1) AS variant FROM (SELECT c.word, c.n, unnest(range(1, length(c.word) + 1)) AS pos FROM c) WHERE substring(word, pos, 1) IN ('ড', 'ঢ', 'য') AND substring(word, pos + 1, 1) <> '়')
SELECT v.word, max_by(v.variant, v.pos) AS fixed FROM v JOIN c ON c.word = v.variant WHERE c.n >= greatest(3, 3 * v.n) GROUP BY 1""")
def spelling_fixes(spark, root):
    return lexicon.dotless_fixes(lexicon.word_frequency(table(spark, root, "songs_base"), "lyrics_bn"))


@query()
def spelling_fixed(spark, root):
    s = table(spark, root, "songs_base")
    return lexicon.replace_words(s, "id", "lyrics_bn", lexicon.dotless_fixes(lexicon.word_frequency(s, "lyrics_bn")))


_SEASON = "CASE WHEN md >= 1216 THEN 'Sheet' WHEN md >= 1018 THEN 'Hemanta' WHEN md >= 817 THEN 'Sharat' WHEN md >= 615 THEN 'Barsha' WHEN md >= 414 THEN 'Grishma' WHEN md >= 213 THEN 'Basanta' ELSE 'Sheet' END"


@query(f"""SELECT o_orderkey, {_SEASON} AS season FROM (SELECT o_orderkey, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)""")
def season_lookup(spark, root):
    return table(spark, root, "orders").select("o_orderkey", C.season_of("o_orderdate").alias("season"))


@query("""WITH m AS (SELECT make_date(y, mo, d) AS start, name FROM (VALUES ('Baishakh', 4, 14), ('Jaishtha', 5, 15), ('Asharh', 6, 15), ('Shraban', 7, 17), ('Bhadra', 8, 17), ('Ashwin', 9, 17), ('Kartik', 10, 18), ('Agrahayan', 11, 17), ('Poush', 12, 16), ('Magh', 1, 15), ('Falgun', 2, 13), ('Chaitra', 3, 15)) AS t(name, mo, d), range(1990, 2010) AS r(y)),
o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, (d - start + 1)::INT AS day, name AS month, (year(d) - CASE WHEN month(d) * 100 + day(d) >= 414 THEN 593 ELSE 594 END)::INT AS year FROM o ASOF JOIN m ON o.d >= m.start""")
def month_asof(spark, root):
    return table(spark, root, "orders").select("o_orderkey", C.regional_date("o_orderdate").alias("r")).select("o_orderkey", "r.day", "r.month", "r.year")


@query("""SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS day, dayofyear(ts)::INT AS nth FROM events""")
def zone_days(spark, root):
    e = table(spark, root, "events")
    return e.select("event_id", C.day_in_zone(F.col("ts").cast("timestamp")).cast("string").alias("day"), F.dayofyear("ts").alias("nth"))


@query("""SELECT id, coalesce(title_bn, '') AS title, coalesce(taal, '') AS beat, coalesce(lyrics_bn, '') AS words FROM songs_base""")
def html_fields(spark, root):
    """Page markup put together from the columns, and its fields taken out again by pattern."""
    s = table(spark, root, "songs_base")
    known = lambda c: F.coalesce(c, F.lit(""))
    page = F.concat(F.lit("<html><h1>"), known("title_bn"), F.lit("</h1><b>Taal</b>: "), known("taal"), F.lit("<br/>\n<pre class=\"lyric\">"), known("lyrics_bn"), F.lit("</pre></html>"))
    return s.select("id", page.alias("html")).select(
        "id", F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("title"), F.regexp_extract("html", r"<b>Taal</b>:\s*(.*?)<br", 1).alias("beat"), F.regexp_extract("html", r"(?s)<pre[^>]*>(.*?)</pre>", 1).alias("words")
    )


_BARE = "replace(replace(replace(lyrics_bn, chr(65279), ''), chr(8203), ''), chr(2494) || chr(2503), chr(2507))"


@query(f"""WITH l AS (SELECT ws_title, title_bn, list_transform(string_split({_BARE}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t\\x{{00A0}}]+', ' ', 'g'), '^[ :]+|[ :]+$', '', 'g')) AS l FROM source_b WHERE lyrics_bn IS NOT NULL)
SELECT ws_title, title_bn AS title, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS words FROM l""")
def markup_sections(spark, root):
    """A page of two named sections with templates, and the plain text of the second."""
    s = table(spark, root, "source_b").where("lyrics_bn is not null")
    page = F.concat(F.lit('<section begin="a"/>{{c|x}}<section end="a"/><section begin="b"/><!-- note -->{{block|{{em|2}}'), "lyrics_bn", F.lit("}}<ref>r</ref>"), F.lit('<section end="b"/>'))
    from ..functions.markup import clean_markup, section_text

    inner = section_text(page, F.lit("b"), F.lit("b"))
    plain = F.regexp_replace(clean_markup(inner), r"^2?[\s\p{Z}]*|[\s\p{Z}]+$", "")
    return s.select("ws_title", F.col("title_bn").alias("title"), plain.alias("words"))


@query("""SELECT ws_title, unnest(range(num, num + 3))::INT AS page FROM source_b WHERE num IS NOT NULL""")
def page_ranges(spark, root):
    """Numbers in native digits read from a tag's attributes and made rows of the range."""
    s = table(spark, root, "source_b").where("num is not null")
    tag = F.concat(F.lit('<pages index="b" from='), X.digits_to_native(F.col("num").cast("string")), F.lit(" to="), X.digits_to_native((F.col("num") + 2).cast("string")), F.lit(" />"))
    number = lambda a: X.digits_to_latin(F.regexp_extract("tag", f"{a}=([০-৯]+)", 1)).cast("int")
    return s.withColumn("tag", tag).select("ws_title", F.explode(F.sequence(number("from"), number("to"))).alias("page"))


@query()
def mood_scores(spark, root):
    """Moods of texts by word lists with spans used up and negation."""
    lex = lexicon.MoodLexicon(
        [("shanti", ["quiet", "calm*", "gentle", "slow"]), ("ananda", ["bright", "playful", "glad*", "warm*"]), ("bishad", ["sorrow", "grave", "tired", "never explained"]), ("prem", ["letter", "promise", "sweet"])],
        [("Barsha", ["rain*", "monsoon", "storm"]), ("Sheet", ["winter", "cold"])], ["not", "no", "never", "nothing"], {"ananda", "shanti", "prem"}, "bishad",
    )
    found = lexicon.detect_moods(table(spark, root, "documents"), "doc_id", "text", lex)
    return found.select("doc_id", "mood", F.round("weight", 6).alias("weight"), "place")
