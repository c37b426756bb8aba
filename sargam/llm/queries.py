"""The pN_ queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import decode_corpus, encode_corpus
from .canonical import map_to_reference
from .forms import look_alike_pairs
from .leaks import leaked_items, leaks
from .linkage import matched_records, record_features
from .names import named_persons
from .stuffed import stuffed_pages
from .topn import top_n_per_group


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    top = top_n_per_group(table(spark, root, "videos"), "song_id", "id", "views", 3)
    return top.select(F.col("grp").alias("song_id"), F.col("item").alias("video_id"))


def p1_positions(spark: SparkSession, root: str) -> DataFrame:
    top = top_n_per_group(table(spark, root, "videos"), "song_id", "id", "views", 3)
    return top.select(F.col("grp").alias("song_id"), F.col("item").alias("video_id"), F.col("score").alias("views"), "position")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return named_persons(table(spark, root, "videos"), "ord", ["title", "channel"], table(spark, root, "singers"), "name", "spellings")


def _songs_and_pages(spark: SparkSession, root: str) -> DataFrame:
    songs = record_features(table(spark, root, "songs_base"), "a", "id", "lyrics_bn", "lyrics_translit", "title_bn", "title_en", "parjay_num", "parjay_bn")
    pages = record_features(table(spark, root, "source_b"), "b", "ws_title", "lyrics_bn", None, "title_bn", None, "num", "section_bn")
    return matched_records(songs, pages)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _songs_and_pages(spark, root).select(F.col("id_a").alias("song_id"), F.col("id_b").alias("ws_title"))


def p3_confidence(spark: SparkSession, root: str) -> DataFrame:
    return _songs_and_pages(spark, root).select(F.col("id_a").alias("song_id"), F.col("id_b").alias("ws_title"), F.round("confidence", 3).alias("confidence"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return look_alike_pairs(table(spark, root, "songs_base"), "id", ["title_bn", "lyrics_bn"])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    base = table(spark, root, "songs_base").select(F.lit("raag_full").alias("field"), "id", F.col("raag_full").alias("typed"))
    songs = table(spark, root, "songs").select(F.lit("raag").alias("field"), "id", F.col("raag").alias("typed"))
    found = map_to_reference(base.unionAll(songs), ["field", "id"], "typed", table(spark, root, "raags"), "name", "name_bn", "ord")
    return found.withColumnRenamed("entry", "raag")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_corpus(table(spark, root, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode_corpus(encode_corpus(table(spark, root, "documents"), "doc_id", "text"), "doc_id")


def p7_slots(spark: SparkSession, root: str) -> DataFrame:
    """Every pair that shares enough template windows, with the words in order and what its slots hold."""
    found = leaked_items(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "benchmark"), "item_id", "text")
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    found = leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "benchmark"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return stuffed_pages(table(spark, root, "documents"), "doc_id", "text").where("reason is not null").select(F.col("page").alias("doc_id"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_positions, p2_found, p3_found, p3_confidence, p4_found, p5_found, p6_ids, p6_decoded, p7_found, p7_slots, p8_found)}


_TOP_3 = """
WITH best AS (
  SELECT song_id, id AS video_id, max(views) AS views
  FROM videos WHERE song_id IS NOT NULL AND id IS NOT NULL AND views IS NOT NULL GROUP BY 1, 2
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY views DESC, video_id) AS position FROM best
)
"""


def _raag_oracle(k: int = 2) -> str:
    """The mapping by comparing every value with every entry: what the segment join must not lose."""
    from .canonical import LATIN_FOLDS, MARKER_WORDS

    markers = ", ".join(f"'{w}'" for w in MARKER_WORDS)
    letters = "".join(chr(c) for c in range(0x980, 0x9E4))
    # DuckDB's levenshtein counts bytes; native letters are compared as single-byte ones.
    single = "".join(chr(33 + i) if chr(33 + i) != "'" else "~" for i in range(94)) + "abcdef"

    def folded(c: str) -> str:
        for pattern, to in LATIN_FOLDS:
            if "\\1" in pattern:
                c = f"list_reduce(string_split({c}, ''), lambda a, x: CASE WHEN right(a, 1) = x THEN a ELSE a || x END)"
            else:
                c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
        return f"coalesce({c}, '')"

    def dotted(c: str) -> str:
        for one, base in ((0x9DC, 0x9A1), (0x9DD, 0x9A2), (0x9DF, 0x9AF)):
            c = f"replace({c}, chr({one}), chr({base}) || chr({0x9BC}))"
        return c

    def forms(latin: str, native: str) -> str:
        return f"regexp_replace({latin}, '[^a-z]+', '', 'g') AS plain, {folded(latin)} AS folded, translate(regexp_replace({native}, '[^\\x{{0980}}-\\x{{09FF}}]+', '', 'g'), '{letters}', '{single}') AS native"

    def errors(kind: str, less: int) -> str:
        equal = "" if kind == "folded" else f" WHEN q.{kind} = r.{kind} AND q.{kind} <> '' THEN 0"
        return f"CASE WHEN length(q.{kind}) >= 3 AND length(r.{kind}) >= 3 AND levenshtein(q.{kind}, r.{kind}) <= least({k}, greatest(1, (length(r.{kind}) - 1) // 2 - {less})) THEN levenshtein(q.{kind}, r.{kind}){equal} ELSE {k + 1} END"

    return f"""
    WITH typed AS (SELECT 'raag_full' AS field, id, raag_full AS v FROM songs_base WHERE raag_full IS NOT NULL UNION ALL SELECT 'raag', id, raag FROM songs WHERE raag IS NOT NULL),
    named AS (SELECT v, list_filter(list_transform(string_split_regex({dotted('lower(v)')}, '[/,&();+|–—-]|\\s(?:with|and|or)\\s|এবং'), lambda s: array_to_string(list_filter(string_split_regex(s, '[^a-z\\x{{0980}}-\\x{{09FF}}]+'),
      lambda w: w <> '' AND NOT list_contains([{markers}], w)), '')), lambda s: s <> '')[1] AS name FROM (SELECT DISTINCT v FROM typed)),
    q AS (SELECT v, {forms('name', 'name')} FROM named WHERE name IS NOT NULL),
    r AS (SELECT ord, name, {forms('lower(name)', dotted("coalesce(name_bn, '')"))} FROM raags WHERE name IS NOT NULL),
    e AS (SELECT q.v, r.ord, r.name, least({errors('plain', 0)}, {errors('native', 0)}) AS t, {errors('folded', 1)} AS f FROM q, r),
    b AS (SELECT v, name FROM e WHERE least(t, f) <= {k} QUALIFY row_number() OVER (PARTITION BY v ORDER BY t + f, t, ord) = 1)
    SELECT field, id, coalesce(b.name, 'unmatched') AS raag FROM typed LEFT JOIN b ON typed.v = b.v"""


def llm_oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _raag_oracle(),
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p1_found": _TOP_3 + "SELECT song_id, video_id FROM placed WHERE position <= 3",
        "p1_positions": _TOP_3 + "SELECT song_id, video_id, views, position FROM placed WHERE position <= 3",
    }
