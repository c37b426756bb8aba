"""Free-entered values mapped to a reference list, in SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Words written around a name that are no part of it.
MARKER_WORDS = (
    "raag", "raga", "rag", "raaga", "raagini", "ragini", "r", "mishra", "misra", "mishr", "shuddha", "suddha", "shuddh", "anga", "ang", "mixed", "slow", "fast", "based", "on",
    "রাগ", "রাগিণী", "মিশ্র", "শুদ্ধ", "অঙ্গ",
)
# Romanisation habits folded to one spelling, in this order.
LATIN_FOLDS = (
    ("[^a-z]+", ""), ("chh|cch|ch", "c"), ("sh", "s"), ("zh|jh|z", "j"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("ph|f", "p"), ("bh|v", "b"),
    ("ee|y", "i"), ("oo", "u"), ("[ao]wu?|[oa]u", "o"), ("w", "b"), ("h", ""), ("(.)\\1+", "$1"),
)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def _folded(column: str) -> str:
    for pattern, to in LATIN_FOLDS:
        column = f"regexp_replace({column}, r'{pattern}', '{to}')"
    return column


def _statement(k: int, markers: tuple[str, ...]) -> str:
    """k + 1 segments for at most k errors: one segment at least stands unchanged, shifted by k places at most."""
    pieces = k + 1
    start = lambda m, j: f"(1 + ({m} * {j}) div {pieces})"
    kinds = lambda latin, bengali: (
        f"stack(3, 'plain', regexp_replace({latin}, '[^a-z]+', ''), 'folded', {_folded(latin)}, 'native', regexp_replace({bengali}, '[^\\\\u0980-\\\\u09FF]+', '')) AS (kind, text)"
    )
    dotted = (("09DC", "09A1"), ("09DD", "09A2"), ("09DF", "09AF"))

    def composed(column: str) -> str:
        for one, base in dotted:
            column = f"replace({column}, '\\u{one}', '\\u{base}\\u09BC')"
        return column

    return f"""
    WITH named AS (
      SELECT value, try_element_at(filter(transform(
          split({composed('lower(value)')}, r'[/,&();+|–—-]|\\s(?:with|and|or)\\s|এবং'),
          s -> array_join(filter(split(s, r'[^a-z\\u0980-\\u09FF]+'), w -> w <> '' AND NOT array_contains(array({_quoted(markers)}), w)), '')
        ), s -> s <> ''), 1) AS name
      FROM {{values}}
    ), spelled AS (
      SELECT value, kind, text, length(text) AS n
      FROM (SELECT value, {kinds('name', 'name')} FROM named WHERE name IS NOT NULL) WHERE length(text) >= (CASE WHEN kind = 'folded' THEN 3 ELSE 1 END)
    ), listed AS (
      SELECT DISTINCT ord, name, kind, text, length(text) AS m
      FROM (SELECT ord, name, {kinds('lower(name)', composed("coalesce(name_native, '')"))} FROM {{reference}} WHERE name IS NOT NULL) WHERE length(text) >= (CASE WHEN kind = 'folded' THEN 3 ELSE 1 END)
    ), segment AS (
      SELECT ord, name, kind, text, m, j, substring(text, {start('m', 'j')}, {start('m', '(j + 1)')} - {start('m', 'j')}) AS piece
      FROM (SELECT *, explode(sequence(0, {k})) AS j FROM listed)
    ), shape AS (
      SELECT DISTINCT kind, m, j, {start('m', 'j')} AS at, length(piece) AS size FROM segment WHERE piece <> ''
    ), probe AS (
      SELECT value, kind, text, m, j, substring(text, place, size) AS piece
      FROM (SELECT s.value, s.kind, s.text, s.n, h.m, h.j, h.size, explode(sequence(greatest(1, h.at - {k}), h.at + {k})) AS place
            FROM spelled s JOIN shape h ON s.kind = h.kind AND h.m BETWEEN s.n - {k} AND s.n + {k})
      WHERE place + size - 1 <= n
    ), checked AS (
      SELECT p.value, g.ord, g.name, levenshtein(p.text, g.text, {k}) AS errors, p.kind = 'folded' AS is_folded, g.m, least(length(p.text), g.m) AS shorter
      FROM probe p JOIN segment g ON p.kind = g.kind AND p.m = g.m AND p.j = g.j AND p.piece = g.piece
    ), close AS (
      SELECT value, ord, name, coalesce(min(errors) FILTER (WHERE NOT is_folded), {k} + 1) AS typed, coalesce(min(errors) FILTER (WHERE is_folded), {k} + 1) AS folded
      FROM checked WHERE errors >= 0 AND errors <= (CASE WHEN shorter < 3 THEN 0 ELSE greatest(1, (m - 1) div 2 - (CASE WHEN is_folded THEN 1 ELSE 0 END)) END) GROUP BY value, ord, name
    )
    SELECT value, min_by(name, struct(typed + folded, typed, ord)) AS entry, min(least(typed, folded)) AS errors FROM close GROUP BY value
    """


def map_to_reference(
    df: DataFrame, keys: list[str], value: str, reference: DataFrame, name: str, name_native: str | None = None, order: str | None = None, max_errors: int = 2, unmatched: str = "unmatched", markers: tuple[str, ...] = MARKER_WORDS
) -> DataFrame:
    """keys + (entry): the reference entry that each non-null value means, or ``unmatched``.

    The first name of a value counts (names are parted by / , & ( ) ; + | - and, with, or); words of
    ``markers`` and signs around it do not. A name is compared three ways: Latin letters as typed, Latin letters folded by ``LATIN_FOLDS``,
    native letters; at most ``max_errors`` edits, fewer for short names; names of one or two letters must be equal as typed. Each reference string is cut
    into max_errors + 1 segments; a string within max_errors edits holds one of them unchanged and at
    most max_errors places away, so the equi-join on (length, segment number, substring) loses no match;
    built-in levenshtein verifies, and an anti-join reports what is left as ``unmatched``. All of it is SQL.

    Matching and anti-join run once per distinct value, over all tasks; the mapping is joined back by value (AQE splits a hot value).
    Of several entries the one with fewest errors counts, typed and folded together, then typed, then the earlier entry. Null values give no row; empty and blank
    values are unmatched; repeated rows are kept; an empty reference list leaves all unmatched.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(value).alias("value")).where("value is not null")
    native = F.col(name_native) if name_native else F.lit(None).cast("string")
    ref = reference.select((F.col(order) if order else F.xxhash64(name)).cast("bigint").alias("ord"), F.col(name).alias("name"), native.alias("name_native"))
    # Values are few and short but each is probed many times, so they are spread by number, not by size.
    values = cut_lineage(rows.select("value").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value"))
    found = cut_lineage(spark.sql(_statement(max_errors, markers), values=values, reference=ref))
    columns = ", ".join(f"r.`{c}`" for c in keys)
    return spark.sql(
        f"""
        WITH mapping AS (
          SELECT value, entry FROM {{found}}
          UNION ALL
          SELECT v.value, '{unmatched}' AS entry FROM {{values}} v LEFT ANTI JOIN {{found}} f ON v.value = f.value
        )
        SELECT {columns}, m.entry FROM {{rows}} r JOIN mapping m ON r.value = m.value
        """,
        rows=rows,
        found=found,
        values=values,
    )
