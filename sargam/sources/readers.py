"""Sources and sinks: documents as tables, markup fields, keyed upserts, published files, audits."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import clean_page


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def schema(**fields: str) -> T.StructType:
    """A schema by field names and SQL types."""
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields.items()))


_S, _L = T.StringType(), T.LongType()
CANDIDATE = _struct(id=_S, title=_S, channel=_S, views=_L, likes=_L, seconds=T.IntegerType(), embeddable=T.BooleanType())
CANDIDATES = _struct(song_id=_S, queries=T.ArrayType(_S), fetched=_S, refreshed=_S, candidates=T.ArrayType(CANDIDATE), videos=T.ArrayType(CANDIDATE))


def read_document(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """One JSON document of an array of records, or with ``lines`` records by line, which are split among tasks; the schema is given, never guessed."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_document``; an empty table where the path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return read_document(spark, path, schema)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def read_directory(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A directory of one JSON document per key as a table; names that begin with _ are left out; adds ``key``, the name without suffix."""
    df = read_document(spark, path, schema, lines)
    return df.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def restrict_to(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows of a list of ids; reaches the scan as a pushed filter."""
    return df.where(F.col(key).isin(ids))


def index_links(html: Column, link: str = r'<a href="([^"]+)">([^<]*)</a>') -> Column:
    """array<struct(path, title)> of an index page's links."""
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("path"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("title"))


def page_fields(html: Column, label: str = r"<b>([^<:]+)</b>:\s*([^<]*)") -> Column:
    """map<label, value> of a page's labelled fields; of equal labels the last."""
    labels = F.transform(F.regexp_extract_all(html, F.lit(label), F.lit(1)), lambda x: F.trim(x))
    values = F.transform(F.regexp_extract_all(html, F.lit(label), F.lit(2)), lambda x: F.trim(x))
    pairs = F.arrays_zip(labels.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


class _Page(HTMLParser):
    """Labelled values of a page, and the text of its preformatted blocks; tags within them do not count."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.fields: dict[str, str] = {}
        self.blocks: list[str] = []
        self.depth = self.bold = 0
        self.label, self.value = "", None

    def finish(self) -> None:
        if self.value is not None:
            self.fields[self.label.strip().rstrip(":").strip()] = self.value.strip().lstrip(":").strip()
        self.label, self.value = "", None

    def handle_starttag(self, tag, attrs):
        if tag == "pre":
            self.finish()
            self.blocks += [] if self.depth else [""]
            self.depth += 1
        elif not self.depth and tag == "b":
            self.finish()
            self.bold += 1
        elif not self.depth and tag in ("br", "p", "div", "li", "tr", "h1"):
            self.finish()
        elif self.depth and tag == "br":
            self.blocks[-1] += "\n"

    def handle_endtag(self, tag):
        if tag == "pre" and self.depth:
            self.depth -= 1
        elif tag == "b" and self.bold and not self.depth:
            self.bold -= 1
            self.value = "" if self.label.strip() else None
        elif not self.depth and tag in ("p", "div", "li", "tr"):
            self.finish()

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data
        elif self.bold:
            self.label += data
        elif self.value is not None:
            self.value += data


@F.pandas_udf(T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]))
def parsed_page(pages: pd.Series) -> pd.DataFrame:
    """struct(fields map<label, value>, text) of HTML pages of any nesting: '<b>label</b>: value' to the end of its block, of equal labels the last, and the preformatted text."""
    rows = []
    for html in pages:
        page = _Page()
        if isinstance(html, str):
            page.feed(html)
            page.close()
            page.finish()
        rows.append((page.fields, "\n".join(page.blocks) if page.blocks else None))
    return pd.DataFrame(rows, columns=["fields", "text"])


def parsed_candidates(df: DataFrame, body: str) -> DataFrame:
    """Candidates of landed search documents: nested fields by schema, missing counts 0."""
    schema = "items array<struct<id string, snippet struct<title string, channelTitle string>, contentDetails struct<duration string>, statistics struct<viewCount string, likeCount string>, status struct<embeddable boolean>>>"
    from ..functions.text import iso_seconds

    item = df.select(*[c for c in df.columns if c != body], F.explode(F.from_json(body, schema)["items"]).alias("i"))
    count = lambda c: F.coalesce(F.col(f"i.statistics.{c}").try_cast("bigint"), F.lit(0))
    return item.select(
        *[c for c in df.columns if c != body], F.col("i.id").alias("id"), F.coalesce("i.snippet.title", F.lit("")).alias("title"), F.coalesce("i.snippet.channelTitle", F.lit("")).alias("channel"), count("viewCount").alias("views"), count("likeCount").alias("likes"),
        iso_seconds("i.contentDetails.duration").alias("seconds"), F.coalesce("i.status.embeddable", F.lit(False)).alias("embeddable"),
    )


# Last words of stage directions, and the sign that ends a speaker's name.
STAGE_WORDS = ("প্রবেশ", "প্রস্থান", "অন্তর্ধান")
SPEAKER_END, SPEAKER_AND = "।", "ও"


def ordered_lines(pages: DataFrame, number: str, text: str, ranges: list[tuple[int, int]], directions: tuple[str, ...] = STAGE_WORDS, longest_direction: int = 59) -> DataFrame:
    """(page, pos, line) of ranges of page numbers in order, from pages with markup.

    Left out: a speaker's name before the line (words joined by ``SPEAKER_AND``, up to the first ``SPEAKER_END``), stage
    directions (lines of up to ``longest_direction`` letters that end on a word of ``directions``), lines of digits and blank ones. Null pages
    give no line. Order by (page, pos).
    """
    spark = pages.sparkSession
    numbers = spark.createDataFrame(ranges, "first long, last long").select(F.explode(F.sequence("first", "last")).alias(number)).distinct()
    lines = pages.join(numbers, number, "left_semi").select(F.col(number).alias("page"), F.posexplode(F.split(clean_page(text), "\n")).alias("pos", "typed"))
    head = F.substring_index("typed", SPEAKER_END, 1)
    speaker = F.col("typed").contains(SPEAKER_END) & F.forall(F.split(head, rf"\s+{SPEAKER_AND}\s+"), lambda w: (w != "") & ~w.rlike(r"\s"))
    lines = lines.withColumn("line", F.trim(F.when(speaker, F.substr("typed", F.length(head) + 2)).otherwise(F.col("typed"))))
    ending = F.rtrim(F.col("line"), F.lit(SPEAKER_END))
    direction = F.exists(F.array(*[F.lit(d) for d in directions]), lambda d: F.endswith(ending, d)) & (F.length("line") <= longest_direction)
    only_digits = F.col("line").rlike(r"^[\s\p{Nd}]*$")
    return lines.where(~direction & ~only_digits).select("page", "pos", "line")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites a Parquet table; with partitions only those that the rows fall in."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Overwrites a directory of JSON lines; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_published(df: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """A published table of any size: ``path``/rows holds its rows as JSON lines without null fields, ``path``/meta one line with their number and ``meta``."""
    write_documents(df, f"{path}/rows")
    named = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    df.agg(F.count("*").alias("count")).select("count", *named).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def audit(decisions: DataFrame, column: str = "decision", most: int = 100) -> dict[str, DataFrame]:
    """One table for each kind of decision of a linker; more than ``most`` kinds raise, since kinds are few by contract."""
    kinds = [r[0] for r in decisions.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(kinds) > most:
        raise ValueError(f"more than {most} kinds of {column}")
    return {k: decisions.where(F.col(column).eqNullSafe(F.lit(k))) for k in kinds}


def with_metrics(df: DataFrame, name: str, **counted: Column):
    """The rows with an observation that counts them and each condition while they are written."""
    from pyspark.sql import Observation

    observation = Observation(name)
    return df.observe(observation, F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in counted.items()]), observation


def due(last: DataFrame, column: str, days: int, now: Column | None = None) -> DataFrame:
    """One row (due): whether the last run is ``days`` or more ago; no run yet is due."""
    now = F.current_timestamp() if now is None else now
    latest = F.max(F.col(column).cast("timestamp"))
    return last.agg(F.coalesce(now >= latest + F.make_interval(days=F.lit(days)), F.lit(True)).alias("due"))
