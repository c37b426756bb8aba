"""One consistent form for text that looks the same."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Letters and signs of other code points drawn like the one they are mapped to.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ɑ": "a", "ɡ": "g", "ı": "i",
    "৷": "।", "৸": "॥",
    "‐": "-", "‑": "-", "−": "-", "ʼ": "’", "∕": "/", "⁄": "/",
}
# Sequences drawn like one letter (vowel A with its sign, BA with a dot, vowel sign parts), written decomposed.
DRAWN_AS_ONE = {
    "অা": "আ",
    "ব়": "র",
    "ো": "ো",
    "ৌ": "ৌ",
}
_NOT_IGNORABLE = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0xFFF9, 0xFFFC), *range(0x13430, 0x13440)}
_ALSO_IGNORABLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}


@lru_cache(maxsize=1)
def _tables():
    formats = (*range(0x20000), *range(0xE0000, 0xE1000))  # planes that have format characters
    ignorable = {i for i in formats if unicodedata.category(chr(i)) == "Cf"} - _NOT_IGNORABLE | _ALSO_IGNORABLE
    spaces = {i for i in range(0x3001) if unicodedata.category(chr(i)) == "Zs" and i != 0x20} | {0x9, 0xB, 0xC}
    lines = {0x85, 0x2028, 0x2029}
    first = {chr(i): "" for i in ignorable} | {chr(i): " " for i in spaces} | {chr(i): "\n" for i in lines}

    def one_of(characters) -> re.Pattern:
        runs: list[list[int]] = []
        for code in sorted(map(ord, characters)):
            if runs and code == runs[-1][1] + 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")

    # a dot typed after the vowel sign is drawn like a dot typed before it
    dot = re.compile("([\u09be-\u09cc\u09d7])\u09bc")
    # Texts of these characters only, without the sequences below, are in their form already but for case and blanks at ends.
    plain = re.compile("[\\n -~\u0964\u0965\u0980-\u09db\u09e0-\u09ef“”‘’—–♪❤]*")
    odd = re.compile("|".join([*DRAWN_AS_ONE, "[\u09be-\u09cc\u09d7\u09cd]\u09bc"]))
    return first, one_of(first), one_of(LOOK_ALIKE), re.compile("|".join(DRAWN_AS_ONE)), dot, plain, odd


def visible_form(text: str | None, fold_case: bool = False) -> str | None:
    """The form of ``text`` that every text with the same visible characters shares.

    In this order: line ends and blanks to one kind, default-ignorable characters out, compatibility
    composition (NFKC), look-alike letters and signs to one code point, letter sequences drawn as one
    letter to that letter, full case folding where ``fold_case``, NFKC again; blanks at the ends of
    the text and of its lines out. Null stays null. Idempotent.
    """
    if text is None:
        return None
    first, first_class, alike_class, one, dot, plain, odd = _tables()
    simple = plain.fullmatch(text) is not None and odd.search(text) is None
    if not simple:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = first_class.sub(lambda m: first[m[0]], text)
        if not text.isascii():
            # Letters are mapped without their accents, so that an accent on either letter gives one composed letter.
            text = first_class.sub(lambda m: first[m[0]], unicodedata.normalize("NFKD", text))
            text = unicodedata.normalize("NFKC", alike_class.sub(lambda m: LOOK_ALIKE[m[0]], text))
            while odd.search(text):
                before, text = text, unicodedata.normalize("NFKC", one.sub(lambda m: DRAWN_AS_ONE[m[0]], dot.sub("\u09bc\\1", text)))
                if text == before:
                    break
    if fold_case:
        text = text.lower() if simple or text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text.casefold()))
    if " \n" in text:
        text = "\n".join(line.rstrip(" ") for line in text.split("\n"))
    return text.strip(" \n")


def visible_form_column(column: Column | str, fold_case: bool = False) -> Column:
    """``visible_form`` as an Arrow batch expression, worked out once per distinct value of a batch."""

    @F.pandas_udf(T.StringType())
    def form(values: pd.Series) -> pd.Series:
        coded = pa.Array.from_pandas(values, type=pa.string()).dictionary_encode()
        formed = pa.array([visible_form(v, fold_case) for v in coded.dictionary.to_pylist()], pa.string())
        return pa.DictionaryArray.from_arrays(coded.indices, formed).cast(pa.string()).to_pandas()

    # Marked as not deterministic, so that a filter on the form doesn't make it run twice.
    return form.asNondeterministic()(F.col(column) if isinstance(column, str) else column)


def look_alike_pairs(df: DataFrame, ident: str, columns: list[str], fold_case: bool = False) -> DataFrame:
    """Pairs (id_a < id_b) whose ``columns`` all look the same while at least one is stored differently.

    Rows with a null id, or a null or empty (also: blank only) value in any of the columns do not
    count. Repeated rows of one id count once. Pairs stored identically are no pairs. Case counts as
    visible unless ``fold_case``. Empty input: empty result. Other columns are ignored.

    The ways of storing one form are paired first (an equi-join on the form's digest), then each pair of
    ways is expanded to its ids. So every joined row is a row of the result: a form with any number
    of identically stored copies costs nothing by itself.
    """
    raw = df.select(F.col(ident).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).where("id is not null")
    for i in range(len(columns)):
        raw = raw.where(f"c{i} is not null and c{i} <> ''")
    formed = raw.select("id", *[f"c{i}" for i in range(len(columns))], *[visible_form_column(f"c{i}", fold_case).alias(f"f{i}") for i in range(len(columns))])
    for i in range(len(columns)):
        formed = formed.where(f"f{i} <> ''")
    parts = lambda x: F.concat_ws("\u0000", *[f"{x}{i}" for i in range(len(columns))])
    # Ids and digests are written once to the shared folder: four joins read them, and no text is formed twice.
    keyed = cut_lineage(formed.select("id", F.sha2(parts("f").cast("binary"), 256).alias("form"), F.sha2(parts("c").cast("binary"), 256).alias("stored")).distinct())
    ways = keyed.select("form", "stored").distinct()
    several = ways.alias("x").join(ways.alias("y"), F.expr("x.form = y.form and x.stored < y.stored")).select(F.col("x.stored").alias("one"), F.col("y.stored").alias("other"))
    members = keyed.select("stored", "id")
    return (
        several.join(members.select(F.col("stored").alias("one"), F.col("id").alias("p")), "one")
        .join(members.select(F.col("stored").alias("other"), F.col("id").alias("q")), "other")
        .where("p <> q")
        .select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
        .distinct()
    )
