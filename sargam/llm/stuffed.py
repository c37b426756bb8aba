"""Pages of stuffed keywords, link lists and tags, told from prose by their rank-frequency curves."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .forms import visible_form

_URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?(?![\w@])")
_ANCHOR = re.compile(r'<a\s[^>]*?href\s*=\s*["\']?([^"\'>\s]*)[^>]*>(.*?)</a>', re.S)
_MARKDOWN = re.compile(r"\[([^\]\n]*)\]\(([^)\s]*)\)")
_MARKUP = re.compile(r"</?[a-z][^<>]*>")
_TAG = re.compile(r"#(?:[^\W_]|[_ऀ-ॣ०-෿])+")
_WORD = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ॣ०-෿])+")
_NATIVE = re.compile(r"[ऀ-෿]+")
# Function words that tell English prose from other text in Latin letters.
ENGLISH = frozenset("the a an of and in that is for to it was with on by from".split())
# Terms that stand for a kind of thing, whatever it is in particular: a link with the first words of its label, a tag, a line that stood before.
LINK, TAG, AGAIN = "\x01link", "\x01tag", "\x01again"
# Words beside a link on its line that are counted as part of it, for each link.
LABEL_WORDS = 1

# The entropy of prose is at least that of so many equally frequent terms.
LEAST_TERMS = 7

_PARSED = T.StructType([T.StructField("family", T.StringType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def page_terms(text: str | None) -> tuple[str, Counter]:
    """(language family, how often each term stands on the page).

    Terms are the words of each line where it first stands, and kinds: every link is one and the same term, with
    ``LABEL_WORDS`` of its line, as is every hashtag, and every line that stood before (a refrain counts once for each repeat, not word by word).
    """
    if not text:
        return "none", Counter()
    text = visible_form(text, fold_case=True)
    if "<" in text:
        text = _MARKUP.sub(" ", _ANCHOR.sub(r" \2 \1 ", text))
    if "](" in text:
        text = _MARKDOWN.sub(r" \1 \2 ", text)
    kinds = Counter()
    kept: list[str] = []
    seen: set[str] = set()
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        plain, links, tags = line, 0, 0
        if "." in line:
            plain, links = _URL.subn(" ", line)
        if "#" in plain:
            plain, tags = _TAG.subn(" ", plain)
        found = _WORD.findall(plain)
        if links:
            labels = min(len(found), LABEL_WORDS * links)
            kinds[LINK] += links + labels
            found = found[labels:]
        if tags:
            kinds[TAG] += tags
        if line not in seen:
            seen.add(line)
            kept += found
        elif found:
            kinds[AGAIN] += 1
    if not text.isascii() and sum(map(len, _NATIVE.findall(text))) * 2 > sum(map(len, kept)):
        family = "native"
    else:
        family = "english" if sum(w in ENGLISH for w in kept) > 0.05 * len(kept) else "latin"
    counts = Counter(kept)
    counts.update(kinds)
    return family, counts


@F.pandas_udf(_PARSED)
def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        family, counts = page_terms(text if isinstance(text, str) else None)
        rows.append((family, list(counts.values())))
    return pd.DataFrame(rows, columns=_PARSED.names)


def page_curves(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per page: the rank-frequency curve of its terms, fitted by SQL windows.

    Columns: page, family, n (terms), ``slope`` and ``residual`` (root mean square) of the line of ln(frequency) on ln(rank), ``repetition`` = mean ln(frequency)
    over the terms (0 where every one is new, ln n where one fills the page).
    """
    pages = df.select(F.col(ident).alias("page"), _parse(text).alias("p")).where("page is not null").select("page", "p.*")
    pages = pages.repartition("page")  # the only shuffle: counts, not text; everything below keeps to it
    ranked = pages.select("page", "family", F.explode("counts").alias("f")).withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.col("f").desc())))
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("f").cast("double"))
    return ranked.groupBy("page").agg(
        F.first("family").alias("family"),
        F.sum("f").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy(y, x) - F.coalesce(F.regr_sxy(y, x) * F.regr_slope(y, x), F.lit(0.0))) / F.count("f"))).alias("residual"),
        (F.sum(F.col("f") * y) / F.sum("f")).alias("repetition"),
    )


def _prose_lines(curves: DataFrame) -> DataFrame:
    """For each language family and each measure the line y = a + b ln(n), through medians of half-octave length classes weighted by their pages.

    y is ln(repetition + 0.02), slope, and residual: what prose of that family has at each length.
    """
    middle = lambda c: F.percentile_approx(c, 0.5, 1000).alias(c)
    classes = curves.groupBy("family", F.floor(2 * F.log2("n")).alias("class")).agg(F.count("*").alias("w"), F.avg(F.log("n")).alias("x"), *[middle(c) for c in _MEASURES])
    classes = classes.withColumn("repetition", F.log(F.col("repetition") + 0.02))
    sums = {"w": F.lit(1.0), "x": F.col("x"), "xx": F.col("x") * F.col("x")} | {f"{k}_{c}": F.col(c) * (F.col("x") if k == "xy" else 1) for c in _MEASURES for k in ("y", "xy")}
    s = classes.groupBy("family").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in sums.items()])
    spread = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    lines = []
    for c in _MEASURES:
        b = F.when(spread > 1e-9, (F.col("w") * F.col(f"xy_{c}") - F.col("x") * F.col(f"y_{c}")) / spread).otherwise(0.0)
        lines += [b.alias(f"b_{c}"), ((F.col(f"y_{c}") - b * F.col("x")) / F.col("w")).alias(f"a_{c}")]
    return s.select("family", *lines)


_MEASURES = ("repetition", "slope", "residual")


def _expected(measure: str):
    at = F.col(f"a_{measure}") + F.col(f"b_{measure}") * F.log("n")
    return F.exp(at) - 0.02 if measure == "repetition" else at


def stuffed_pages(df: DataFrame, ident: str, text: str, divergence: float = 0.55, steep_divergence: float = 0.35, steeper: float = 0.26, misfit: float = 0.05) -> DataFrame:
    """Pages that consist mostly of repeated keywords, links, tags or one pattern with exchanged keywords, by their rank-frequency curves.

    Columns: page, reason ('divergence', 'slope' or null), family, n, slope, residual, repetition, expected (repetition).
    Each measure is held against what prose of the same language family has at this length (``_prose_lines``); the lines are
    fitted over all pages of the input, then once more without those that the first fit flags.

    Pages with less entropy than ``LEAST_TERMS`` equally frequent terms have are never taken for prose, and a family without any page of prose
    is held against a page without repetition.

    - divergence: the repetition exceeds that of prose by ``divergence``;
    - slope: it exceeds it by ``steep_divergence``, and the curve is steeper by ``steeper`` while it is as straight as that of
      prose (residual at most ``misfit`` over it): many words, all of them repeated. A refrain or a list of
      references raises single ranks above a flat curve and so bends it.

    Null and empty pages are never reported, pages of one term neither; a null identifier is left out; one row per
    identifier (of repeated identifiers the terms are put together). Texts of any length are read whole. Empty input: empty result.
    """
    curves = cut_lineage(page_curves(df, ident, text))  # read three times: two fits and the verdict
    over = lambda c: F.col(c) - _expected(c)
    varied = curves.where((F.log("n") - F.col("repetition") >= math.log(LEAST_TERMS)) & F.col("slope").isNotNull())
    first = varied.join(F.broadcast(_prose_lines(varied)), "family")  # one row per language family
    plain = first.where(over("repetition") < divergence).select(*curves.columns)
    judged = curves.join(F.broadcast(_prose_lines(plain)), "family", "left")
    excess = F.coalesce(over("repetition"), F.col("repetition"))
    reason = F.when((F.col("n") > 1) & (excess >= divergence), "divergence").when(
        (excess >= steep_divergence) & (over("slope") <= -steeper) & (over("residual") <= misfit), "slope"
    )
    return judged.select("page", reason.alias("reason"), "family", "n", "slope", "residual", "repetition", _expected("repetition").alias("expected"))
