"""Persons of a list named in free text, in any spelling."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import BROADCAST_LIMIT_BYTES, cut_lineage
from .forms import visible_form

# Romanisation of the letters of the native script; consonants carry "o" where no sign follows.
CONSONANTS = dict(zip("কখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহৎংঃঁ", "k k g g n c c j j n t t d d n t t d d n p p b b m j r l s s s h t n h".split() + [""])) | {"ড়": "r", "ঢ়": "r", "য়": ""}
VOWELS = dict(zip("অআইঈউঊএঐওঔঋ", "o a i i u u e oi o ou ri".split()))
SIGNS = dict(zip("ািীুূেৈোৌৃ", "a i i u u e oi o ou ri".split()))
# Spellings in Latin letters folded to the same letters, in this order.
LATIN = [(re.compile(a), b) for a, b in (
    ("aw(?=u)|aw", "o"), ("ow|au", "ou"), ("oo", "u"), ("ee|ii", "i"), ("y", ""), ("chh|cch|ch", "c"), ("zh|jh|z", "j"), ("f", "p"), ("[vw]", "b"), ("x", "ks"), ("q", "k"),
    ("(?<=[bcdgjklmnprst])h", ""), ("[^a-z]", ""),
)]
HONORIFICS = frozenset("sri shri shree smt sm pt pandit ustad dr prof late kumari begum mr mrs ms miss da di dada didi babu শ্রী শ্রীমতী শ্রীমতি পণ্ডিত ওস্তাদ উস্তাদ ডঃ ড ডক্টর প্রয়াত দা দি স্বর্গীয়".split())
# Words and signs that end one part of a title and begin another.
BREAK_WORDS = frozenset("by sings sung and feat ft with singer vocal artist official video audio full song songs topic music tv gaan creations records studio archive sound lyrical live hd channel কণ্ঠ গান ও এবং শিল্পী".split())
_BREAK = re.compile(r"[|:()\[\]/।&#+;•~]|\s[-–—]\s|\bby\b")
_TOKEN = re.compile(r"(?:[^\W\d_]|[̀-ͯঁ-ৗড়-ৣ])+\.?|[,\n]")


def once(udf):
    """The function marked so that Catalyst neither repeats it in a filter nor in a field access: it runs once for each row."""
    return udf.asNondeterministic()


_DOUBLED = re.compile(r"(.)\1+")
_ALL_CONSONANTS = "".join(CONSONANTS)


def name_key(word: str, fine: bool = False) -> str:
    """Sounds of a word in one alphabet, aspirates and doubled letters plain; vowels a, o and ou as one unless ``fine``."""
    return name_keys(word)[fine]


def name_keys(word: str) -> tuple[str, str]:
    """Both keys of a word, the plain and the fine one."""
    word = visible_form(word, fold_case=True) or ""
    if any("ঀ" <= c <= "৿" for c in word):
        for one, two in (("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়")):
            word = word.replace(one, two)
        out, k = [], 0
        while k < len(word):
            c = word[k]
            if word[k : k + 2] in CONSONANTS:
                c = word[k : k + 2]
            k += len(c)
            if c in CONSONANTS:
                out.append(CONSONANTS[c])
                nxt = word[k : k + 1]
                if nxt == "্":
                    k += 1
                elif nxt not in SIGNS and nxt and nxt in _ALL_CONSONANTS and c not in "ৎংঃঁ":
                    out.append("o")
            elif c in SIGNS:
                out.append(SIGNS[c])
            elif c in VOWELS:
                out.append(VOWELS[c])
            elif "a" <= c <= "z":
                out.append(c)
        key = "".join(out)
    else:
        key = word
        for pattern, to in LATIN:
            key = pattern.sub(to, key)

    def ended(key: str) -> str:
        key = _DOUBLED.sub(r"\1", key)
        return key[:-1] if len(key) > 3 and key[-1] in "oa" else key

    return ended(key.replace("ou", "o").replace("a", "o")), ended(key)


_QUOTES = str.maketrans(dict.fromkeys("“”\"'‘’_-", " "))


def parts_of(text: str | None, honorifics: frozenset[str] = HONORIFICS, breaks: frozenset[str] = BREAK_WORDS) -> list[str]:
    """Parts of a title or channel between breaks, each as its name words parted by blanks; a comma is a word of its own."""
    if not text:
        return []
    text = visible_form(text)
    text = text.lower() if text.isascii() else text.casefold()
    part: list[str] = []
    parts = [part]
    for token in _TOKEN.findall(_BREAK.sub("\n", text.replace("–", "-")).translate(_QUOTES)):
        if token[-1] != "." and token not in breaks and token not in honorifics and token != "\n":
            part.append(token)
            continue
        plain = token.rstrip(".")
        if plain == "\n" or plain in breaks:
            part = []
            parts.append(part)
        elif plain in honorifics and not (part and token[-1] == "." and plain in ("shri", "sri", "da", "di")):
            if part and plain not in ("da", "di", "দা", "দি"):
                part = []
                parts.append(part)
        else:
            part.append(plain + "." if token[-1] == "." and len(token) > 1 else plain)
    return [" ".join(p).strip(" ,") for p in parts if p and (p[0] != "," or any(x != "," for x in p))]


def _parts(honorifics: frozenset[str], breaks: frozenset[str]):
    """(row, part) of the texts of each row (row, text, text, ...); each distinct text of a batch is cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in batch.columns[1:]:
                coded = column.dictionary_encode()
                lists = [parts_of(t, honorifics, breaks) for t in coded.dictionary.to_pylist()]
                there = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
                code = coded.indices.drop_null().to_numpy()
                size = np.array([len(p) for p in lists], np.int64)
                begin = np.concatenate([[0], np.cumsum(size)])[:-1]
                n = size[code] if len(code) else np.empty(0, np.int64)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[code], n) if len(code) else np.empty(0, np.int64)
                parts = pa.array([p for x in lists for p in x], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(there, n))), parts.take(pa.array(place))], names=["row", "part"])

    return run


def initial_of(word: str) -> str | None:
    """Latin letter that a name beginning with this letter is abbreviated by."""
    letter = word[:1].lower()
    return letter if "a" <= letter <= "z" else "a" if letter == "আ" else (name_key(letter) or None) and name_key(letter)[0]


@once
@F.pandas_udf(T.StringType())
def _initial(words: pd.Series) -> pd.Series:
    return words.map(lambda w: initial_of(w) if isinstance(w, str) and len(w.rstrip(".")) == 1 else None)


_KEYS = T.StructType([T.StructField("key", T.StringType()), T.StructField("fine", T.StringType())])


@once
@F.pandas_udf(_KEYS)
def _keys(words: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([name_keys(w) if isinstance(w, str) else (None, None) for w in words], columns=["key", "fine"])


def edits(a: str, b: str) -> int:
    """Least number of letters put in, left out, changed, or exchanged with their neighbour."""
    if a == b:
        return 0
    # What begins and what ends both needs no edit.
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b or (len(a) == len(b) == 1):
        return max(len(a), len(b))
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


@once
@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1 - edits(x, y) / max(len(x), len(y), 1) for x, y in zip(a, b)], dtype=float)


def _grams(key: str):
    """Positional-free bigrams of the padded key as distinct strings (repeated ones are numbered)."""
    padded = F.concat(F.lit("^"), F.col(key), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2)))
    return F.array_distinct(grams)


def name_entries(persons: DataFrame, name: str, spellings: str) -> DataFrame:
    """(singer, kind, key, fine, typed): given names, surnames, whole names as one word, nicknames, beginnings and initials of the list.

    For nicknames ``fine`` is the nickname as spelled, for initials ``key`` is the Latin letter.
    """
    spelled = persons.select(F.col(name).alias("singer"), F.explode(F.array_union(F.coalesce(F.col(spellings), F.array()), F.array(name))).alias("spelling")).where("singer is not null and spelling is not null")
    words = spelled.select("singer", F.split(F.trim("spelling"), r"\s+").alias("w"))
    first, last = F.element_at("w", 1), F.element_at("w", -1)
    several, one = words.where(F.size("w") > 1), words.where(F.size("w") == 1)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), w.alias("word")) for k, w in (("given", first), ("surname", last), ("whole", F.concat(first, last)), ("whole", F.concat(last, first)))])).alias("e")
    rows = several.select("singer", kinds).select("singer", "e.*").select("singer", "kind", _keys("word").alias("k"), F.lower("word").alias("typed"))
    typed = rows.where("kind in ('given', 'surname') and typed rlike '^[a-z]{4,}$'").select("singer", F.concat(F.lit("typed_"), "kind").alias("kind"), F.col("typed").alias("key"), F.col("typed").alias("fine"), "typed")
    nicks = one.select("singer", F.lit("nick").alias("kind"), _keys(first).alias("k"), F.lower(first).alias("typed")).select("singer", "kind", "k.key", F.col("typed").alias("fine"), "typed")
    rows = rows.select("singer", "kind", "k.*", "typed").unionAll(typed).unionAll(nicks)
    base = rows.where("key <> ''").distinct()
    begun = base.where("kind in ('given', 'surname')").select("singer", F.concat("kind", F.lit("_begun")).alias("kind"), F.lit(None).cast("string").alias("key"), F.explode(F.expr("transform(sequence(1, greatest(1, length(fine) - 1)), n -> left(fine, n))")).alias("fine"), F.lit(None).cast("string").alias("typed"))
    initial = several.select("singer", F.lit("initial").alias("kind"), F.lower(F.left(first, F.lit(1))).alias("key"), F.lit(None).cast("string").alias("fine"), F.lit(None).cast("string").alias("typed")).where(F.col("key").rlike("^[a-z]$"))
    return base.unionAll(begun).unionAll(initial).distinct()


def similar_words(words: DataFrame, entries: DataFrame, least: float = 0.72, key_least: float = 0.65) -> DataFrame:
    """(word, singer, kind, sim) of corpus words (word, key, fine) and list entries (singer, kind, key, fine) with similar keys or,
    in Latin letters, similar typed forms (an exchange of letters can change how a sound is read).

    Set-similarity join on bigrams with prefix filter: in both sets the bigrams are ordered from rare to
    common; at similarity t (common bigrams / bigrams of the larger set) two sets of sizes x and y share a bigram within their first
    x - ceil(t x) + 1 and y - ceil(t y) + 1. t = 0.25: one exchange of neighbours changes three bigrams. Verified are the
    likeness (1 - edits / length) of the keys, ``key_least`` or more, and the mean of key, fine key and, where both are in one script, typed
    words, ``least`` or more. Every prefilter follows from these.
    """
    typed = words.where("word rlike '^[a-z]{4,}[.]?$'").select("word", F.rtrim(F.col("word"), F.lit(".")).alias("key"))
    typed = typed.withColumn("fine", F.col("key"))
    typed_entries = entries.where("kind in ('typed_given', 'typed_surname')").withColumn("kind", F.substring("kind", 7, 20))
    close = _similar_forms(words, entries, least, key_least).unionAll(_similar_forms(typed, typed_entries, least, key_least))
    begun = words.join(entries.where("kind in ('given_begun', 'surname_begun')").select("singer", "kind", "fine"), "fine").where(
        "(kind = 'given_begun' and length(fine) >= 2 and length(replace(word, '.', '')) >= 3) or (kind = 'surname_begun' and word like '___%.')"
    )
    initials = words.where("length(replace(word, '.', '')) = 1").select("word", _initial("word").alias("letter")).join(entries.where("kind = 'initial'").select("singer", "kind", F.col("key").alias("letter")), "letter")
    exact = begun.select("word", "singer", "kind").unionAll(initials.select("word", "singer", "kind"))
    sims = F.when(F.col("kind") == "initial", 0.85).otherwise(0.9)
    return close.unionAll(exact.select("word", "singer", "kind", sims.alias("sim"))).groupBy("word", "singer", "kind").agg(F.max("sim").alias("sim"))


def _rare_first(frequency: dict[str, int], t: float):
    """The first x - ceil(t x) + 1 bigrams of a set from rare to common."""

    @once
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def prefix(sets: pd.Series) -> pd.Series:
        return pd.Series([sorted(s, key=lambda g: (frequency.get(g, 0), g))[: len(s) - math.ceil(t * len(s)) + 1] for s in sets], dtype=object)

    return prefix


def similar_keys(one: DataFrame, two: DataFrame, key_least: float, t: float = 0.25) -> DataFrame:
    """(key, entry_key, key_sim) of two frames of distinct keys whose bigram sets share a prefix bigram and whose likeness is ``key_least`` or more."""
    one, two = one.withColumn("grams", _grams("key")), two.withColumn("grams", _grams("key"))
    # Bigrams of folded keys and Latin words: the square of the alphabet bounds them.
    counts = one.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    prefix = _rare_first({r["gram"]: r["n"] for r in counts}, t)
    a = one.select("key", F.size("grams").alias("x"), F.explode(prefix("grams")).alias("gram"))
    b = two.select(F.col("key").alias("entry_key"), F.size("grams").alias("y"), F.explode(prefix("grams")).alias("gram"))
    longer = F.greatest(F.length("key"), F.length("entry_key"))
    edits_allowed = F.floor((1 - key_least) * longer + 1e-9)
    return (
        a.join(_small(b, 64), "gram")
        .where(f"x >= {t} * y and y >= {t} * x")
        .where(F.abs(F.length("key") - F.length("entry_key")) <= edits_allowed)
        .select("key", "entry_key")
        .distinct()
        # Built-in levenshtein counts an exchange as two, so it is at most twice the edits: what fails here fails the next test.
        .where(F.levenshtein("key", "entry_key") <= 2 * edits_allowed)
        .withColumn("key_sim", _likeness("key", "entry_key"))
        .where(F.col("key_sim") >= key_least)
    )


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The frame, to be broadcast where its counted rows stay within the limit, else left to Catalyst."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_LIMIT_BYTES else df


def _similar_forms(words: DataFrame, entries: DataFrame, least: float, key_least: float) -> DataFrame:
    fuzzy = entries.where("kind in ('given', 'surname', 'whole', 'nick')")
    near = similar_keys(words.select("key").where("length(key) >= 2").distinct(), fuzzy.select("key").distinct(), key_least)
    close = (
        words.join(near, "key")
        .join(fuzzy.select("singer", "kind", F.col("key").alias("entry_key"), F.col("fine").alias("entry_fine"), "typed"), "entry_key")
        .withColumn("bare", F.rtrim(F.col("word"), F.lit(".")))
        .withColumn("fine_sim", _likeness("fine", "entry_fine"))
        .withColumn("typed_sim", F.when(F.col("kind").isin("given", "surname"), _likeness("bare", "typed")))
        .withColumn("sound", (F.col("key_sim") + F.col("fine_sim")) / 2)
        .withColumn("sim", F.when(F.col("kind") == "nick", F.when(F.col("bare") == F.col("typed"), 1.0).otherwise(F.col("key_sim") * 0.99)).when(F.col("kind") == "whole", F.col("sound")).when(F.col("bare").rlike("^[a-z]") == F.col("typed").rlike("^[a-z]"), (F.col("sound") + F.col("typed_sim")) / 2).otherwise(F.col("sound") * 0.92))
        .where(f"(kind = 'nick' and key_sim >= 0.99) or (kind = 'whole' and sim >= 0.87) or (kind in ('given', 'surname') and sim >= {least})")
    )
    return close.select("word", "singer", "kind", "sim")


def named_persons_scored(
    df: DataFrame, ident: str, columns: list[str], persons: DataFrame, name: str, spellings: str, threshold: float = 0.8, honorifics: frozenset[str] = HONORIFICS, breaks: frozenset[str] = BREAK_WORDS
) -> DataFrame:
    """(ident, singer, part, score): the persons of the list that each row names in any of its text columns.

    Columns are cut into parts at signs and at ``breaks``, words that part names from titles; ``honorifics`` are left out; each distinct part is
    matched once. A part names a person where
    - a word like the given name (or its beginning, the nickname, or an initial that begins the part or
      stands alone beside the surname) stands next to a word like the surname (or its beginning with a
      full stop), in either order, a middle initial or, after the surname, a comma between them;
    - one word is like both joined; or the whole part is a nickname.
    The pair's soft weighted similarity, each word weighted by ln(1 + persons / persons that have it), must
    reach ``threshold``: a surname that many share cannot carry a pair, a rare given name can.

    Null and empty texts name nobody; null identifiers are left out; repeated rows count each by their own
    identifier; a row names a person once. Empty input or list: empty result.
    """
    # Each stage is written once to the shared folder: it is read by several later ones, and a plan that holds all of them grows beyond the driver.
    texts = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("row"), *[F.col(c).alias(f"text{i}") for i, c in enumerate(columns)])
    rows = cut_lineage(texts.mapInArrow(_parts(honorifics, breaks), T.StructType([T.StructField("row", texts.schema["row"].dataType), T.StructField("part", T.StringType())])))
    parts = cut_lineage(rows.select("part").distinct())
    tokens = parts.select("part", F.posexplode(F.split("part", " ")).alias("pos", "word")).where("word not in ('', ',')")
    words = cut_lineage(tokens.select("word").distinct().select("word", _keys("word").alias("k")).select("word", "k.*").where("key <> ''"))
    entries = cut_lineage(name_entries(persons, name, spellings))
    n_persons = entries.select(F.countDistinct("singer")).first()[0]  # one number
    weights = (
        entries.where("kind in ('given', 'surname')")
        .groupBy("kind", "key")
        .agg(F.countDistinct("singer").alias("df"), F.collect_set("singer").alias("who"))
        .select("kind", "df", F.explode("who").alias("singer"))
        .groupBy("singer", "kind")
        .agg(F.max("df").alias("df"))
        .groupBy("singer")
        .agg(*[F.max(F.when(F.col("kind") == k, F.log(1 + n_persons / F.col("df")))).alias(f"w_{k}") for k in ("given", "surname")])
    )
    alike = cut_lineage(similar_words(words, entries))
    hits = cut_lineage(tokens.join(_small(alike, 128), "word").select("part", "pos", "singer", "kind", "sim"))
    given = hits.where("kind in ('given', 'given_begun', 'nick', 'initial')").select("part", "singer", F.col("pos").alias("g"), F.col("kind").alias("g_kind"), F.col("sim").alias("g_sim"))
    # Only neighbours up to two places away meet: an equi-join, also where a long text repeats a name.
    surname = hits.where("kind in ('surname', 'surname_begun')").select("part", "singer", F.col("pos").alias("s"), F.col("kind").alias("s_kind"), F.col("sim").alias("s_sim"), F.explode(F.expr("transform(array(-2, -1, 1, 2), d -> pos + d)")).alias("g"))
    word_at = lambda p: F.try_element_at(F.split("part", " "), p + 1)
    single = lambda w: F.length(F.replace(w, F.lit("."))) == 1
    between, before = word_at(((F.col("g") + F.col("s")) / 2).cast("int")), F.when(F.col("g") > 0, word_at(F.col("g") - 1))
    apart = F.abs(F.col("g") - F.col("s"))
    together = (apart == 1) | single(between) | ((between == ",") & (F.col("s") < F.col("g")))
    last = F.size(F.split("part", " ")) - 1
    initial_ok = (F.col("g_kind") != "initial") | ((F.col("g") < F.col("s")) & (apart == 1) & ((F.col("g") == 0) | F.coalesce(before == ",", F.lit(False)))) | ((F.col("g") > F.col("s")) & (F.col("g") == last))
    not_both_cut = ~(F.col("g_kind").isin("initial", "given_begun") & (F.col("s_kind") == "surname_begun"))
    surname_sure = F.col("g_kind").isin("given", "nick") | (F.col("s_sim") >= 0.82)
    scored = given.join(surname, ["part", "singer", "g"]).where(together & initial_ok & not_both_cut & surname_sure).join(weights, "singer")
    total = (F.col("w_given") * F.col("g_sim") + F.col("w_surname") * F.col("s_sim")) / (F.col("w_given") + F.col("w_surname"))
    by_pair = scored.select("part", "singer", F.least("g", "s").alias("at"), total.alias("score")).where(F.col("score") >= threshold)
    by_word = hits.where((F.col("kind") == "whole") | ((F.col("kind") == "nick") & (F.col("sim") == 1) & (last == 0))).select("part", "singer", F.col("pos").alias("at"), F.col("sim").alias("score"))
    # One place names one person: the best score, equal scores all.
    place = Window.partitionBy("part", "at")
    named = by_pair.unionAll(by_word).groupBy("part", "singer", "at").agg(F.max("score").alias("score")).withColumn("best", F.max("score").over(place)).where(F.col("score") >= F.col("best") - 1e-9)
    return rows.join(named, "part").select(F.col("row").alias(ident), "singer", "part", "score")


def named_persons(df: DataFrame, ident: str, columns: list[str], persons: DataFrame, name: str, spellings: str, threshold: float = 0.8) -> DataFrame:
    """(ident, singer) of ``named_persons_scored``, each pair once."""
    return named_persons_scored(df, ident, columns, persons, name, spellings, threshold).select(ident, "singer").distinct()
