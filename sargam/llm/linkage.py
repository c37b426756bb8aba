"""Records of two sources matched without a key: candidate pairs, evidence, and loopy belief propagation."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .forms import visible_form
from .names import name_key, once

_TOKEN = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f\u0981-\u09ff])+|\n")
_NOTE = re.compile(r"[(\[][^)\]\n]*[)\]]")
# Codes that no word has: a word without a sound, a line end, and what stands before the word of a title of one word.
_SILENT, _LINE, _ALONE = 0, 1, 2


class _Sounds(dict):
    """Code of a word's sound, so that both scripts agree; worked out once for each distinct word of a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self["\n"] = _LINE
        key = name_key(word)
        code = self[word] = max(3, xxhash.xxh64_intdigest(key)) if key else _SILENT
        return code


_SOUNDS = _Sounds({"\n": _LINE})


def _codes(text: str | None) -> list[int]:
    """Codes of the words and line ends of a text; notes in brackets and words without a sound do not count."""
    if not text:
        return []
    return [c for c in [_SOUNDS[t] for t in _TOKEN.findall(_NOTE.sub(" ", visible_form(text, fold_case=True)))] if c]


def _has_pair(codes: list[int]) -> bool:
    return any(a > _LINE and b > _LINE for a, b in zip(codes, codes[1:]))


def _body_and_head(native: str | None, other: str | None, *titles: str | None) -> tuple[list[int], list[int]]:
    body = _codes(native)
    if all(c == _LINE for c in body):
        body = _codes(other)
    head: list[int] = []
    for title in titles:
        head += [*_codes(title), _LINE]
    if not _has_pair(head):
        words = [c for c in head if c > _LINE]
        start = next((k for k, c in enumerate(body) if c > _LINE), len(body))
        end = next((k for k in range(start, len(body)) if body[k] == _LINE), len(body))
        head = [x for w in words for x in (_LINE, _ALONE, w)] + [_LINE, *body[start:end]]
    return body, head


def _pair_sets(texts: list[list[int]]) -> pa.ListArray:
    """The distinct hashes of neighbouring words of each text, sorted."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.fromiter((c for t in texts for c in t), np.uint64, len(owner))
    a, b = codes[:-1], codes[1:]
    pair = (a > _LINE) & (b > _LINE) & (owner[:-1] == owner[1:])
    hashed = a[pair] * np.uint64(0x9E3779B97F4A7C15) + b[pair]
    hashed = ((hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    owner = owner[:-1][pair]
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    if len(owner):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])])
        owner, hashed = owner[new], hashed[new]
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed))


_RECORD = T.StructType([T.StructField(n, t) for n, t in (("side", T.StringType()), ("id", T.StringType()), ("number", T.IntegerType()), ("section", T.StringType()), ("body", T.ArrayType(T.LongType())), ("head", T.ArrayType(T.LongType())))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            both = [_body_and_head(*row) for row in zip(*[c.to_pylist() for c in part.columns[4:]])]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], _pair_sets([b for b, _ in both]), _pair_sets([h for _, h in both])], names=_RECORD.names)


def record_features(df: DataFrame, side: str, ident: str, native_text: str, other_text: str | None, native_title: str, other_title: str | None, number: str, section: str) -> DataFrame:
    """(side, id, number, section, body, head): hashed word pairs of the text and of the titles, by sound so that scripts agree.

    Titles of one word each give that word, and the first line of the text stands beside it.
    """
    text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    known = df.where(F.col(ident).isNotNull()).select(F.lit(side).alias("side"), F.col(ident).cast("string").alias("id"), F.col(number).cast("int").alias("number"), F.col(section).cast("string").alias("section"), *[text(c).alias(f"text{i}") for i, c in enumerate((native_text, other_text, native_title, other_title))])
    return known.mapInArrow(_features, _RECORD)


# Counters of the frequency sketch: its size does not grow with the data.
SKETCH_BUCKETS = 1 << 20


def _sketch(grams: DataFrame) -> np.ndarray:
    """How often grams (gram) of each hash bucket occur; gives the order from rare to common, which decides speed only, never the result."""
    counts = grams.groupBy(F.col("gram").bitwiseAND(F.lit(SKETCH_BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    sketch = np.zeros(SKETCH_BUCKETS, np.int32)
    sketch[counts["bucket"].to_numpy()] = np.minimum(counts["n"].to_numpy(), np.iinfo(np.int32).max)
    return sketch


def _prefix(sketch: np.ndarray, least: float, extra: int):
    """The first n - ceil(least n) + extra grams from rare to common, without those that occur once (they meet nothing)."""

    @once
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prefix(sets: pd.Series) -> pd.Series:
        out = []
        for grams in sets:
            n = sketch[grams & (SKETCH_BUCKETS - 1)]
            order = np.lexsort((grams, n))[: max(0, len(grams) - math.ceil(least * len(grams) - 1e-9) + extra)]
            out.append(grams[order][n[order] > 1])
        return pd.Series(out, dtype=object)

    return prefix


def overlapping(sets: DataFrame, other: DataFrame, least: float, extra: int = 3, both: bool = False) -> DataFrame:
    """Pairs (p, q, share, size) of sets (rid, grams) and other with |p and q| >= least * |p| where |p| < |q|, or they are equal in size and p < q.

    Prefix filter: let the grams of p stand from rare to common. All but ``extra`` - 1 of those that must be common
    are found among the first n - ceil(least n) + ``extra``, so a pair shares min(extra, ceil(least n)) of these. Pairs are counted on
    prefixes alone; whole sets are compared only for pairs that pass. No gram is dropped. ``both``: the inputs are
    the same frame. Hot grams are left to AQE's skew join; they come last in every prefix.
    """
    sets, other = sets.where("size(grams) > 0"), other.where("size(grams) > 0")
    grams = other.select(F.explode("grams").alias("gram"))
    prefix = _prefix(_sketch(grams if both else grams.unionAll(sets.select(F.explode("grams").alias("gram")))), least, extra)
    p = sets.select(F.col("rid").alias("p"), F.size("grams").alias("np"), F.explode(prefix("grams")).alias("gram"))
    q = other.select(F.col("rid").alias("q"), F.size("grams").alias("nq"), F.explode("grams").alias("gram"))
    pairs = (
        p.join(q, "gram")
        .where("np < nq or (np = nq and p < q)")
        .groupBy("p", "q", "np")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= F.least(F.lit(extra), F.ceil(F.col("np") * least - 1e-9)))
        .select("p", "q")
    )
    return (
        pairs.join(sets.select(F.col("rid").alias("p"), F.col("grams").alias("gp")), "p")
        .join(other.select(F.col("rid").alias("q"), F.col("grams").alias("gq")), "q")
        .select("p", "q", (F.size(F.array_intersect("gp", "gq")) / F.size("gp")).alias("share"), F.size("gp").alias("size"))
        .where(F.col("share") >= least - 1e-9)
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, class): the least rid of each node's connected component, by spreading least labels until none changes.

    Labels of labels are taken in every round, so rounds grow with the logarithm of a component's width.
    """
    both = cut_lineage(edges.select("p", "q").unionAll(edges.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct())
    labels = both.select(F.col("p").alias("rid")).distinct().withColumn("class", F.col("rid"))
    moved = not both.isEmpty()
    while moved:
        near = both.join(labels, F.col("q") == F.col("rid")).groupBy("p").agg(F.min("class").alias("least"))
        new = labels.join(near, F.col("rid") == F.col("p")).select("rid", F.least("class", "least").alias("class"), F.col("class").alias("old"))
        of = new.select(F.col("rid").alias("r"), F.col("class").alias("c"))
        new = new.join(of, F.col("class") == F.col("r"), "left").select("rid", F.least("class", F.coalesce("c", "class")).alias("class"), "old")
        new = cut_lineage(new)
        moved = not new.where("class < old").isEmpty()
        labels = new.select("rid", "class")
    return nodes.join(labels, "rid", "left").select("rid", F.coalesce("class", "rid").alias("class"))


def matching_marginals(pairs: DataFrame, tolerance: float = 1e-3, most_rounds: int = 500) -> DataFrame:
    """(a, b, weight, belief) of candidate pairs (a, b, weight = prior log odds) under one-to-one factors.

    Each a and each b has a factor that allows one of its pairs at most. A factor sends to a pair
    1 / (1 + sum of the odds that its other pairs bring from their other end); the belief of a pair is its
    odds times the two messages it gets. Sums are grouped by one end, with partial sums before the shuffle, and joined back to the
    pairs, so an end with very many pairs is no task of its own. Pairs that compete with none have their belief at once. The rounds go on
    until the largest change of a belief is under ``tolerance``; after ``most_rounds`` this raises.
    """
    odds = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("weight"))))
    degrees = [pairs.groupBy(end).agg(F.count("*").alias(f"n_{end}")) for end in ("a", "b")]
    start = cut_lineage(pairs.join(degrees[0], "a").join(degrees[1], "b").select("a", "b", "weight", odds.alias("odds"), (F.greatest("n_a", "n_b") > 1).alias("competes")))
    alone = start.where("not competes").select("a", "b", "weight", (F.col("odds") / (1 + F.col("odds"))).alias("belief"))
    state = start.where("competes").select("a", "b", "weight", "odds", F.lit(1.0).alias("from_b"), F.lit(0.0).alias("belief"))
    if state.isEmpty():
        return alone

    def message(frame: DataFrame, end: str, brought: str, name: str) -> DataFrame:
        totals = frame.groupBy(end).agg(F.sum(F.col("odds") * F.col(brought)).alias("total"))
        return frame.join(totals, end).withColumn(name, 1 / (1 + F.greatest(F.lit(0.0), F.col("total") - F.col("odds") * F.col(brought)))).drop("total")

    for _ in range(most_rounds):
        new = message(message(state.withColumnRenamed("belief", "old"), "a", "from_b", "from_a").drop("from_b"), "b", "from_a", "from_b")
        belief = F.col("odds") * F.col("from_a") * F.col("from_b")
        new = cut_lineage(new.select("a", "b", "weight", "odds", "from_b", (belief / (1 + belief)).alias("belief"), "old"))
        state = new.drop("old")
        if new.agg(F.max(F.abs(F.col("belief") - F.col("old")))).first()[0] < tolerance:
            return alone.unionByName(state.select("a", "b", "weight", "belief"))
    raise RuntimeError(f"no beliefs within {tolerance} after {most_rounds} rounds")


def matched_records(left: DataFrame, right: DataFrame, same: float = 0.55, head_share: float = 0.6, body_share: float = 0.45) -> DataFrame:
    """(id_a, id_b, confidence) of the records of ``left`` and ``right`` (``record_features``) that are of one entity, belief 0.5 or more.

    1. Records of a side with the same grams (without a body: also the same number and section) are one node.
    2. Candidates: bodies that share ``body_share`` of the smaller one's grams; where one of two records has no body,
       heads that share ``head_share`` of the smaller one's. The evidence of a smaller share is below even odds with
       equal numbers and sections too, so it could not be reported (16 (0.4575 - 0.52) + 1 = 0).
    3. Nodes of one side whose bodies share ``same`` are one entity (connected components), as are nodes without
       body whose head, number and section agree with another's. So doubles never compete.
    4. The evidence of a pair of entities is the best of their nodes' pairs: log odds linear in the share,
       raised by equal numbers and sections; ``matching_marginals`` makes beliefs of them. The weights are set, not fitted.
    5. Entities are expanded to records: several records of one entity give every combination.

    Null ids are left out; records without any text or title match nothing; empty input on a side: empty result.
    """
    records = left.unionByName(right)
    no_body = F.size("body") == 0
    sign = F.xxhash64("side", "body", "head", F.when(no_body, F.col("number")), F.when(no_body, F.col("section")))
    records = cut_lineage(records.where("size(body) > 0 or size(head) > 0").withColumn("rid", sign))
    nodes = records.groupBy("rid").agg(F.first("side").alias("side"), F.first("body").alias("body"), F.first("head").alias("head"), F.min("number").alias("number"), F.min("section").alias("section"))
    nodes = cut_lineage(nodes)
    # Heads of records with a body take part only where the other record has none.
    bodies = nodes.select("rid", F.col("body").alias("grams"))
    heads = nodes.select("rid", F.col("head").alias("grams"), (F.size("body") == 0).alias("bare"))
    by_body = overlapping(bodies, bodies, body_share, both=True).withColumn("kind", F.lit("body"))
    bare, dressed = heads.where("bare").select("rid", "grams"), heads.where("not bare").select("rid", "grams")
    by_head = overlapping(bare, heads.select("rid", "grams"), head_share).unionAll(overlapping(dressed, bare, head_share)).withColumn("kind", F.lit("head"))
    about = nodes.select("rid", "side", "number", "section")
    pairs = (
        by_body.unionAll(by_head)
        .join(about.select(F.col("rid").alias("p"), F.col("side").alias("p_side"), F.col("number").alias("p_number"), F.col("section").alias("p_section")), "p")
        .join(about.select(F.col("rid").alias("q"), F.col("side").alias("q_side"), F.col("number").alias("q_number"), F.col("section").alias("q_section")), "q")
    )
    same_number, same_section = F.col("p_number") == F.col("q_number"), F.col("p_section") == F.col("q_section")
    number = F.when(same_number, 1.0).when(F.col("p_number").isNull() | F.col("q_number").isNull(), 0.0).otherwise(-1.0)
    section = F.when(same_section, 0.5).when(F.col("p_section").isNull() | F.col("q_section").isNull(), 0.0).otherwise(-0.5)
    # A title of one word counts only where the number agrees too.
    weight = F.when(F.col("kind") == "body", 16 * (F.col("share") - 0.52) + 0.5 * number + section).otherwise(
        6 * (F.col("share") - 0.7) + 2 * number + section + F.when(F.col("size") >= 3, 1.0).when(F.col("size") == 2, 0.5).otherwise(-2.4)
    )
    pairs = cut_lineage(pairs.withColumn("weight", weight).withColumn("agree", same_number & same_section))
    doubles = pairs.where("p_side = q_side").where((F.col("kind") == "body") & (F.col("share") >= same) | (F.col("kind") == "head") & (F.col("share") > 0.99) & F.col("agree"))
    classes = cut_lineage(components(nodes.select("rid"), doubles))
    a_first = F.col("p_side") < F.col("q_side")
    across = pairs.where("p_side <> q_side").select(F.when(a_first, F.col("p")).otherwise(F.col("q")).alias("pa"), F.when(a_first, F.col("q")).otherwise(F.col("p")).alias("pb"), "weight")
    between = (
        across.join(classes.select(F.col("rid").alias("pa"), F.col("class").alias("a")), "pa")
        .join(classes.select(F.col("rid").alias("pb"), F.col("class").alias("b")), "pb")
        .groupBy("a", "b")
        .agg(F.max("weight").alias("weight"))
    )
    found = matching_marginals(between).where("belief >= 0.5")
    members = records.select("rid", "id").join(classes, "rid").select("class", "id").distinct()
    return (
        found.join(members.select(F.col("class").alias("a"), F.col("id").alias("id_a")), "a")
        .join(members.select(F.col("class").alias("b"), F.col("id").alias("id_b")), "b")
        .select("id_a", "id_b", F.col("belief").alias("confidence"))
    )
