"""Multi-valued attributes, faceted predicates, leave-one-out counts and browse groups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def values_of(df: DataFrame, column: str, separator: str | None = None) -> Column:
    """Attribute as an array: arrays as they are, joined strings split, scalars of 0 or 1 values; nulls and '' out."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "array":
        return F.filter(F.coalesce(c, F.array().cast(df.schema[column].dataType)), lambda x: x.isNotNull())
    text = c.cast("string")
    if separator:
        return F.filter(F.coalesce(F.split(text, separator), F.array().cast("array<string>")), lambda x: x != "")
    return F.filter(F.array(text), lambda x: x.isNotNull() & (x != ""))


@dataclass(frozen=True)
class Facet:
    """name: what counts call it; values: array<string> column of a row's values."""

    name: str
    values: Column


@dataclass(frozen=True)
class FacetState:
    """Chosen values by facet; values of a facet are alternatives, facets go together, no value means no condition."""

    chosen: dict[str, list[str]] = field(default_factory=dict)

    def only(self, name: str, value: str) -> FacetState:
        return FacetState({name: [value]})

    def with_value(self, name: str, values: list[str]) -> FacetState:
        return replace(self, chosen=self.chosen | {name: values})

    def active(self) -> list[tuple[str, str]]:
        return [(n, v) for n, vs in self.chosen.items() for v in vs]


def facet_predicate(facets: list[Facet], state: FacetState, leave_out: str | None = None) -> Column:
    terms = [F.arrays_overlap(f.values, F.array(*[F.lit(v) for v in state.chosen[f.name]])) for f in facets if f.name != leave_out and state.chosen.get(f.name)]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def active_filters(saved: DataFrame, by: str, names: list[str]) -> DataFrame:
    """(by, facet, value): a row for each filter that is set in saved choices: the values of arrays, scalars that are not empty, flags that are true."""
    def entries(name: str) -> Column:
        kind = saved.schema[name].dataType.typeName()
        values = F.when(F.col(name), F.array(F.lit("true"))).otherwise(F.array().cast("array<string>")) if kind == "boolean" else values_of(saved, name)
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    return saved.select(by, F.explode(F.flatten(F.array(*map(entries, names)))).alias("e")).select(by, "e.facet", "e.value")


def for_listener(df: DataFrame, ident: str, never: DataFrame | None = None, liked: DataFrame | None = None) -> DataFrame:
    """Rows that a listener wants at all: none of ``never``, and of ``liked`` only, where it is given; both have the column ``ident``."""
    if never is not None:
        df = df.join(never.select(ident), ident, "left_anti")
    return df if liked is None else df.join(liked.select(ident), ident, "left_semi")


def facet_pool(df: DataFrame, facets: list[Facet], state: FacetState, base: Column | None = None) -> DataFrame:
    """Rows that meet the base condition and every facet; predicates on scalar columns reach the scan."""
    return df.where((base if base is not None else F.lit(True)) & facet_predicate(facets, state))


def facet_counts(df: DataFrame, facets: list[Facet], state: FacetState, base: Column | None = None) -> DataFrame:
    """(facet, value, n): pool size if the facet's choice were replaced by this value alone, zero included.

    One pass: each row yields its values of the facets whose other facets it meets; the options are all values on
    rows that meet the base condition.
    """
    rows = df.where(base) if base is not None else df

    def entry(f: Facet):
        hit = facet_predicate(facets, state, f.name).cast("int")
        return F.transform(F.array_distinct(f.values), lambda v: F.struct(F.lit(f.name).alias("facet"), v.alias("value"), hit.alias("hit")))

    entries = F.flatten(F.array(*[entry(f) for f in facets]))
    return rows.select(F.explode(entries).alias("e")).groupBy("e.facet", "e.value").agg(F.sum("e.hit").alias("n")).select("facet", "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def browse_groups(df: DataFrame, values: Column, playable: Column) -> DataFrame:
    """(value, n, rec, share): rows of each attribute value, how many are playable, and that in per cent (halves up)."""
    return (
        df.select(F.explode(F.array_distinct(values)).alias("value"), playable.cast("int").alias("p"))
        .groupBy("value")
        .agg(F.count("*").alias("n"), F.sum("p").alias("rec"))
        .withColumn("share", F.floor(100 * F.col("rec") / F.col("n") + 0.5))
    )


def name_options(counts: DataFrame, matches: Column, selected: str | None, limit: int) -> DataFrame:
    """Option list: values with a count or selected, the selected one always first, then bucket, value; ``limit`` of them."""
    chosen = F.col("value") == F.lit(selected) if selected is not None else F.lit(False)
    return counts.withColumn("bucket", matches).where(((F.col("n") > 0) & F.col("bucket").isNotNull()) | chosen).withColumn("selected", chosen).orderBy(F.col("selected").desc(), "bucket", "value").limit(limit)
