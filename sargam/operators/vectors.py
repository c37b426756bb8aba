"""Dense vectors: normalising, quantising, products, nearest entries within a margin."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import BROADCAST_LIMIT_BYTES, cut_lineage
from .ranking import with_position


def _double(c: Column | str) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of vectors of one length."""
    total = F.aggregate(F.slice(vectors, 2, 1 << 20), _double(vectors[0]), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def centroids(df: DataFrame, group: str, vector: str, name: str) -> DataFrame:
    """(group, name): mean vector of each group, averaged place by place, so a group of any size is combined before the shuffle."""
    places = df.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(name))


def normalised(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = F.sqrt(dot(v, v))
    return F.transform(_double(v), lambda x: F.when(length > 0, x / length).otherwise(x))


def quantised(v: Column | str, scale: float = 127.0) -> Column:
    """Bytes round(x * scale), halves to even, within -127..127."""
    return F.transform(_double(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x * scale).cast("int"))).cast("byte"))


def dequantised(v: Column | str, scale: float = 127.0) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double") / scale)


def similarities(queries: DataFrame, ident: str, vector: str, entries: DataFrame, name: str, entry_vector: str, block_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(ident, name, sim) of every query with every entry of a stated set of vectors.

    Products are matrix products of an Arrow batch with a block of entries; a block holds as many entries as ``block_bytes`` allow
    (counted), and goes to the tasks. More entries make more blocks, each a pass over the queries. Null vectors are left out.
    """
    entries = entries.where(F.col(entry_vector).isNotNull()).select(name, _double(entry_vector).alias("v"))
    n, width = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    per_block = max(1, block_bytes // (8 * (width or 1)))
    schema = T.StructType([queries.schema[ident], entries.schema[name], T.StructField("sim", T.DoubleType())])
    asked = queries.where(F.col(vector).isNotNull()).select(ident, vector)
    if n <= per_block:
        return _products(asked, entries, schema)
    placed = cut_lineage(with_position(entries, [F.col(name).asc()]))
    blocks = [_products(asked, placed.where(F.col("position").between(at, at + per_block - 1)).select(name, "v"), schema) for at in range(0, n, per_block)]
    return reduce(DataFrame.unionAll, blocks)


def _products(queries: DataFrame, block: DataFrame, schema: T.StructType) -> DataFrame:
    rows = block.collect()  # one block, bounded by the caller
    names, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    name_type = to_arrow_type(schema[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            flat = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            sims = flat @ matrix.T
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names * batch.num_rows, name_type), pa.array(sims.ravel())], names=schema.names)

    return queries.mapInArrow(run, schema)


def within_margin(sims: DataFrame, ident: str, name: str, margin: float = 0.015, top: int = 3, loss: float = 0.3) -> DataFrame:
    """(ident, name, weight, place): entries within ``margin`` of the best, ``top`` of them, weight falling by ``loss`` over the margin."""
    w = Window.partitionBy(ident)
    return (
        sims.withColumn("best", F.max("sim").over(w))
        .where(F.col("sim") >= F.col("best") - margin)
        .withColumn("place", F.row_number().over(w.orderBy(F.col("sim").desc(), name)))
        .where(F.col("place") <= top)
        .select(ident, name, (1 - (F.col("best") - F.col("sim")) / margin * loss).alias("weight"), "place")
    )


def evaluation(moods: DataFrame, texts: DataFrame, ident: str, entry: str, margin: float, top_moods: int = 3, top_texts: int = 4) -> DataFrame:
    """(ident, kind, entry, sim, place, picked): of each question's (ident, entry, sim) the ``top_moods`` moods and those within ``margin`` of the best, and its ``top_texts`` texts."""
    w = Window.partitionBy(ident)
    placed = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumn("place", F.row_number().over(w.orderBy(F.col("sim").desc(), entry)).cast("bigint"))
    near = placed(moods, "mood").withColumn("picked", F.col("sim") >= F.max("sim").over(w) - margin).where((F.col("place") <= top_moods) | F.col("picked"))
    both = near.unionByName(placed(texts, "text").where(F.col("place") <= top_texts).withColumn("picked", F.lit(False)))
    return both.select(ident, "kind", entry, F.round("sim", 6).alias("sim"), "place", "picked")
