"""Exact top N of every group from one global range-partitioned sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def best_score_per_item(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row per (group, item) with its largest score; rows with a null in any of the three are left out."""
    return (
        df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(score).alias("score"))
        .where("grp is not null and item is not null and score is not null")
        .groupBy("grp", "item")
        .agg(F.max("score").alias("score"))
    )


def _local_positions(n: int):
    """Positions inside one sorted partition, as a stream: holds one batch and one running count.

    Emits the rows whose position inside the partition is at most n and, at the partition's end, one
    row with the row count of the last group, the only group that can go on in a later partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("grp")
            size = batch.num_rows
            schema = batch.schema
            index = pa.array(range(size), pa.int64())
            if size > 1:
                changed = pa.concat_arrays([pa.array([True]), pc.not_equal(group.slice(1), group.slice(0, size - 1))])
            else:
                changed = pa.array([True])
            start = pc.fill_null_forward(pc.if_else(changed, index, pa.scalar(None, pa.int64())))
            position = pc.add(pc.subtract(index, start), 1)
            if last is not None and group[0].as_py() == last:
                position = pc.if_else(pc.equal(start, 0), pc.add(position, seen), position)
            last, seen = group[-1].as_py(), position[-1].as_py()
            keep = pc.less_equal(position, n)
            kept = batch.append_column("pos", position).filter(keep)
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * kept.num_rows, pa.int32()), kept.column("grp"), kept.column("score"), kept.column("item"), kept.column("pos"), pa.nulls(kept.num_rows, pa.int64())],
                    names=["part", "grp", "score", "item", "pos", "n_rows"],
                )
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([last], schema.field("grp").type), pa.nulls(1, schema.field("score").type), pa.nulls(1, schema.field("item").type), pa.nulls(1, pa.int64()), pa.array([seen], pa.int64())],
                names=["part", "grp", "score", "item", "pos", "n_rows"],
            )

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, distinct_items: bool = True) -> DataFrame:
    """The first ``n`` items of every group by score descending, then item ascending (binary order).

    Columns: grp, item, score, position (1..n, exact over the whole group).

    The rows are range-partitioned on (group, score, item), so a group of any size is spread over as
    many tasks as its rows need and no task holds a whole group. Within a partition positions are
    counted in a stream; a partition adds one count row for its last group, and the counts of earlier
    partitions are prefix-summed into exact positions. Only rows within the first n of a partition
    leave it: at most n rows for each group and partition.

    Nulls in group, item or score: the row does not count. Repeated (group, item) rows: their largest
    score, unless ``distinct_items`` is false. Ties: item ascending, repeated equal rows are
    interchangeable. A group with fewer than n items gives all. Empty input: empty result. Other
    columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if distinct_items:
        rows = best_score_per_item(df, group, item, score).select("grp", "score", "item")
    else:
        rows = df.select(F.col(group).alias("grp"), F.col(score).alias("score"), F.col(item).alias("item")).where("grp is not null and item is not null and score is not null")
        # Rows equal in all three have one place in the order, which no range can split: they are counted, and n of them are enough.
        counted = rows.groupBy("grp", "score", "item").agg(F.least(F.count("*"), F.lit(n)).alias("copies"))
        rows = counted.select("grp", "score", "item", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    order = [F.col("grp").asc(), F.col("score").desc(), F.col("item").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType(
        [T.StructField("part", T.IntegerType())]
        + [rows.schema[c] for c in ("grp", "score", "item")]
        + [T.StructField("pos", T.LongType()), T.StructField("n_rows", T.LongType())]
    )
    for field in schema:
        field.nullable = True
    local = ranged.mapInArrow(_local_positions(n), schema)
    before = Window.partitionBy("grp").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    return (
        local.withColumn("position", F.col("pos") + F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        .where(F.col("position") <= n)
        .select("grp", "item", "score", "position")
    )
