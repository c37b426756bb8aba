import random

from sargam.llm.topn import top_n_per_group

SCHEMA = "song string, video string, views bigint, grp string, item string, pos int, n_rows int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def brute(rows, n):
    best = {}
    for song, video, views in rows:
        if None not in (song, video, views):
            best[song, video] = max(views, best.get((song, video), views))
    out = set()
    for song in {s for s, _ in best}:
        ranked = sorted(((-v, i) for (s, i), v in best.items() if s == song))[:n]
        out |= {(song, i, -v, k + 1) for k, (v, i) in enumerate(ranked)}
    return out


def got(df, n):
    return {tuple(r) for r in top_n_per_group(df, "song", "video", "views", n).collect()}


def test_against_brute_force_with_hot_group_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        song = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", "ঝ", None, *map(str, range(300))])
        rows.append((song, rng.choice([None, *(f"v{k}" for k in range(400))]), rng.choice([None, 0, 5, 5, 5, rng.randrange(50)])))
    df = frame(spark, rows).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 3, 10):
            assert got(df, n) == brute(rows, n)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_group_of_one_score_and_repeated_rows(spark):
    rows = [("s", f"v{k:04d}", 7) for k in range(500)] * 2
    assert got(frame(spark, rows), 3) == {("s", f"v000{k}", 7, k + 1) for k in range(3)}


def test_empty_table_and_few_items(spark):
    assert got(frame(spark, []), 3) == set()
    assert got(frame(spark, [("s", "v", 1), (None, "v", 1), ("s", None, 1), ("t", "v", None)]), 3) == {("s", "v", 1, 1)}


def test_repeated_items_can_count_each(spark):
    df = frame(spark, [("s", "v", 2), ("s", "v", 2), ("s", "w", 1)])
    top = top_n_per_group(df, "song", "video", "views", 2, distinct_items=False).collect()
    assert sorted((r["item"], r["position"]) for r in top) == [("v", 1), ("v", 2)]


def test_equal_rows_are_counted_not_gathered(spark):
    df = spark.range(50_000).selectExpr("'a' as song", "'v' as video", "5 as views").unionAll(spark.createDataFrame([("a", "w", 9), ("b", "x", 1), ("b", "x", 1)], "song string, video string, views int"))
    found = sorted(tuple(r) for r in top_n_per_group(df, "song", "video", "views", 3, distinct_items=False).collect())
    assert found == [("a", "v", 5, 2), ("a", "v", 5, 3), ("a", "w", 9, 1), ("b", "x", 1, 1), ("b", "x", 1, 2)]
