"""Orders, rotations, recent lists, related items, playlists and weighted picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def with_position(df: DataFrame, order: list[Column], amount: Column | None = None) -> DataFrame:
    """Adds ``position`` (0, 1, ... in the global order) and, with ``amount``, ``total_before`` (the sum of it over earlier rows).

    No task sees more than a range of the rows: they are range-partitioned and sorted, each row gets its place within its
    partition, and the partitions' counts (one small row for each) are prefix-summed. ``order`` must be total for a defined result.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")
    if amount is not None:
        placed = placed.withColumn("__x", amount)
    placed = cut_lineage(placed)  # the ranges must not be drawn anew between the two passes
    sums = [F.count("*").alias("__n")] + ([F.sum("__x").alias("__s")] if amount is not None else [])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    offsets = placed.groupBy("__part").agg(*sums)
    offsets = offsets.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__on"), *([F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__os")] if amount is not None else []))
    joined = placed.join(F.broadcast(offsets), "__part").withColumn("position", F.col("__at") + F.col("__on"))
    if amount is not None:
        inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumn("total_before", F.col("__os") + F.coalesce(F.sum("__x").over(inside), F.lit(0)))
    return joined.drop("__part", "__at", "__on", "__os", "__x")


def enumerated_order(c: Column | str, order: list[str]) -> Column:
    """Place of a value in a given order; values outside it come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(c) if isinstance(c, str) else c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def name_order(c: str) -> Column:
    """Language-aware order of names (a A b B), not that of code points."""
    return F.collate(F.col(c), "UNICODE")


def page(df: DataFrame, order: list[Column], first: int = 120, step: int = 300, number: int = 0) -> DataFrame:
    """Page 0 has ``first`` rows, later pages ``step`` each."""
    start, size = (0, first) if number == 0 else (first + (number - 1) * step, step)
    return df.orderBy(*order).offset(start).limit(size)


def item_of_day(df: DataFrame, rank: str, day) -> DataFrame:
    """The item whose place in rank order is the day of the year modulo the number of ranked items. Places go over range partitions."""
    placed = with_position(df.where(F.col(rank).isNotNull()), [F.col(rank).asc()])
    n = max(1, placed.count())  # one number
    return placed.where(F.col("position") == F.pmod(F.dayofyear(F.lit(day).cast("date")), F.lit(n))).drop("position")


def latest_distinct(log: DataFrame, by: str, item: str, order: list[str], n: int) -> DataFrame:
    """(by, item, place): the n items last seen of each user, each once, latest first. Ties by the later columns of ``order``."""
    last = log.groupBy(by, item).agg(F.max(F.struct(*order)).alias("last"))
    w = Window.partitionBy(by).orderBy(F.col("last").desc())
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(by, item, "place")


def next_allowed(df: DataFrame, by: str, place: str, current: str, blocked: Column) -> DataFrame:
    """(by, place): of each list the first place after the current one that is not blocked."""
    return df.where((F.col(place) > F.col(current)) & ~blocked).groupBy(by).agg(F.min(place).alias(place))


def place_in_group(df: DataFrame, group: str, order: list[Column], amount: Column | None = None) -> DataFrame:
    """Adds ``place`` (0, 1, ... within the group in the given order) and, with ``amount``, ``before`` (the sum of it over the group's earlier rows).

    Global positions and sums less those of the group's first row: a group of any size is spread over range partitions. ``order`` must be total.
    """
    placed = cut_lineage(with_position(df, [F.col(group).asc(), *order], amount))
    first = placed.groupBy(group).agg(F.min("position").alias("__p"), *([F.min_by("total_before", "position").alias("__t")] if amount is not None else []))
    joined = placed.join(first, group).withColumn("place", F.col("position") - F.col("__p"))
    if amount is not None:
        joined = joined.withColumn("before", F.col("total_before") - F.col("__t")).drop("total_before", "__t")
    return joined.drop("position", "__p")


def take_while_total(df: DataFrame, by: str, order: str, size: Column, target: Column, share: float) -> DataFrame:
    """Rows in order while the total before is under share * target; the first row always. ``order`` must be total within ``by``."""
    placed = place_in_group(df, by, [F.col(order).asc()], F.coalesce(size, F.lit(0)))
    return placed.where((F.col("place") == 0) | (F.col("before") < target * share)).drop("place", "before")


def queue_order(place: Column, current: Column, rank: Column, title: str) -> list[Column]:
    """Current first, the one after it second, then by rank (unranked last) and title."""
    return [F.when(place == current, 0).when(place == current + 1, 1).otherwise(2).asc(), F.coalesce(rank, F.lit(9999)).asc(), name_order(title).asc()]


def recency_excluded(pool: DataFrame, recent: DataFrame, item: str, place: str, excluded: list, most: int = 40) -> DataFrame:
    """Pool without the last min(most, half the pool) plays and ``excluded``; if nothing is left only without
    ``excluded``; if still nothing, all."""
    kept_out = min(most, pool.count() // 2)  # one number
    played = recent.where(F.col(place) <= kept_out).select(item).distinct().withColumn("__r", F.lit(True))
    tiered = pool.join(played, item, "left").withColumn("tier", F.when(F.col(item).isin(*excluded) if excluded else F.lit(False), 3).when(F.col("__r"), 2).otherwise(1)).drop("__r")
    least = tiered.agg(F.min("tier")).first()[0]  # one number
    return (tiered if least in (None, 3) else tiered.where(F.col("tier") == least)).drop("tier")


def uniform(seed: int, *ident: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the row's key: the same for any partitioning, and in any other engine."""
    digits = F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ident])), F.lit(13))
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_key(ident: Column | list[Column], weight: Column, seed: int) -> Column:
    """Exponential clock -ln(u)/w of a row: the least key is a pick in proportion to weight (Efraimidis and Spirakis 2006)."""
    return -F.ln(uniform(seed, *(ident if isinstance(ident, list) else [ident]))) / weight


def weighted_pick(df: DataFrame, ident: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows without replacement with probability in proportion to weight; weights of 0 or less never."""
    return df.where(weight > 0).withColumn("__k", weighted_key(F.col(ident), weight, seed)).orderBy("__k", ident).limit(n).drop("__k")


def picked_per_key(df: DataFrame, key: str, ident: str, weight: Column, seed: int, preferred: Column | None = None) -> DataFrame:
    """One row for each key, picked in proportion to weight among its ``preferred`` rows, or among all where it has none of those."""
    clock = weighted_key([F.col(key), F.col(ident)], weight, seed)
    first = F.when(preferred, 0).otherwise(1) if preferred is not None else F.lit(0)
    best = F.min_by(F.struct(*df.columns), F.struct(first, clock, F.col(ident)))  # a mergeable aggregate: no group is gathered
    return df.where(weight > 0).groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*")


def length_batches(df: DataFrame, ident: str, text: str, size: int = 32) -> DataFrame:
    """Adds ``batch``: rows in order of text length, ``size`` to a batch, so that texts of one batch are about as long. Null texts count as empty."""
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    return with_position(df, [length.asc(), F.col(ident).asc()]).withColumn("batch", F.floor(F.col("position") / size)).drop("position")


def related(items: DataFrame, ident: str, order: str, moods: str, mode: str, category: str, sub: str, season: str, beat: str, playable: Column, popular: Column, n: int = 10, least: float = 4.0) -> DataFrame:
    """(item, other, score, place): the n most related items of each.

    3 for each shared mood, 3 for the mode, 2 for category with sub (else 1 for the category), 2 season, 0.5 beat; at
    least ``least`` of it; then 1.5 if playable, 0.5 if popular. Ties by the catalogue's order.

    Every set of features that an item has and that is worth ``least`` is a key (``_shared_sets``): of the items with a key only the first n + 1 by
    bonus and order can be wanted, since those share as much or more with whoever asks by it. An item meets only the heads of its own keys, and of
    these only keys that can still better the (n + 1)th score which a full key assures it. So work grows with the items, not with pairs of
    them; the keys of an item double with each of its moods.
    """
    top = n + 1
    f = items.select(F.col(ident).alias("i"), F.col(order).alias("o"), F.array_distinct(F.filter(F.coalesce(F.col(moods), F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("m"), *[F.nullif(F.col(c), F.lit("")).alias(a) for c, a in ((mode, "md"), (category, "ca"), (sub, "su"), (season, "se"), (beat, "be"))], (F.when(playable, 1.5).otherwise(0.0) + F.when(popular, 0.5).otherwise(0.0)).alias("bonus"))
    f = cut_lineage(f.withColumn("e", F.monotonically_increasing_id()))  # a short name for each item; cut, as it must stay the same
    met = f.select("e", "o", "bonus", F.explode(_shared_sets(least)).alias("s")).select("e", "o", "bonus", "s.key", "s.worth")
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("bonus").desc(), "o", "e"))).where(F.col("r") <= top)
    heads = cut_lineage(ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "e", "o", "bonus"))).alias("l")))  # n + 1 entries at most
    reach = heads.where(F.size("l") > 1).select("key", F.col("l")[0]["bonus"].alias("first"), F.get("l", F.lit(top - 1))["bonus"].alias("last"))
    sure = F.max(F.col("worth") + F.col("last")).over(Window.partitionBy("e"))
    asked = met.select("e", "key", "worth").join(reach, "key").withColumn("sure", sure).where(F.col("sure").isNull() | (F.col("worth") + F.col("first") >= F.col("sure"))).select("e", "key", "worth")
    pairs = asked.join(heads, "key").select("e", "worth", F.explode("l").alias("h")).where("h.e <> e").select("e", F.col("h.e").alias("q"), F.col("h.o").alias("o2"), (F.col("worth") + F.col("h.bonus")).alias("score"))
    scored = pairs.repartition("e").groupBy("e", "q", "o2").agg(F.max("score").alias("score"))  # the largest set that both have counts
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("e").orderBy(F.col("score").desc(), "o2", "q"))).where(F.col("place") <= n)
    named = best.join(f.select("e", F.col("i").alias("item")), "e").join(f.select(F.col("e").alias("q"), F.col("i").alias("other")), "q")
    return named.select("item", "other", "score", "place")


def _shared_sets(least: float) -> Column:
    """(key, worth) of every set of a row's features m (moods), md, ca, su, se and be that is worth ``least`` or more, as ``related`` counts them; nulls are in none."""
    sets = F.aggregate(
        F.array_sort("m"),
        F.array(F.struct(F.xxhash64(F.lit("")).alias("key"), F.lit(0.0).alias("worth"))),
        lambda sets, mood: F.concat(sets, F.transform(sets, lambda s: F.struct(F.xxhash64(s["key"], F.lit("m"), mood).alias("key"), (s["worth"] + 3.0).alias("worth")))),
    )
    none = F.array().cast("array<struct<key:bigint,worth:double>>")

    def grown(sets: Column, *choices: tuple[list[str], float]) -> Column:
        def with_it(sets: Column, columns: list[str], worth: float) -> Column:
            known = F.lit(True)
            for c in columns:
                known = known & F.col(c).isNotNull()
            return F.when(known, F.transform(sets, lambda s: F.struct(F.xxhash64(s["key"], *[x for c in columns for x in (F.lit(c), F.col(c))]).alias("key"), (s["worth"] + worth).alias("worth")))).otherwise(none)

        # A list of one, so that the sets so far are worked out once and not for each use.
        return F.flatten(F.transform(F.array(sets), lambda v: F.concat(v, *[with_it(v, columns, worth) for columns, worth in choices])))

    sets = grown(sets, (["md"], 3.0))
    sets = grown(sets, (["ca"], 1.0), (["ca", "su"], 2.0))
    sets = grown(sets, (["se"], 2.0))
    return F.filter(grown(sets, (["be"], 0.5)), lambda s: s["worth"] >= least)


def mood_fit(moods: Column, weights: dict[str, float]) -> Column:
    """Weights of a row's moods summed, the first mood in full, later ones three quarters."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    terms = F.transform(F.coalesce(moods, F.array().cast("array<string>")), lambda m, i: F.coalesce(F.try_element_at(known, m), F.lit(0.0)) * F.when(i == 0, 1.0).otherwise(0.75))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def playlist(songs: DataFrame, weights: dict[str, float], wanted_season: str | None, n: int, never: DataFrame | None = None, liked: DataFrame | None = None, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Best-fitting playable songs: 2 * fit + 1 in season + 0.6 liked + 0.4 (1 - pop / 400) + jitter * u, with what made each fit.

    Songs without fit and out of season are left out, as are those in ``never``. ``songs`` needs id, ord, moods, season, pop and
    a boolean playable. n is clamped to 1..50. Ties by ord.
    """
    rows = songs.where("playable")
    if never is not None:
        rows = rows.join(never, "id", "left_anti")
    rows = rows.join(liked.select("id", F.lit(True).alias("liked")).distinct(), "id", "left") if liked is not None else rows.withColumn("liked", F.lit(False))
    in_season = F.coalesce(F.col("season") == F.lit(wanted_season), F.lit(False))
    fit = mood_fit(F.col("moods"), weights)
    u = uniform(seed, F.col("id"))
    score = 2 * F.col("fit") + F.when(F.col("in_season"), 1.0).otherwise(0.0) + F.when(F.col("liked"), 0.6).otherwise(0.0) + F.when(F.col("pop") > 0, 0.4 * (1 - F.col("pop") / 400)).otherwise(0.0) + jitter * u
    why = F.concat(F.filter(F.coalesce("moods", F.array().cast("array<string>")), lambda m: m.isin(*[k for k, v in weights.items() if v])), F.when(F.col("in_season"), F.array("season")).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("fit", fit).withColumn("in_season", in_season).where((F.col("fit") > 0) | F.col("in_season")).withColumn("score", score).withColumn("why", why).orderBy(F.col("score").desc(), "ord").limit(max(1, min(50, n)))
