"""Linking two catalogues of the same items: key matches with checks, greedy one-to-one assignment, clusters, resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.similarity import best_openings, block_overlap, block_overlap_udf, near_openings, opening_udf
from ..session import cut_lineage
from .ranking import with_position

# Least title similarity of a number match (windowed), of a second claim, of a fuzzy match, of opening lines, and of twins.
NUMBER_MIN, NUMBER_WINDOW_MIN, CLAIM_MIN, FUZZY_MIN, LINE_MIN, RELINK_MIN, TWIN_MIN = 0.5, 0.8, 0.9, 0.8, 0.75, 0.85, 0.95
LINE_LETTERS = 30


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order, as a later entry of a map replaces an earlier one."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")


def verified_number_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_ord, b_ord, sim, verdict) of a (ord, section, number, latin) and b (ord, section, number, native).

    Equal section and number propose a match; it is kept where the titles' openings agree by ``NUMBER_MIN``, or anywhere by
    ``NUMBER_WINDOW_MIN``. Similarity is worked out for the joined pairs only. Unmatched a rows are kept with a null b_ord.
    """
    j = a.alias("a").join(last_per_key(b, ["section", "number"], "ord").alias("b"), F.expr("a.section = b.section and a.number = b.number"), "left")
    bn, en = X.skeleton_native(F.col("b.native"), "pipeline"), X.skeleton_latin(F.col("a.latin"))
    s = j.select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), bn.alias("bn"), en.alias("en")).withColumn("sim", F.when(F.col("b_ord").isNotNull(), opening_udf()("bn", "en")))
    s = s.withColumn("windowed", F.when(F.col("b_ord").isNotNull() & (F.col("sim") < NUMBER_MIN), opening_udf(window=True)("bn", "en")))
    verdict = F.when(F.col("b_ord").isNull(), "none").when((F.col("sim") >= NUMBER_MIN) | (F.coalesce("windowed", F.lit(0.0)) >= NUMBER_WINDOW_MIN), "match").otherwise("reject")
    return s.select("a_ord", "b_ord", F.coalesce(F.greatest("sim", "windowed"), F.lit(0.0)).alias("sim"), verdict.alias("verdict"))


def resolved_claims(matches: DataFrame) -> DataFrame:
    """Of several a rows with one b row the most similar keeps it (the first of equals), others only from ``CLAIM_MIN`` on."""
    w = Window.partitionBy("b_ord").orderBy(F.col("sim").desc(), "a_ord")
    return matches.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) | (F.col("sim") >= CLAIM_MIN)).drop("__r")


def _common_least(n: int, least: float) -> int:
    """Least number of common letters that two texts of n letters need for a ratio of ``least``, reckoned as the scorer does."""
    return next(m for m in range(n + 1) if 2.0 * m / (2 * n) >= least or m == n)


def near_pairs(a: DataFrame, b: DataFrame, need: dict[int, int], letters: int) -> DataFrame:
    """(a_ord, b_ord, x, y) of rows (ord, skeleton) whose first n letters, n the shorter length and ``letters`` at most, have need[n] common ones in order.

    Every pair is tried, in cells of rows of both sides (``near_openings``): some hundred thousand rows of one side and as many of the other as
    make half a billion pairs, so that neither a task nor its memory grows with the tables. The shorter text of a pair asks.
    """
    a, b = (cut_lineage(df.where(F.length("skeleton") >= min(need)).select("ord", F.left("skeleton", F.lit(letters)).alias("t"))) for df in (a, b))
    sizes = a.count(), b.count()  # two numbers

    def one_way(asked: DataFrame, others: DataFrame, n: int, m: int, names: tuple[str, str], longer: bool) -> DataFrame:
        blocks = max(1, -(-m // 200_000))
        parts = max(1, -(-n * m // (500_000_000 * blocks)))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        none = lambda side: F.lit(None).cast(side.schema["ord"].dataType)
        one = asked.select(F.pmod(F.hash("ord"), F.lit(parts)).alias("part"), every(blocks).alias("block"), F.col("ord").alias("p"), none(others).alias("q"), "t")
        two = others.select(every(parts).alias("part"), F.pmod(F.hash("ord"), F.lit(blocks)).alias("block"), none(asked).alias("p"), F.col("ord").alias("q"), "t")
        cells = one.unionByName(two).repartition(4 * parts * blocks, "part", "block")  # the time of a cell does not show in its size

        def tried(cell: pa.Table) -> pa.Table:
            first, second = cell.filter(pc.is_valid(cell["p"])), cell.filter(pc.is_valid(cell["q"]))
            i, j = near_openings(first["t"].to_pylist(), second["t"].to_pylist(), need, letters, longer)
            first, second = first.take(pa.array(i)), second.take(pa.array(j))
            return pa.table({"p": first["p"], "q": second["q"], "x": first["t"], "y": second["t"]})

        kinds = (("p", asked.schema["ord"].dataType), ("q", others.schema["ord"].dataType), ("x", T.StringType()), ("y", T.StringType()))
        found = cells.groupBy("part", "block").applyInArrow(tried, T.StructType([T.StructField(*k) for k in kinds]))
        texts = ("x", "y") if names[0] == "a_ord" else ("y", "x")
        return found.select(F.col("p").alias(names[0]), F.col("q").alias(names[1]), F.col("x").alias(texts[0]), F.col("y").alias(texts[1]))

    return one_way(a, b, *sizes, ("a_ord", "b_ord"), False).unionByName(one_way(b, a, *sizes[::-1], ("b_ord", "a_ord"), True))


def fuzzy_candidates(a: DataFrame, b: DataFrame, least: float = FUZZY_MIN, least_letters: int = 5, most: int = 12) -> DataFrame:
    """(a_ord, b_ord, sim) of rows (ord, skeleton) whose first letters agree by ``least``; none is missed.

    The compared length n is the shorter one, ``most`` at most, and a ratio of ``least`` needs so many common letters in order (``near_pairs``).
    """
    pairs = near_pairs(a, b, {n: _common_least(n, least) for n in range(least_letters, most + 1)}, most)
    return pairs.withColumn("sim", opening_udf(least=least_letters, most=most)("y", "x")).where(F.col("sim") >= least).select("a_ord", "b_ord", "sim")


def greedy_assignment(candidates: DataFrame, rounds: int = 6) -> DataFrame:
    """(a_ord, b_ord, sim): each a in order takes the free b most similar to it, the first of equals (by a column place, if any, before b_ord).

    All b prefer the lowest a, so the serial rule equals deferred acceptance (Gale and Shapley 1962): every a proposes to the best b
    left to it, and since a b never turns to a later a, all pairs of it with an a after its lowest proposer go. Rounds are grouped joins; the state is cut each round.
    Where many a want the same b in the same order, one of them is settled a round, however many rounds there are: what is open
    after ``rounds`` goes through one task in order, which keeps the numbers of the b that are taken and nothing else.
    """
    left = cut_lineage(candidates.select("a_ord", "b_ord", "sim", (F.col("place") if "place" in candidates.columns else F.lit(0)).alias("place")))
    best = [F.col("sim").desc(), F.col("place").asc(), F.col("b_ord").asc()]
    n = left.count()
    for _ in range(rounds):
        proposal = left.withColumn("__r", F.row_number().over(Window.partitionBy("a_ord").orderBy(*best))).where("__r = 1").drop("__r")
        kept = proposal.groupBy("b_ord").agg(F.min("a_ord").alias("keeper"))
        left = cut_lineage(left.join(kept, "b_ord", "left").where("keeper is null or a_ord <= keeper").drop("keeper"))
        before, n = n, left.count()
        if n == before:  # none was refused
            return proposal.drop("place")

    def serial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, last = set(), None
        for batch in batches:
            chosen = []
            for k, (a, b) in enumerate(zip(batch["a_ord"].to_pylist(), batch["b_ord"].to_pylist())):
                if a != last and b not in taken:
                    taken.add(b)
                    last = a
                    chosen.append(k)
            yield batch.take(pa.array(chosen, pa.int64())).select(["a_ord", "b_ord", "sim"])

    ordered = left.repartition(1).sortWithinPartitions(F.col("a_ord").asc(), *best)
    return ordered.mapInArrow(serial, left.select("a_ord", "b_ord", "sim").schema)


def line_skeletons(native: Column | str, latin: Column | str) -> tuple[Column, Column]:
    """The first 30 skeleton letters of the opening two lines of native and of romanised text, without sounds that only one of them writes."""
    def two_lines(c: Column | str) -> Column:
        return F.array_join(F.slice(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "\n"), 1, 2), " ")

    silent = two_lines(native)
    for a, b in (("্য", ""), ("্ব", ""), ("ঙ্গ", "ঙ")):
        silent = F.replace(silent, F.lit(a), F.lit(b))
    latin = F.regexp_replace(two_lines(F.trim(F.col(latin) if isinstance(latin, str) else latin, F.lit(" \n\r\t"))), "(?i)w", "")
    return F.left(X.skeleton_native(silent, "pipeline"), F.lit(LINE_LETTERS)), F.left(X.skeleton_latin(latin), F.lit(LINE_LETTERS))


def line_candidates(a: DataFrame, b: DataFrame, least: float = RELINK_MIN, least_letters: int = 6) -> DataFrame:
    """(a_ord, b_ord, sim) of rows (ord, skeleton) of ``line_skeletons`` with a block overlap of ``least``; none is missed.

    Of n compared letters least n stand in common blocks, so as many are common in order (``near_pairs``).
    """
    need = {n: next(m for m in range(n + 1) if m / n >= least) for n in range(least_letters, LINE_LETTERS + 1)}
    pairs = near_pairs(a, b, need, LINE_LETTERS)
    return pairs.withColumn("sim", block_overlap_udf("y", "x")).where(F.col("sim") >= least).select("a_ord", "b_ord", "sim")


def checked_links(links: DataFrame, compat: bool = False) -> DataFrame:
    """Adds line_sim and doubtful to links with native and translit texts: opening lines that agree by less than ``LINE_MIN``.

    Links without a comparable text are not doubtful. With ``compat`` a similarity of exactly 0 counts as none.
    """
    scored = links.withColumn("line_sim", block_overlap_udf(*line_skeletons("native", "translit")))
    sim = F.when(F.col("line_sim") == 0, 1.0).otherwise(F.coalesce("line_sim", F.lit(1.0))) if compat else F.coalesce("line_sim", F.lit(1.0))
    return scored.withColumn("doubtful", sim < LINE_MIN)


def relinked(held: DataFrame, lines_a: DataFrame, lines_b: DataFrame) -> DataFrame:
    """(a_ord, b_ord, sim, decision, freed) for each link (a_ord, b_ord) whose opening lines agree by less than ``LINE_MIN``.

    In the order of a, such an a turns to the b whose lines (ord, skeleton) agree best with its own, from ``RELINK_MIN`` on, the first of
    equals: it takes it if no a holds it, swaps with its first holder where that one's own lines agree by less than ``LINE_MIN``, and
    else gives its link up, as where there is no such b. decision is relinked, swapped or none; freed is the b it gave up.
    What an a does depends on those before it, so one task goes through the doubtful links; it gets their letters, no texts.
    """
    x, y = lines_a.select(F.col("ord").alias("a_ord"), F.col("skeleton").alias("x")), lines_b.select(F.col("ord").alias("b_ord"), F.col("skeleton").alias("y"))
    scored = held.select("a_ord", "b_ord").join(x, "a_ord").join(y, "b_ord").withColumn("now", block_overlap_udf("y", "x"))
    doubtful = cut_lineage(scored.where(F.col("now") < LINE_MIN).select("a_ord", "b_ord", "x", "y"))
    found = line_candidates(doubtful.select(F.col("a_ord").alias("ord"), F.col("x").alias("skeleton")), lines_b)
    best = found.groupBy("a_ord").agg(F.max_by("b_ord", F.struct("sim", -F.col("b_ord"))).alias("best")).join(y.select(F.col("b_ord").alias("best"), F.col("y").alias("best_y")), "best")
    steady = held.join(doubtful.select("a_ord"), "a_ord", "left_anti").groupBy(F.col("b_ord").alias("best")).agg(F.min("a_ord").alias("holder"))
    work = doubtful.join(best, "a_ord", "left").join(steady, "best", "left").select(F.col("a_ord").cast("bigint"), F.col("b_ord").cast("bigint"), "x", "y", F.col("best").cast("bigint"), "best_y", F.col("holder").cast("bigint"))

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame.astype(object).where(frame.notna(), None).itertuples(index=False), key=lambda r: r.a_ord)
        own, letters = {r.a_ord: r.x for r in rows}, {r.b_ord: r.y for r in rows} | {r.best: r.best_y for r in rows if r.best is not None}
        holds, holders, how, freed = {r.a_ord: r.b_ord for r in rows}, {}, {}, {}
        for r in rows:
            holders.setdefault(r.b_ord, set()).add(r.a_ord)

        def move(a: int, b: int | None, decision: str) -> None:
            holders[holds[a]].discard(a)
            if b is not None:
                holders.setdefault(b, set()).add(a)
            holds[a], how[a] = b, decision

        def sim(a: int) -> float | None:
            return None if holds[a] is None else block_overlap(letters[holds[a]], own[a])

        for r in rows:
            now, old = sim(r.a_ord), holds[r.a_ord]
            if now is None or now >= LINE_MIN:
                continue
            owner = None if r.best is None else min([*holders.get(r.best, ()), *([] if r.holder is None else [r.holder])], default=None)
            theirs = sim(owner) if owner in own else None
            if r.best is not None and owner is None:
                move(r.a_ord, r.best, "relinked")
                freed[r.a_ord] = old
            elif owner is not None and theirs is not None and theirs < LINE_MIN:
                move(owner, old, "swapped")
                move(r.a_ord, r.best, "swapped")
            else:
                move(r.a_ord, None, "none")
                freed[r.a_ord] = old
        out = [(a, b, None if b is None else sim(a), how.get(a), freed.get(a)) for a, b in holds.items()]
        return pd.DataFrame(out, columns=["a_ord", "b_ord", "sim", "decision", "freed"]).astype({"a_ord": "int64", "b_ord": "Int64", "sim": "float64", "freed": "Int64"})

    return work.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: go(f.drop(columns="all", errors="ignore")), "a_ord bigint, b_ord bigint, sim double, decision string, freed bigint")


def twins(free: DataFrame, taken: DataFrame) -> DataFrame:
    """(b_ord, twin) of free b rows (ord, skeleton) that equal a linked pair (ord, skeleton, other): 12 letters as its b has, and ``TWIN_MIN``
    likeness with the opening of its a's title, ``other``, over 8 letters at least."""
    f = free.select(F.col("ord").alias("b_ord"), F.col("skeleton").alias("x"), F.left("skeleton", F.lit(12)).alias("k"))
    t = taken.select(F.col("ord").alias("twin"), F.col("other").alias("y"), F.left("skeleton", F.lit(12)).alias("k"))
    pairs = f.join(t, "k").withColumn("sim", opening_udf(least=8)("x", "y")).where(F.col("sim") >= TWIN_MIN)
    return pairs.groupBy("b_ord").agg(F.min("twin").alias("twin"))


def only_in_second(b: DataFrame, matched: DataFrame, skeletons_seen: DataFrame) -> DataFrame:
    """b rows (ord, skeleton) without a match whose 12-letter opening is new; of equal openings the first."""
    rest = b.join(matched.select(F.col("b_ord").alias("ord")), "ord", "left_anti").withColumn("k", F.left("skeleton", F.lit(12)))
    new = rest.join(skeletons_seen.select(F.left("skeleton", F.lit(12)).alias("k")).distinct(), "k", "left_anti")
    return new.withColumn("__r", F.row_number().over(Window.partitionBy("k").orderBy("ord"))).where("__r = 1").drop("__r", "k")


def best_in_block(queries: DataFrame, lines: DataFrame, least: float = LINE_MIN, letters: int = 14) -> DataFrame:
    """(query, line, sim): for each query (ord, skeleton) of 6 letters or more the line (ord, skeleton) most like its opening, within the
    lines of one first letter; first of equals; from ``least`` on.

    The query's first ``letters`` letters are compared with as many of the line, or with all of a shorter one. Every pair of a block is
    tried, once for each distinct opening, in ``best_openings``: a ratio of ``least`` over t letters needs least t / 2 common ones in order. The queries of a letter are
    spread over parts of some thousand, each of which meets all lines of the letter; a task holds those and its queries.
    """
    opening = F.left("skeleton", F.lit(letters))
    q = cut_lineage(queries.where(F.length("skeleton") >= 6).select(F.col("ord").alias("query"), opening.alias("x")))
    parts = max(1, -(-q.count() // 50_000))  # one number
    s = lines.where(F.length("skeleton") > 0).groupBy(opening.alias("y")).agg(F.min("ord").alias("line"))
    kind = s.schema["line"].dataType
    part = F.pmod(F.hash("x"), F.lit(parts)).alias("part")
    asked = q.select("x").distinct().select(F.left("x", F.lit(1)).alias("k"), part, "x", F.lit(None).cast("string").alias("y"), F.lit(None).cast(kind).alias("line"))
    there = s.select(F.left("y", F.lit(1)).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("string").alias("x"), "y", "line")
    # So many partitions, since the time of a cell does not show in its size: joined by size, few tasks would do it all.
    cells = asked.unionByName(there).repartition(32 * parts, "k", "part")

    def tried(cell: pa.Table) -> pa.Table:
        asked, there = cell.filter(pc.is_valid(cell["x"])), cell.filter(pc.is_valid(cell["y"]))
        line = there["line"].combine_chunks()
        fields = {str(i): c for i, c in enumerate(line.flatten())} if pa.types.is_struct(line.type) else {"0": line}
        there = there.take(pc.sort_indices(pa.table(fields), sort_keys=[(c, "ascending") for c in fields], null_placement="at_start"))
        texts = asked["x"].to_pylist()
        found = best_openings(texts, there["y"].to_pylist(), least, letters)
        lines = there["line"].take(pa.array([line for _, line, _ in found], pa.int64()))
        return pa.table({"x": pa.array([texts[at] for at, _, _ in found], pa.string()), "line": lines, "sim": pa.array([sim for _, _, sim in found], pa.float64())})

    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("line", kind), T.StructField("sim", T.DoubleType())])
    return q.join(cells.groupBy("k", "part").applyInArrow(tried, schema), "x").select("query", "line", "sim")


def link(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_ord, b_ord, decision, sim) for every row of a (ord, section, number, latin, translit) and every b (ord, section, number, native, lyrics) left.

    Passes: number matches with the title check, claims, fuzzy titles among free rows, rejected number matches whose b stayed free,
    links whose lines disagree, opening lines among what is still free, then what is left of b. decision is number, fuzzy, rescued,
    relinked, swapped, lines or none; of a b without an a: twin (of a linked one), repeat (of an opening seen) or second. A b is
    free when no a holds it; those given up stand last among equals.
    """
    number = cut_lineage(verified_number_matches(a, b))
    held = cut_lineage(resolved_claims(number.where("verdict = 'match'")).select("a_ord", "b_ord", "sim", F.lit("number").alias("decision")))

    def free(side: DataFrame, taken: DataFrame, column: str) -> DataFrame:
        return side.join(taken.select(F.col(column).alias("ord")).distinct(), "ord", "left_anti")

    titles_a = a.select("ord", X.skeleton_latin("latin").alias("skeleton"))
    titles_b = b.select("ord", X.skeleton_native("native", "pipeline").alias("skeleton"))
    fuzzy = greedy_assignment(fuzzy_candidates(free(titles_a, held, "a_ord"), free(titles_b, held, "b_ord")))
    held = cut_lineage(held.unionByName(fuzzy.withColumn("decision", F.lit("fuzzy"))))
    rescue = number.where("verdict = 'reject'").join(held.select("b_ord"), "b_ord", "left_anti").join(held.select("a_ord"), "a_ord", "left_anti")
    rescue = last_per_key(rescue.withColumn("o", -F.col("a_ord")), ["b_ord"], "o").select("a_ord", "b_ord", "sim", F.lit("rescued").alias("decision"))
    held = cut_lineage(held.unionByName(rescue))
    native, latin = line_skeletons("lyrics", "translit")
    lines_a, lines_b = a.select("ord", latin.alias("skeleton")), b.select("ord", native.alias("skeleton"))
    moved = cut_lineage(relinked(held, lines_a, lines_b))
    changed = moved.where("decision is not null")
    held = cut_lineage(held.join(changed, "a_ord", "left_anti").unionByName(changed.where("b_ord is not null").select("a_ord", "b_ord", "sim", "decision")))
    place = changed.where("freed is not null").groupBy(F.col("freed").alias("b_ord")).agg(F.max("a_ord").alias("place"))
    open_pairs = line_candidates(free(lines_a, held, "a_ord"), free(lines_b, held, "b_ord")).join(place, "b_ord", "left").withColumn("place", F.coalesce("place", F.lit(-1)))
    held = cut_lineage(held.unionByName(greedy_assignment(open_pairs).withColumn("decision", F.lit("lines"))))
    linked = held.select("a_ord", F.col("b_ord").alias("ord")).join(titles_b, "ord").join(titles_a.select(F.col("ord").alias("a_ord"), F.col("skeleton").alias("other")), "a_ord")
    rest = cut_lineage(free(titles_b, held, "b_ord"))
    twin = cut_lineage(twins(rest, linked).select("b_ord"))
    second = cut_lineage(only_in_second(rest, twin, linked).select(F.col("ord").alias("b_ord")))
    left = rest.select(F.col("ord").alias("b_ord")).join(twin.withColumn("twin", F.lit(True)), "b_ord", "left").join(second.withColumn("new", F.lit(True)), "b_ord", "left")
    decision = F.when(F.col("twin"), "twin").when(F.col("new"), "second").otherwise("repeat")
    of_a = a.select(F.col("ord").alias("a_ord")).join(held, "a_ord", "left").select("a_ord", "b_ord", F.coalesce("decision", F.lit("none")).alias("decision"), "sim")
    return of_a.unionByName(left.select("b_ord", decision.alias("decision")), allowMissingColumns=True)


def representatives(rows: DataFrame, group: str, rank: list[Column], own: list[str], filled: list[str], joined: list[str]) -> DataFrame:
    """One row for each group: ``own`` columns of its first row in rank order, of each of ``filled`` the first value in rank order that is neither null
    nor empty, of each of ``joined`` the distinct values sorted and joined by commas (null without any), and members, the number of rows.

    All of it is mergeable, so a group of any size is combined before the shuffle; ``rank`` must be total."""
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)])
    known = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))
    packed = rows.withColumn("__rank", order).groupBy(group).agg(
        F.count("*").alias("members"),
        F.min_by(F.struct(*own), "__rank").alias("__own"),
        *[F.min_by(c, F.when(known(c).isNotNull(), F.col("__rank"))).alias(c) for c in filled],
        *[F.nullif(F.array_join(F.array_sort(F.collect_set(known(c))), ", "), F.lit("")).alias(c) for c in joined],
    )
    return packed.select(group, "members", "__own.*", *filled, *joined)


def filled_from_lines(queries: DataFrame, lines: DataFrame, share: float = 0.92, least: float = 0.5) -> DataFrame:
    """(query, title, lyrics, sim) of queries (ord, translit) whose opening stands among ``lines`` (page, at, text) of another edition.

    The best line for the opening (``best_in_block``) and those after it in page order, until they have ``share`` of the letters of the whole
    romanised text (line breaks differ between editions); the first line always. Texts whose opening two lines agree by less than ``least`` are left out. Lines
    have their letters summed over range partitions, and a text meets only the buckets of sums that it reaches into.
    """
    bucket = 256
    skeleton = X.skeleton_native("text", "pipeline")
    placed = cut_lineage(with_position(lines.withColumn("skeleton", skeleton), [F.col("page").asc(), F.col("at").asc()], F.length("skeleton")))
    texts = queries.select(F.col("ord").alias("query"), F.filter(F.transform(F.split(F.coalesce("translit", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("l"), "translit")
    asked = texts.select("query", "translit", F.get("l", F.lit(0)).alias("first"), F.length(X.skeleton_latin(F.array_join("l", " "))).alias("target"))
    best = best_in_block(asked.select(F.col("query").alias("ord"), X.skeleton_latin("first").alias("skeleton")), placed.select(F.col("position").alias("ord"), "skeleton"))
    start = best.join(placed.select(F.col("position").alias("line"), F.col("total_before").alias("begin")), "line").join(asked, "query")
    reach = start.withColumn("end", F.col("begin") + share * F.col("target")).withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.col("end") / bucket))))
    following = reach.join(placed.select("position", "text", "total_before", F.floor(F.col("total_before") / bucket).alias("b")), "b")
    following = following.where("position = line or (position > line and total_before < end)")
    found = following.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"), F.first("translit").alias("translit"), F.first("sim").alias("sim"))
    found = found.select("query", "translit", "sim", F.array_join(F.transform("t", lambda s: s["text"]), "\n").alias("lyrics"))
    checked = found.withColumn("agree", F.coalesce(block_overlap_udf(*line_skeletons("lyrics", "translit")), F.lit(1.0))).where(F.col("agree") >= least)
    return checked.select("query", F.rtrim(F.split("lyrics", "\n")[0], F.lit(",।;—-–! ")).alias("title"), "lyrics", "sim")


def clusters(rows: DataFrame, ident: str, order: str, right: str, key: str) -> DataFrame:
    """(ident, cluster): rows joined by an equal right-hand row or an equal key, except where both have different right-hand rows.

    Edges go from each row to the first of its group, so their number grows with the rows, not with pairs; least labels spread
    until none changes, however many rounds that takes, with the state cut every round.
    """
    r = rows.select(F.col(ident).alias("i"), F.col(order).alias("o"), F.col(right).alias("r"), F.col(key).alias("k"))
    # First rows of groups are aggregates joined back, not windows: a group of any size is combined before the shuffle.
    of_right = r.where("r is not null").groupBy("r").agg(F.min("o").alias("fr"))
    of_key = r.where("k is not null").groupBy("k").agg(F.min(F.struct("o", "r")).alias("f")).select("k", F.col("f.o").alias("fk"), F.col("f.r").alias("fkr"))
    first = r.join(of_right, "r", "left").join(of_key, "k", "left")
    conflict = F.col("r").isNotNull() & F.col("fkr").isNotNull() & (F.col("r") != F.col("fkr"))
    edges = first.where("fr < o").select("o", F.col("fr").alias("t")).unionAll(first.where((F.col("fk") < F.col("o")) & ~conflict).select("o", F.col("fk").alias("t"))).distinct()
    both = cut_lineage(edges.unionAll(edges.select(F.col("t").alias("o"), F.col("o").alias("t"))))
    labels = cut_lineage(r.select("o", F.col("o").alias("label")))
    moved = True
    while moved:
        near = both.join(labels.select(F.col("o").alias("t"), F.col("label").alias("near")), "t").groupBy("o").agg(F.min("near").alias("near"))
        new = labels.join(near, "o", "left").select("o", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        # labels of labels, so that rounds grow with the logarithm of a chain
        of = new.select(F.col("o").alias("to"), F.col("to").alias("next"))
        new = cut_lineage(new.join(of, "to", "left").select("o", F.least("to", "next").alias("label"), "old"))
        moved = not new.where("label < old").isEmpty()
        labels = new.select("o", "label")
    return r.join(labels, "o").select(F.col("i").alias(ident), F.col("label").alias("cluster"))
