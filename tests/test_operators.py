import random

import pytest
from pyspark.sql import functions as F

from sargam.functions.similarity import block_overlap, opening_similarity, ratio
from sargam.operators import catalog, facets, lexicon, linkage, ranking, search, state, vectors


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_screen_bounds_and_nulls(spark):
    df = spark.createDataFrame([(s, True, "t") for s in (59, 60, 720, 721, None)] + [(100, False, "t"), (100, None, "t"), (100, True, "Full Album"), (100, True, None)], "seconds int, embeddable boolean, title string")
    assert sorted(r["seconds"] for r in catalog.screened(df, "(?i)full album").collect()) == [60, 100, 720]


def test_top_three_keeps_arrival_order_on_ties(spark):
    df = spark.createDataFrame([("s", 5, 0), ("s", 9, 1), ("s", 9, 2), ("s", 1, 3)], "k string, views int, ord int")
    top = catalog.top_per_key(df, "k", [F.col("views").desc(), F.col("ord").asc()], 3)
    assert [r["ord"] for r in top.orderBy("rank").collect()] == [1, 2, 0]
    nested = catalog.nest(top, "k", "rank", ["ord"], "v").first()["v"]
    assert [x["ord"] for x in nested] == [1, 2, 0]


def test_has_media(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1])], "i int, v array<int>")
    assert [r[0] for r in df.orderBy("i").select(catalog.has_media("v")).collect()] == [False, False, True]


def test_refresh_prune_export(spark):
    media = "array<struct<id string, views bigint>>"
    df = spark.createDataFrame([("a", [("x", 1), ("y", 5)]), ("b", []), ("c", None)], f"k string, v {media}")
    fresh = spark.createDataFrame([("x", 9, True), ("y", None, True), ("z", 1, True)], "id string, views bigint, embeddable boolean")
    got = {r["k"]: r["v"] for r in catalog.refreshed(df, "k", "v", fresh).collect()}
    assert [(m["id"], m["views"]) for m in got["a"]] == [("x", 9), ("y", 5)] and got["b"] == [] and got["c"] is None
    kept = catalog.drop_empty(spark.createDataFrame([("", [], [], 1)], "s string, a array<int>, videos array<int>, n int")).first()
    assert tuple(kept) == (None, None, [], 1)
    document = catalog.export_document(spark.createDataFrame([(2, "b"), (1, "a")], "ord int, x string"), "songs", "ord").first()["document"]
    assert document == '{"meta":{"count":2},"songs":[{"ord":1,"x":"a"},{"ord":2,"x":"b"}]}'


def test_unique_budget_batches_first_filled(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert catalog.assert_unique(df, "k").count() == 2
    with pytest.raises(ValueError, match="duplicate key"):
        catalog.assert_unique(df.union(df), "k")
    queue = spark.range(10).withColumnRenamed("id", "o")
    assert catalog.within_budget(queue, [F.col("o").asc()], F.lit(101), 505, 202).count() == 4
    batches = catalog.id_batches(spark.range(120).select(F.format_string("%03d", "id").alias("k")), "k").orderBy("batch").collect()
    assert [len(b["keys"]) for b in batches] == [50, 50, 20] and batches[2]["keys"][0] == "100"
    first = catalog.first_filled(spark.createDataFrame([("g", 1, "", None), ("g", 2, "x", None), ("g", 3, "y", 7)], "g string, o int, s string, n int"), "g", [F.col("o")], ["s", "n"])
    assert tuple(first.first()) == ("g", "x", 7)


def test_positions_are_global(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("g"), "id").repartition(9)
    got = ranking.with_position(df, [F.col("g").desc(), F.col("id").asc()], F.col("g")).collect()
    want, total = [], 0
    for k, (g, i) in enumerate(sorted(((r["g"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))):
        want.append((g, i, k, total))
        total += g
    assert sorted((r["g"], r["id"], r["position"], r["total_before"]) for r in got) == sorted(want)


def test_upsert_latest(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 4, "n"), ("c", None, "n")], "k string, v int, x string")
    assert rows(catalog.upsert_latest(old, new, "k", "v"), "k", "x") == [("a", "n"), ("b", "o"), ("c", "n")]


def test_facet_counts_are_pool_sizes(spark):
    rng = random.Random(1)
    data = [(k, rng.sample(["m1", "m2", "m3"], rng.randrange(3)), rng.choice(["p", "q", "", None]), rng.random() < 0.7) for k in range(200)]
    df = spark.createDataFrame(data, "id int, moods array<string>, part string, playable boolean")
    fs = [facets.Facet("moods", facets.values_of(df, "moods")), facets.Facet("part", facets.values_of(df, "part"))]
    chosen = facets.FacetState({"moods": ["m1"], "part": ["p"]})
    for r in facets.facet_counts(df, fs, chosen, F.col("playable")).collect():
        alone = chosen.with_value(r["facet"], [r["value"]])
        assert facets.facet_pool(df, fs, alone, F.col("playable")).count() == r["n"]
    assert facets.FacetState().only("part", "q").active() == [("part", "q")]


def test_search_tiers(spark):
    data = [(1, "নদী", "Nodi Pothe", ""), (2, None, "Ei Nodi Pothe", ""), (3, None, "Nodhee Pothey", ""), (4, None, "Sei Nodhee Pothey", ""), (5, None, "Other", "x nodi pothe y"), (6, None, "Other", ""), (7, "নোদি পথে", None, None)]
    p = search.search_projection(spark.createDataFrame(data, "ord int, bn string, en string, lyrics string"), "bn", "en", "lyrics")
    assert rows(search.search(p, "Nodi pothe"), "ord", "tier") == [(1, 2), (2, 2), (3, 3), (4, 4), (5, 5), (7, 3)]
    assert search.search(p, "").count() == 0
    assert rows(search.search(p, "ndh"), "ord") == []


def test_related_equals_all_pairs(spark):
    rng = random.Random(6)
    pick = lambda *v: rng.choice([None, *v])
    data = [(f"i{k}", k, rng.sample(["a", "b", "c"], rng.randrange(3)), pick("r1", "r2"), pick("p", "q"), pick("u", "v"), pick("s", "t"), pick("x", "y"), rng.random() < 0.5, rng.random() < 0.3) for k in range(60)]
    df = spark.createDataFrame(data, "id string, ord int, m array<string>, raag string, parjay string, sub string, season string, taal string, playable boolean, popular boolean")
    got = rows(ranking.related(df, "id", "ord", "m", "raag", "parjay", "sub", "season", "taal", F.col("playable"), F.col("popular")), "item", "other", "score")
    want = []
    for a in data:
        scored = []
        for b in data:
            if a[0] == b[0]:
                continue
            same = lambda k: a[k] is not None and a[k] == b[k]  # noqa: E731, B023
            score = 3 * len(set(a[2]) & set(b[2])) + 3 * same(3) + (2 if same(5) and same(4) else 1 if same(4) else 0) + 2 * same(6) + 0.5 * same(7)
            if score >= 4:
                scored.append((-(score + 1.5 * b[8] + 0.5 * b[9]), b[1], b[0]))
        want += [(a[0], i, -s) for s, _, i in sorted(scored)[:10]]
    assert got == sorted(want)


def shuffled_rows(spark):
    """Rows written to shuffles by all stages of the session so far."""
    store = spark._jsc.sc().statusStore()
    empty = spark._jvm.java.util.ArrayList()
    stages = store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_related_grows_with_the_items_not_with_their_pairs(spark):
    n = 1200
    data = [(f"i{k}", k, ["a", "b"], f"r{k}", "p", None, None, None, True, k % 7 == 0) for k in range(n)]
    df = spark.createDataFrame(data, "id string, ord int, m array<string>, raag string, parjay string, sub string, season string, taal string, playable boolean, popular boolean")
    before = shuffled_rows(spark)
    got = rows(ranking.related(df, "id", "ord", "m", "raag", "parjay", "sub", "season", "taal", F.col("playable"), F.col("popular")), "item", "other", "score")
    assert shuffled_rows(spark) - before < 80 * n  # pairs of all that share a mood and a category are n * n
    first = [f"i{k}" for k in range(0, n, 7)][:11]
    assert got == sorted((f"i{k}", o, 9.0) for k in range(n) for o in [x for x in first if x != f"i{k}"][:10])


def test_weighted_pick_follows_weights(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2 == 0).alias("even"))
    picked = ranking.weighted_pick(df, "id", F.when(F.col("even"), 4.0).otherwise(1.0), 2000, seed=3)
    assert 1500 < picked.where("even").count() < 1720
    assert rows(picked, "id") == rows(ranking.weighted_pick(df.repartition(7), "id", F.when(F.col("even"), 4.0).otherwise(1.0), 2000, seed=3), "id")


def test_playlist_and_exclusion(spark):
    df = spark.createDataFrame([("a", 1, ["x", "y"], "s", 10, True), ("b", 2, ["y"], "t", None, True), ("c", 3, [], "s", None, True), ("d", 4, ["x"], "s", None, False), ("e", 5, None, "t", 1, True)], "id string, ord int, moods array<string>, season string, pop int, playable boolean")
    p = ranking.playlist(df, {"x": 1.0, "y": 0.5}, "s", 10, never=spark.createDataFrame([("z",)], "id string"), liked=spark.createDataFrame([("b",)], "id string")).collect()
    assert [(r["id"], round(r["score"], 4)) for r in p] == [("a", 2 * 1.375 + 1 + 0.4 * (1 - 10 / 400)), ("b", 1.6), ("c", 1.0)] and p[0]["why"] == ["x", "y", "s"]
    pool = spark.createDataFrame([(k,) for k in "abcd"], "id string")
    recent = spark.createDataFrame([("d", 1), ("c", 2), ("b", 3)], "id string, place int")
    assert rows(ranking.recency_excluded(pool, recent, "id", "place", ["a"]), "id") == [("b",)]
    assert rows(ranking.recency_excluded(pool, recent, "id", "place", ["a", "b"]), "id") == [("c",), ("d",)]
    assert len(rows(ranking.recency_excluded(pool, recent, "id", "place", list("abcd")), "id")) == 4


LEXICON = lexicon.MoodLexicon([("joy", ["happy", "very happy", "glad*"]), ("sad", ["lost", "ভালো না"]), ("calm", ["ভালো"])], [("rain", ["rain*"]), ("cold", ["snow"])], ["not", "never"], {"joy"}, "sad")


@pytest.mark.parametrize(
    "text, hits",
    [
        ("very happy", [("joy", "very happy", 1.0)]), ("happy", [("joy", "happy", 1.0)]), ("not happy", [("sad", "not happy", 0.8)]), ("not so happy", [("sad", "not happy", 0.8)]), ("not so really happy", [("joy", "happy", 1.0)]),
        ("never lost", []), ("gladly unhappy", [("joy", "gladly", 1.0)]), ("ভালো না ভালো", [("sad", "ভালো না", 1.0), ("calm", "ভালো", 1.0)]), (None, []), ("", []),
    ],
)
def test_mood_hits(text, hits):
    assert LEXICON.hits(text) == hits


def test_moods_and_season(spark):
    df = spark.createDataFrame([(1, "happy happy lost"), (2, None), (3, "happy happy happy lost")], "i int, t string")
    got = {(r["i"], r["mood"]): round(r["weight"], 3) for r in lexicon.detect_moods(df, "i", "t", LEXICON).collect()}
    assert got == {(1, "joy"): 1.0, (1, "sad"): 0.5, (3, "joy"): 1.0}
    assert LEXICON.season("raining snow") == "rain" and LEXICON.season("x") is None


def test_spelling_fix(spark):
    dotted = "ঝড়"
    df = spark.createDataFrame([(1, f"{dotted} {dotted} {dotted} x ঝড।"), (2, None), (3, "")], "i int, t string")
    fixes = lexicon.dotless_fixes(lexicon.word_frequency(df, "t"))
    assert rows(fixes, "word", "fixed") == [("ঝড", dotted)]
    assert {r["i"]: r["t"] for r in lexicon.replace_words(df, "i", "t", fixes).collect()} == {1: f"{dotted} {dotted} {dotted} x {dotted}।", 2: None, 3: ""}


def brute_assignment(pairs):
    out, free = [], {b for _, b, _ in pairs}
    for a in sorted({a for a, _, _ in pairs}):
        options = [(-s, b) for x, b, s in pairs if x == a and b in free]
        if options:
            s, b = min(options)
            free.discard(b)
            out.append((a, b, -s))
    return out


def test_greedy_assignment(spark):
    rng = random.Random(9)
    for size in (3, 12):
        pairs = [(a, b, rng.choice([0.8, 0.9, 1.0])) for a in range(size) for b in range(size) if rng.random() < 0.5]
        df = spark.createDataFrame(pairs, "a_ord int, b_ord int, sim double")
        assert rows(linkage.greedy_assignment(df), "a_ord", "b_ord", "sim") == brute_assignment(pairs)
    assert linkage.greedy_assignment(spark.createDataFrame([], "a_ord int, b_ord int, sim double")).count() == 0


def test_greedy_assignment_settles_a_long_queue_for_the_same_rows(spark):
    n = 120  # all want the same rows in the same order: one is settled by each round
    df = spark.range(n).select(F.col("id").alias("a_ord")).crossJoin(spark.range(n).select(F.col("id").alias("b_ord"))).withColumn("sim", 1 - F.col("b_ord") / 1000)
    assert rows(linkage.greedy_assignment(df), "a_ord", "b_ord") == [(k, k) for k in range(n)]


def test_fuzzy_candidates_find_what_all_pairs_find(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("kgncjtdrpbmls") for _ in range(rng.randrange(4, 16))) for _ in range(40)]
    changed = [w[:k] + rng.choice("kgncjtd") + w[k + 1 :] for w in words for k in [rng.randrange(len(w))]]
    a, b = spark.createDataFrame(list(enumerate(words)), "ord int, skeleton string"), spark.createDataFrame(list(enumerate(changed)), "ord int, skeleton string")
    got = {(r["a_ord"], r["b_ord"]) for r in linkage.fuzzy_candidates(a, b, 0.9).collect()}
    want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(changed) if len(x) >= 5 and len(y) >= 5 and opening_similarity(y, x, least=5) >= 0.9}
    assert got == want


@pytest.mark.parametrize("least", [0.8, 0.85])
def test_fuzzy_candidates_find_all_at_the_thresholds_in_use(spark, least):
    rng = random.Random(4)
    letters = "kgncjt"

    def edited(w):
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
        return w

    words = ["rkntk", *("".join(rng.choice(letters) for _ in range(rng.randrange(4, 17))) for _ in range(150))]
    changed = ["rkjtk", *(edited(w) for w in words[1:])]
    a, b = spark.createDataFrame(list(enumerate(words)), "ord int, skeleton string"), spark.createDataFrame(list(enumerate(changed)), "ord int, skeleton string")
    got = rows(linkage.fuzzy_candidates(a, b, least), "a_ord", "b_ord")
    want = sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(changed) if opening_similarity(y, x, least=5) >= least)
    assert got == want and len(got) > 40 and ((0, 0) in got) == (least == 0.8)


def test_line_candidates_find_what_all_pairs_find(spark):
    rng = random.Random(5)
    letters = "kgncjt"

    def edited(w):
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
        return w

    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(16, 40) if k % 2 else rng.randrange(9, 20))) for k in range(160)]
    changed = [edited(w)[:30] for w in words]
    words = [w[:30] for w in words]
    a, b = spark.createDataFrame(list(enumerate(words)), "ord int, skeleton string"), spark.createDataFrame(list(enumerate(changed)), "ord int, skeleton string")
    got = rows(linkage.line_candidates(a, b), "a_ord", "b_ord")
    want = sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(changed) if (block_overlap(y, x) or 0) >= 0.85)
    assert got == want and len(got) > 30


def test_opening_lines_link_by_thirty_letters(spark):
    one, two, three = "kamala gadapa nabima tarasa", "karoda silapa bajama", "kamala gadapa nabima tarasa\nbajama tasala kogara"
    a = spark.createDataFrame([(1, None, None, "", f"{one}\n{two}"), (2, None, None, "", f"{two}\n{one}")], "ord int, section string, number int, latin string, translit string")
    native = lambda t: t.translate(str.maketrans("kmlgdpnbrsjt", "কমলগদপনবরসজত"))
    b = spark.createDataFrame([(7, None, None, "", native(three)), (8, None, None, "", native(f"{two}\n{one}"))], "ord int, section string, number int, native string, lyrics string")
    got = {r["a_ord"]: (r["b_ord"], r["decision"]) for r in linkage.link(a, b).where("a_ord is not null").collect()}
    assert got == {1: (None, "none"), 2: (8, "lines")}


def test_links_whose_lines_disagree_are_swapped_moved_or_given_up(spark):
    one, two, three, four = "kgncjtdrpbml", "sptmklbcrjgd", "bmrdtjkpslcn", "ltsgpkmdbjrc"
    held = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, 14), (5, 15)], "a_ord bigint, b_ord bigint")
    la = spark.createDataFrame([(1, one), (2, two), (3, three), (4, "gggggggg"), (5, "")], "ord bigint, skeleton string")
    lb = spark.createDataFrame([(11, two), (12, one), (13, four), (14, four), (15, four), (16, three)], "ord bigint, skeleton string")
    got = rows(linkage.relinked(held, la, lb), "a_ord", "b_ord", "decision", "freed")
    assert got == [(1, 12, "swapped", None), (2, 11, "swapped", None), (3, 16, "relinked", 13), (4, None, "none", 14)]
    steady = spark.createDataFrame([(1, 12), (2, 11), (3, 13)], "a_ord bigint, b_ord bigint")
    same = spark.createDataFrame([(1, one), (2, two), (3, two)], "ord bigint, skeleton string")
    assert rows(linkage.relinked(steady, same, lb), "a_ord", "b_ord", "decision", "freed") == [(3, None, "none", 13)]


def test_link_verifies_lines_and_reports_what_is_left(spark):
    native = lambda t: t.translate(str.maketrans("kmlgdpnbrsjt", "কমলগদপনবরসজত"))
    title, one, two = "kamalagadapanabima", "karodasilapabajama", "balagakapatanamada"
    a = spark.createDataFrame([(1, "p", 1, title, one), (2, "p", 2, title, two)], "ord bigint, section string, number int, latin string, translit string")
    b = [(7, "p", 1, title, two), (8, "p", 2, title, one), (9, None, None, title, ""), (10, None, None, "pasanalata", ""), (11, None, None, "pasanalata", "")]
    b = spark.createDataFrame([(o, s, n, native(t), native(x)) for o, s, n, t, x in b], "ord bigint, section string, number int, native string, lyrics string")
    got = linkage.link(a, b).select("a_ord", "b_ord", "decision").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 8, "swapped"), (2, 7, "swapped"), (None, 9, "twin"), (None, 10, "second"), (None, 11, "repeat")], key=str)


def test_best_in_block_finds_what_all_lines_give(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("kgncj") for _ in range(n))
    queries = ["abcdefxd", *(word(rng.randrange(4, 18)) for _ in range(80))]
    lines = ["abXdefYd", "a", *(word(rng.randrange(0, 18)) for _ in range(200))]
    q, s = (spark.createDataFrame(list(enumerate(x)), "ord int, skeleton string") for x in (queries, lines))
    want = []
    for i, x in enumerate(queries):
        scored = [(-ratio(y[: len(x[:14])], x[:14]), j) for j, y in enumerate(lines) if y[:1] == x[:1]]
        if len(x) >= 6 and scored and min(scored)[0] <= -0.75:
            want.append((i, min(scored)[1], -min(scored)[0]))
    got = rows(linkage.best_in_block(q, s), "query", "line", "sim")
    assert got == want and got[0] == (0, 0, 0.75) and len(got) > 10


def test_best_openings_works_out_few_ratios_of_many_pairs(monkeypatch):
    from sargam.functions import similarity

    rng = random.Random(8)
    word = lambda n: "k" + "".join(rng.choice("kgncjtdrpbmls") for _ in range(n))
    lines = [word(rng.randrange(0, 16)) for _ in range(3000)]
    asked = sorted({lines[k][:14] for k in range(0, 300, 5)} | {word(rng.randrange(5, 14)) for _ in range(60)} | {"kkkkkkkkgg"})
    asked = [x for x in asked if len(x) >= 6]
    want = []
    for i, x in enumerate(asked):
        r, j = min((-similarity.ratio(y[: len(x)], x), j) for j, y in enumerate(lines))
        want += [(i, j, -r)] if -r >= 0.75 else []
    calls, plain = [], similarity.ratio
    monkeypatch.setattr(similarity, "ratio", lambda a, b: calls.append(1) or plain(a, b))
    assert sorted(similarity.best_openings(asked, lines, 0.75, 14)) == want and len(want) > 40
    assert len(calls) < len(asked) * len(lines) / 100


def test_claims_and_clusters(spark):
    m = spark.createDataFrame([(1, 1, 0.6), (2, 1, 0.95), (3, 1, 0.92), (4, 2, 0.5)], "a_ord int, b_ord int, sim double")
    assert rows(linkage.resolved_claims(m), "a_ord") == [(2,), (3,), (4,)]
    r = spark.createDataFrame([("a", 1, 10, "k1"), ("b", 2, 10, "k2"), ("c", 3, None, "k2"), ("d", 4, 11, "k2"), ("e", 5, None, None)], "id string, ord int, r int, k string")
    assert rows(linkage.clusters(r, "id", "ord", "r", "k"), "id", "cluster") == [("a", 1), ("b", 1), ("c", 1), ("d", 4), ("e", 5)]


def test_state(spark):
    schema = "u int, likes array<string>, never array<string>, recent array<string>, filters string, prefs_at bigint, session string, session_at bigint"
    local = spark.createDataFrame([(1, ["a"], ["b"], ["r"], "L", 5, "ls", 9), (2, ["x"], None, None, "L", 1, None, None)], schema)
    remote = spark.createDataFrame([(1, ["b", "c"], ["d"], ["q"], "R", 7, "rs", 3), (3, ["z"], [], [], "R", 1, "zs", 1)], schema)
    first = {r["u"]: r for r in state.merged_state(local, remote, "u", True).collect()}
    assert first[1]["likes"] == ["b", "c", "a"] and first[1]["never"] == ["d"] and first[1]["filters"] == "R" and first[1]["session"] == "ls" and first[2]["likes"] == ["x"] and first[3]["session"] == "zs"
    later = {r["u"]: r for r in state.merged_state(local, remote, "u", False).collect()}
    assert later[1]["likes"] == ["b", "c"] and later[1]["never"] == ["d"] and later[2]["likes"] == ["x"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<float>")
    got = {r["i"]: (r["n"], r["q"]) for r in df.select("i", vectors.normalised("v").alias("n"), vectors.quantised(vectors.normalised("v")).alias("q")).collect()}
    assert got[1][0] == pytest.approx([0.6, 0.8]) and list(got[1][1]) == [76, 102] and got[2][0] == [0.0, 0.0]
    entries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, e array<double>")
    sims = {(r["i"], r["name"]): r["sim"] for r in vectors.similarities(df, "i", "v", entries, "name", "e").collect()}
    assert sims == {(1, "a"): 3.0, (1, "b"): 4.0, (2, "a"): 0.0, (2, "b"): 0.0}


def test_dictionary_hits_find_what_all_pairs_find(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abকখ ") for _ in range(n))
    entries = [(k, f"n{k}", [word(rng.randrange(1, 6)) for _ in range(3)] + ["", None]) for k in range(12)]
    texts = [(k, rng.choice([None, word(rng.randrange(0, 12))]), word(rng.randrange(0, 12)).upper()) for k in range(200)]
    got = lexicon.dictionary_hits(spark.createDataFrame(texts, "i int, a string, b string"), "i", ["a", "b"], spark.createDataFrame(entries, "ord int, name string, s array<string>"), "name", "ord", "s")
    want = {}
    for i, a, b in texts:
        hay = " ".join(x for x in (a, b) if x is not None).lower()
        names = [n for _, n, s in entries if any(w and w.lower() in hay for w in s)]
        if names:
            want[i] = names
    assert {r["i"]: r["names"] for r in got.collect()} == want
    none = spark.createDataFrame([], "ord int, name string, s array<string>")
    assert lexicon.dictionary_hits(spark.createDataFrame(texts, "i int, a string, b string"), "i", ["a"], none, "name", "ord", "s").count() == 0


def test_products_in_blocks_equal_one_product(spark):
    rng = random.Random(9)
    vector = lambda: [rng.random() for _ in range(8)]
    q = spark.createDataFrame([(k, vector()) for k in range(20)] + [(99, None)], "i int, v array<double>")
    e = spark.createDataFrame([(f"e{k}", vector()) for k in range(11)] + [("none", None)], "name string, e array<double>")
    one = {(r[0], r[1]): r[2] for r in vectors.similarities(q, "i", "v", e, "name", "e").collect()}
    many = {(r[0], r[1]): r[2] for r in vectors.similarities(q, "i", "v", e, "name", "e", block_bytes=3 * 64).collect()}
    assert len(one) == 220 and one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_restored_sessions(spark):
    items = spark.createDataFrame([("a", ["a1", "a2"]), ("b", ["b1"])], "item string, media array<string>")
    rows = [(1, ["b", "gone", "a"], "a", "a2", 10.0, True), (2, [], "a", "zz", 1.0, True), (3, None, "gone", "a1", 5.0, False), (4, ["b"], None, None, None, None), (5, ["b"], "b", None, None, False)]
    got = {r["user"]: r for r in state.restored(spark.createDataFrame(rows, "user int, history array<string>, item string, medium string, at double, playing boolean"), "user", items).collect()}
    assert [tuple(x) for x in got[1]["history"]] == [("b", "b1"), ("a", "a1")] and tuple(got[1])[1:4] == ("a", "a2", 7.0)
    assert tuple(got[2])[1:] == ("a", "a1", 0.0, []) and tuple(got[3])[1:4] == (None, None, None) and tuple(got[4])[1:4] == (None, None, None) and tuple(got[5])[1:4] == ("b", "b1", 0.0)


def test_listener_and_picks(spark):
    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(30)], "id int, key int, w double")
    assert rows(facets.for_listener(df, "id", spark.createDataFrame([(1,), (1,)], "id int"), spark.createDataFrame([(1,), (2,), (2,)], "id int")), "id") == [(2,)]
    picked = ranking.picked_per_key(df, "key", "id", F.col("w"), 4, F.col("id") > 25)
    assert {r["key"] for r in picked.collect()} == {0, 1, 2} and all(r["id"] > 25 for r in picked.collect())
    assert rows(picked, "id") == rows(ranking.picked_per_key(df.repartition(5), "key", "id", F.col("w"), 4, F.col("id") > 25), "id")


def test_representatives(spark):
    df = spark.createDataFrame([(1, 2, "late", None, "z"), (1, 1, "first", "", "a"), (1, 3, "x", "raag", "z"), (2, 1, None, None, "")], "g int, r int, own string, fill string, many string")
    got = {r["g"]: tuple(r)[1:] for r in linkage.representatives(df, "g", [F.col("r")], ["own"], ["fill"], ["many"]).collect()}
    assert got == {1: (3, "first", "raag", "a, z"), 2: (1, None, None, None)}


def test_lines_fill_a_text(spark):
    lines = ["তোমার পথে নদী জলে", "কাছে দূরে মনে রাতে", "শুধু আকাশ ভোরে পাখি", "বনে বনে ফুলের হাসি", "এমন দিনে কারে বলা"]
    pages = spark.createDataFrame([(1, 0, "অন্য কথা কিছু"), *[(1, k + 1, x) for k, x in enumerate(lines[:2])], *[(2, k, x) for k, x in enumerate(lines[2:])]], "page int, at int, text string")
    songs = [(1, "tomar pothe nodi jole\nkachhe dure mone rate\nshudhu akash bhore pakhi"), (2, "tomar pothe nodi jole\nbhinno gaaner onno kotha"), (3, None), (4, "kichhui nei ekhane aj")]
    got = {r["query"]: r["lyrics"].split("\n") for r in linkage.filled_from_lines(spark.createDataFrame(songs, "ord int, translit string"), pages, least=0.9).collect()}
    assert got == {1: lines[:3]}


def test_clusters_of_a_long_chain(spark):
    df = spark.createDataFrame([(f"i{k}", k, k // 2, f"k{(k + 1) // 2}") for k in range(300)], "i string, o int, r int, k string").withColumn("r", F.when(F.col("o") % 2 == 0, None).otherwise(F.col("r")).cast("int"))
    plain = spark.createDataFrame([(f"i{k}", k, None, f"k{k // 2}") for k in range(100)], "i string, o int, r int, k string")
    assert {r["cluster"] for r in linkage.clusters(plain, "i", "o", "r", "k").collect()} == set(range(0, 100, 2))
    assert linkage.clusters(df, "i", "o", "r", "k").count() == 300
