import random

from sargam.llm.linkage import components, matched_records, matching_marginals, overlapping, record_features

SONG = "id string, bn string, en string, words string, latin string, number int, section string"
PAGE = "id string, bn string, words string, number int, section string"
TEXT = {k: "\n".join(" ".join(random.Random(f"{k}{i}{j}").choice(["ধাম", "নদী", "খোলা", "রীতে", "সুর", "মিহি", "গোল", "টানা", "পাখি", "ভেলা", "ঝাউ", "ডাল"]) + random.Random(f"{k}{j}{i}").choice(["কা", "লি", "মে", "তো", ""]) for i in range(5)) for j in range(6)) for k in "abcdefgh"}


def linked(spark, songs, pages):
    a = spark.createDataFrame(songs, SONG)
    b = spark.createDataFrame(pages, PAGE)
    fa = record_features(a, "a", "id", "words", "latin", "bn", "en", "number", "section")
    fb = record_features(b, "b", "id", "words", None, "bn", None, "number", "section")
    return {(r["id_a"], r["id_b"]): r["confidence"] for r in matched_records(fa, fb).collect()}


def test_texts_doubles_shared_openings_and_titles(spark):
    t = TEXT
    shared = t["a"].split("\n")[0] + "\n" + "\n".join(t["c"].split("\n")[1:])
    songs = [("s1", None, None, t["a"], None, 1, "x"), ("s2", None, None, t["a"].replace("ি", "ী"), None, 7, "x"), ("s3", None, None, shared, None, 3, "x"), ("s4", "সোনার খাঁচা নীল", "", None, None, 4, "y"), ("s5", None, None, None, None, 5, "y"), (None, None, None, t["b"], None, 1, "x"), ("s6", None, None, "", "", None, None)]
    pages = [("p1", None, t["a"], 2, "x"), ("p2", None, "\n".join(t["a"].split("\n")[1:]), None, None), ("p3", None, shared, 1, "x"), ("p4", "সোনার খাঁচা নীল", None, 4, "y"), ("p5", None, t["b"], 1, "x"), ("p6", None, None, None, None)]
    got = linked(spark, songs, pages)
    assert set(got) == {("s1", "p1"), ("s1", "p2"), ("s2", "p1"), ("s2", "p2"), ("s3", "p3"), ("s4", "p4")}
    assert all(0.5 <= c <= 1 for c in got.values())


def test_empty_sides(spark):
    assert linked(spark, [], [("p", "ক খ", None, 1, "x")]) == {}
    assert linked(spark, [("s", "ক খ", None, None, None, 1, "x")], []) == {}


def test_copies_are_one_node(spark):
    songs = [(f"s{k}", None, None, TEXT["d"], None, k, "x") for k in range(300)]
    assert len(linked(spark, songs, [("p", None, TEXT["d"], 1, "x")])) == 300


def test_beliefs_are_exact_on_a_tree_and_compete(spark):
    pairs = spark.createDataFrame([("a1", "b1", 2.0), ("a1", "b2", 1.0), ("a2", "b2", 0.5), ("a3", "b3", -1.0)], "a string, b string, weight double")
    got = {(r["a"], r["b"]): r["belief"] for r in matching_marginals(pairs, tolerance=1e-9).collect()}
    import itertools
    import math

    rows = [tuple(r) for r in pairs.collect()]
    total, by = 0.0, dict.fromkeys([(a, b) for a, b, _ in rows], 0.0)
    for chosen in itertools.product([0, 1], repeat=len(rows)):
        used = [r for r, c in zip(rows, chosen) if c]
        if len({a for a, _, _ in used}) == len(used) == len({b for _, b, _ in used}):
            w = math.exp(sum(x for _, _, x in used))
            total += w
            for a, b, _ in used:
                by[a, b] += w
    for key, value in by.items():
        assert abs(got[key] - value / total) < 1e-6


def test_titles_of_one_word_and_of_several_lines(spark):
    songs = [("s1", "মেঘমালা", None, None, None, 4, "y"), ("s2", "মেঘমালা", None, None, None, 9, "y"), ("s3", "\nসোনার খাঁচা", "Poth Hara\nNodi Jole Bhasa", None, None, 2, "x")]
    pages = [("p1", "মেঘমালা", None, 4, "y"), ("p3", "নদী জলে ভাসা", None, 2, "x")]
    assert set(linked(spark, songs, pages)) == {("s1", "p1"), ("s3", "p3")}


def test_components_of_a_long_chain(spark):
    edges = spark.range(700).selectExpr("id as p", "id + 1 as q").where("p <> 300")
    nodes = spark.range(710).selectExpr("id as rid")
    got = {r["rid"]: r["class"] for r in components(nodes, edges).collect()}
    assert got == {k: 0 if k <= 300 else 301 if k <= 700 else k for k in range(710)}


def test_beliefs_of_a_hub_and_of_loops(spark):
    pairs = [("hub", f"b{k}", 1.0) for k in range(400)] + [("x", "u", 1.0), ("x", "v", 1.2), ("y", "u", 0.9), ("y", "v", 1.0)]
    got = {(r["a"], r["b"]): r["belief"] for r in matching_marginals(spark.createDataFrame(pairs, "a string, b string, weight double"), tolerance=1e-9).collect()}
    assert len(got) == 404 and all(abs(got["hub", f"b{k}"] - 2.718281828 / (1 + 400 * 2.718281828)) < 1e-6 for k in range(400))
    assert got["x", "v"] > got["x", "u"] > 0.3 and got["x", "u"] + got["x", "v"] < 1


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(8)
    sets = [(k, sorted({int(rng.paretovariate(0.6)) % 200 for _ in range(rng.randrange(0, 14))})) for k in range(80)]
    df = spark.createDataFrame(sets, "rid bigint, grams array<bigint>")
    got = {(r["p"], r["q"]) for r in overlapping(df, df, 0.5).collect()}
    want = {(p, q) for p, x in sets for q, y in sets if x and (len(x), p) < (len(y), q) and len(set(x) & set(y)) >= 0.5 * len(x)}
    assert got == want and all(len(overlapping(df, df, 0.5, extra).collect()) == len(want) for extra in (1, 2, 6))
