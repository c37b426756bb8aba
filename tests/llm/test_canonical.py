from sargam.llm.canonical import map_to_reference

REFERENCE = [(0, "Mebela", "মেবেলা"), (1, "Jhindusuri", "ঝিন্দুসুরি"), (2, "Luboranjan", "লূবোরঞ্জন"), (3, "Chhuru", None), (4, None, None)]
CASES = {
    "Mebela": "Mebela", " mebela? ": "Mebela", "মেবেলা": "Mebela", "raga Mebala": "Mebela", "M ebela": "Mebela", "Misra-Jhindusuri": "Jhindusuri", "Zhindoosuree": "Jhindusuri", "R. Lubawranjan / Mebela": "Luboranjan",
    "CHURU (mixed)": "Chhuru", "Jhindusuri with Mebela": "Jhindusuri", "Ghighikosh": "unmatched", "-": "unmatched", "": "unmatched", "n/a": "unmatched", "not known": "unmatched", "x" * 20_000: "unmatched", "o'clock": "unmatched",
}


def mapped(spark, rows, reference=REFERENCE):
    df = spark.createDataFrame([(*r, "k", "v") for r in rows], "id bigint, typed string, value string, name string")
    ref = spark.createDataFrame(reference, "ord int, name string, name_bn string")
    return sorted(tuple(r) for r in map_to_reference(df, ["id"], "typed", ref, "name", "name_bn", "ord").collect())


def test_cases(spark):
    rows = list(enumerate([*CASES, None]))
    assert mapped(spark, rows) == [(k, CASES[v]) for k, v in rows if v is not None]


def test_repeats_and_empty_tables(spark):
    assert mapped(spark, [(1, "Mebela"), (1, "Mebela")]) == [(1, "Mebela"), (1, "Mebela")]
    assert mapped(spark, []) == []
    assert mapped(spark, [(1, "Mebela")], []) == [(1, "unmatched")]


def test_short_names_and_other_markers(spark):
    ref = [(0, "Re", "রে"), (1, "Ma", None), (2, "E", None), (3, "Mebela", None)]
    rows = list(enumerate(["re", "রে", "Ree", "raag Ma", "e", "m", "mo", "tune Mebela"]))
    assert [e for _, e in mapped(spark, rows, ref)] == ["Re", "Re", "unmatched", "Ma", "E", "unmatched", "unmatched", "unmatched"]
    df, list_ = spark.createDataFrame([("tune Mebela",)], "t string"), spark.createDataFrame(ref, "ord int, name string, name_bn string")
    assert map_to_reference(df, ["t"], "t", list_, "name", markers=("tune",)).first()["entry"] == "Mebela"


def test_pigeonhole_loses_nothing(spark):
    """Every string within two edits is found, as a comparison with the whole list finds it."""
    import random

    rng = random.Random(3)
    names = ["mebela", "jhindusuri", "luboranjan"]

    def edited(word):
        for _ in range(2):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("bdegklnor") + word[k:], word[:k] + rng.choice("bdegklnor") + word[k + 1 :]])
        return word

    rows = [(k, edited(names[k % 3])) for k in range(150)]
    found = dict(mapped(spark, rows))
    assert all(found[k].lower() == names[k % 3] for k, _ in rows)
