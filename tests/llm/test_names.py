import math
import random

from sargam.llm.names import edits, name_key, named_persons, parts_of, similar_keys

PERSONS = [("Jhanulata Kuhekar", ["jhanulata kuhekar", "ঝানূলতা কূহেকর"]), ("Bemala Chhoguho", ["bemala chhoguho", "বেমালা ছগুহ", "mulu", "মূলূ"]), ("Tillolata Rikar", ["tillolata rikar"]), ("Pratinath Rikar", ["pratinath rikar"]), ("Astamala Louktakar", ["astamala louktakar", None]), ("Phoyejit Hoktorana", ["phoyejit hoktorana", "oshe"])]
NAMED = {
    "Pothe by Jhanulata Kuhekar": {"Jhanulata Kuhekar"}, "X sings": set(), "KUHEKAR, Zhanoolata | Audio": {"Jhanulata Kuhekar"}, "J. Kuhekar : x": {"Jhanulata Kuhekar"}, "x | J.Kuhekar | y": {"Jhanulata Kuhekar"},
    "Raktounath J. Kuhekar sings": set(), "ঝানূলতা কূহেকর": {"Jhanulata Kuhekar"}, "x [Singer: Jhanu-di Kuhekar]": {"Jhanulata Kuhekar"}, "JhanulataKuhekar": {"Jhanulata Kuhekar"}, "Jhanulata_Kuhekar Official": {"Jhanulata Kuhekar"},
    "x - Mulu": {"Bemala Chhoguho"}, "“Mulu” Chhoguho & Tillolata Rik. sings y": {"Bemala Chhoguho", "Tillolata Rikar"}, "Ami mulu pothe": set(), "Chhathinath Rikar": set(), "Oshoumala Louktakar": set(), "Pt. Bemaoa Chhgouho": {"Bemala Chhoguho"},
    "Jhanulata M. Kuhekar": {"Jhanulata Kuhekar"}, "Dhamulunath": set(), "Rikar": set(), "": set(), "Phoy-da Hoktorana": {"Phoyejit Hoktorana"}, "Ase TV": set(), "রীকর প্রাতীনাথ": {"Pratinath Rikar"},
}


def named(spark, rows, persons=PERSONS):
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "ord bigint, title string, channel string, key string, singer string")
    list_ = spark.createDataFrame(persons, "name string, spellings array<string>")
    out = {}
    for r in named_persons(df, "ord", ["title", "channel"], list_, "name", "spellings").collect():
        assert r["singer"] not in out.setdefault(r["ord"], set())
        out[r["ord"]].add(r["singer"])
    return out


def test_cases(spark):
    rows = [(k, t, None) for k, t in enumerate(NAMED)]
    got = named(spark, rows)
    assert {t: got.get(k, set()) for k, t, _ in rows} == NAMED


def test_both_columns_nulls_repeats_and_long_text(spark):
    rows = [(1, "x | Bemala Chhoguho", "Bemala Chhoguho - Topic"), (1, "x | Bemala Chhoguho", "Bemala Chhoguho - Topic"), (2, None, "T. Rikar"), (None, "Bemala Chhoguho", None), (3, None, None), (4, "pothe " * 20_000 + "by Bemala Chhoguho", "")]
    assert named(spark, rows) == {1: {"Bemala Chhoguho"}, 2: {"Tillolata Rikar"}, 4: {"Bemala Chhoguho"}}
    assert named(spark, []) == {}
    assert named(spark, [(1, "Bemala Chhoguho", None)], []) == {}


def test_keys_and_edits():
    assert name_key("ঘীধর") == name_key("Ghidhar") and name_key("ছবানাথ") == name_key("Chobaanath")
    assert name_key("Khotawlekha") == name_key("খতলেখা")
    assert edits("nokoti", "nkooti") == 1 and edits("", "ab") == 2
    assert parts_of("A by B - C (D)") == ["a", "b", "c", "d"]


def test_any_number_of_columns_and_long_repeats(spark):
    df = spark.createDataFrame([(1, None, "x", "Bemala Chhoguho"), (2, "Bemala Chhoguho", None, None), (3, "bemala chhoguho " * 3000, None, "Tillolata Rikar")], "ord bigint, a string, b string, c string")
    list_ = spark.createDataFrame(PERSONS, "name string, spellings array<string>")
    got = {tuple(r) for r in named_persons(df, "ord", ["a", "b", "c"], list_, "name", "spellings").collect()}
    assert got == {(1, "Bemala Chhoguho"), (2, "Bemala Chhoguho"), (3, "Bemala Chhoguho"), (3, "Tillolata Rikar")}
    assert {tuple(r) for r in named_persons(df, "ord", ["c"], list_, "name", "spellings").collect()} == {(1, "Bemala Chhoguho"), (3, "Tillolata Rikar")}


def test_prefix_filter_loses_no_pair(spark):
    """Every pair of keys whose bigram sets agree by a quarter and whose likeness is enough, as all pairs show."""
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("bdoknirt") for _ in range(rng.randrange(2, 10))) for _ in range(400)})
    other = []
    for k in keys[::2]:
        for _ in range(2):
            w = list(k)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(w))
                w[at : at + 2] = rng.choice([w[at : at + 2][::-1], w[at + 1 : at + 2], [rng.choice("bdok"), *w[at + 1 : at + 2]], [*w[at : at + 2], "n"]])
            other.append("".join(w))
    other = sorted({k for k in other if len(k) >= 2})

    def grams(k):
        k = f"^{k}$"
        return {k[i : i + 2] for i in range(len(k) - 1)}

    want = {(a, b) for a in keys for b in other if len(grams(a) & grams(b)) >= math.ceil(0.25 * max(len(grams(a)), len(grams(b)))) and 1 - edits(a, b) / max(len(a), len(b)) >= 0.65}
    one, two = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (keys, other))
    got = {(r["key"], r["entry_key"]) for r in similar_keys(one, two, 0.65).collect()}
    assert want <= got and len(want) > 200
