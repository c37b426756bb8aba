from hypothesis import given
from hypothesis import strategies as st

from sargam.llm.forms import look_alike_pairs, visible_form, visible_form_column

SAME = [
    ("Ｋａ！", "Ka!"), ("a b", "a b"), ("a​b﻿", "ab"), ("কো", "কো"), ("ড়", "ড়"), ("অার", "আর"),
    ("ব়", "র"), ("৷", "।"), ("Маta", "Mata"), ("rāt", "rāt"), ("  x \n y  ", "x\n y"), ("x\r\ny", "x\ny"), ("যা়", "য়া"),
]
OTHER = [("কি", "কী"), ("a!", "a"), ("a", "A"), ("a b", "ab"), ("a\nb", "a b"), ("শ", "ষ")]


def test_same_and_other_forms():
    for a, b in SAME:
        assert visible_form(a) == visible_form(b), (a, b)
    for a, b in OTHER:
        assert visible_form(a) != visible_form(b), (a, b)
    assert visible_form("STRASSE ß", True) == visible_form("strasse SS", True)
    assert visible_form(None) is None and visible_form("​ ") == ""


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs"]), st.sampled_from("অাবর়োেৌৗড়যঅ্ ়\n​﻿")), max_size=30))
def test_idempotent(text):
    for fold in (False, True):
        once = visible_form(text, fold)
        assert visible_form(once, fold) == once


def test_column_with_nulls_repeats_and_long_text(spark):
    rows = [(None,), ("",), ("Ａ",), ("Ａ",), ("x " * 60_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(visible_form_column("t")).collect()]
    assert got == [None, "", "A", "A", ("x " * 60_000).strip()]


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "id string, title string, words string, form string, stored int")
    return {tuple(r) for r in look_alike_pairs(df, "id", ["title", "words"]).collect()}


def test_pairs(spark):
    rows = [
        ("a", "Ka", "x\ny"), ("b", "Ｋa", "x\ny"), ("c", "Ka", "x\ny"), ("c", "Ka", "x\ny"), ("d", "Ka", "x​\ny "), ("e", "ka", "x\ny"), ("f", "Ka", None), ("g", "Ｋa", ""), ("h", None, "x\ny"),
        (None, "Ｋa", "x\ny"), ("i", "​", "x"), ("j", "‌", "x"),
    ]
    assert pairs(spark, rows) == {("a", "b"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    assert pairs(spark, []) == set()


def test_many_identical_copies_are_no_pairs(spark):
    rows = [(f"n{k:05d}", "Ka", "x") for k in range(20_000)] + [("z", "Ｋa", "x")]
    assert len(pairs(spark, rows)) == 20_000


def test_accents_on_look_alike_letters():
    assert visible_form("rа̄t") == visible_form("rāt") == visible_form("rāt")
    assert visible_form("ё") == visible_form("ë")
