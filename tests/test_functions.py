import datetime
import difflib

import pytest
from pyspark.sql import functions as F

from sargam.functions import calendar as C
from sargam.functions import markup as M
from sargam.functions import similarity as S
from sargam.functions import sql
from sargam.functions import text as X


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression("v").alias("r")).first()["r"]


@pytest.mark.parametrize("value, site, pipeline", [("জল", "jl", "jl"), ("ডাক", "dk", "rk"), ("ঝড়", "jr", "jr"), ("ঝড়", "jr", "jr"), ("বৃষ্টি", "brst", "brst"), ("ছায়া", "c", "c"), ("", "", ""), (None, "", "")])
def test_native_skeleton(spark, value, site, pipeline):
    assert one(spark, value, X.skeleton_native) == site
    assert one(spark, value, lambda c: X.skeleton_native(c, "pipeline")) == pipeline


@pytest.mark.parametrize("value, want", [("Poroshmoni", "prsmn"), ("Parashmani", "prsmn"), ("bristi", "brst"), ("chhaya", "c"), ("exchange", "kscn"), ("small ring", "smlrn"), ("large anvil", "lrgnbl"), (None, "")])
def test_latin_skeleton(spark, value, want):
    assert one(spark, value, X.skeleton_latin) == want


@pytest.mark.parametrize("value, want", [("PT4M13S", 253), ("PT1H2M3S", 3723), ("P1DT1S", 86401), ("P1W", 0), ("", 0), (None, 0), ("x", 0)])
def test_iso_seconds(spark, value, want):
    assert one(spark, value, X.iso_seconds) == want


def test_similarity_values():
    assert S.ratio("abcd", "bcde") == 0.75 and S.ratio("ring", "bring") == pytest.approx(0.888889, abs=1e-6) and S.ratio("abc", "xyz") == 0
    assert S.opening_similarity("abcdef", "cde", window=True) == 1.0 and S.opening_similarity("abc", "", least=1) == 0.0
    assert S.block_overlap("abc", "abcdef") is None and S.block_overlap("abcdefgh", "abcxdefg") == pytest.approx(7 / 8)
    assert S.best_window("abc", "ab") == difflib.SequenceMatcher(None, "abc", "ab").ratio()
    assert S.needle_relevance([("abcd", 2)], ["xabcdx"], marked=False) == 0.0
    assert S.needle_relevance([("abcd", 2)], ["xabcdx"], marked=True) == 1.0
    assert S.needle_relevance([("abcdefghij", 2)], ["abcdefghix"], marked=False) == 0.9


@pytest.mark.parametrize("day, want", [("2026-04-13", "Basanta"), ("2026-04-14", "Grishma"), ("2026-12-15", "Hemanta"), ("2026-12-16", "Sheet"), ("2026-02-12", "Sheet"), ("2026-02-13", "Basanta"), ("2026-01-01", "Sheet"), (None, None)])
def test_season(spark, day, want):
    value = datetime.date.fromisoformat(day) if day else None
    assert one(spark, value, C.season_of, "date") == want


def test_regional_date(spark):
    day = datetime.date(2026, 1, 5)
    assert tuple(one(spark, day, C.regional_date, "date")) == (21, "Poush", 1432)
    assert tuple(one(spark, day, lambda c: C.regional_date(c, compat=True), "date")) == (297, "Chaitra", 1432)
    assert tuple(one(spark, datetime.date(2026, 4, 14), C.regional_date, "date")) == (1, "Baishakh", 1433)
    assert one(spark, None, C.regional_date, "date") is None


def test_text_scalars(spark):
    assert one(spark, "  Éa—B, ক় 12!", X.norm) == "éa b ক় 12"
    assert one(spark, "é", X.norm) == "é"
    assert tuple(one(spark, "Name (98)", X.split_number)) == ("Name", 98) and tuple(one(spark, "Name", X.split_number)) == ("Name", None)
    assert one(spark, "a/b/c-lyric.html", X.slug) == "c"
    assert one(spark, "২০২৪", X.digits_to_latin) == "2024" and one(spark, "2024", X.digits_to_native) == "২০২৪"
    assert one(spark, "a, b! c d e f", X.short_title) == "a b c d e"
    assert one(spark, "A | B & C - Topic", X.topic_performers) == ["A"] and one(spark, "A & B - Topic", X.topic_performers) == ["A", "B"] and one(spark, "A", X.topic_performers) == []
    assert one(spark, "a\n" * 500, lambda c: X.excerpt(c, 7)) == "a\na\na"
    assert one(spark, "Mishra Mebela - slow", lambda c: X.simplify_mode(c, {})) == "Mebela" and one(spark, "scottish air", lambda c: X.simplify_mode(c, {})) == "Western" and one(spark, "", lambda c: X.simplify_mode(c, {})) is None
    assert one(spark, "singer: Some Body | Official Video (x)", lambda c: X.title_segments(c, "(?i)official")) == ["Some Body"]
    assert [one(spark, n, X.human_number, "bigint") for n in (999, 1000, 1250, 9949, 15400000)] == ["999", "1k", "1.3k", "9.9k", "15M"]


def test_markup(spark):
    assert M.strip_markup("{{a|{{b|x=1|inner}}}}<ref>r</ref>[[p|label]] '''bold'''\n\n\n\n ১২\n") == "innerlabel bold\n\n১২"
    assert M.strip_markup("১\n\n২\nline<br/>two") == "line\ntwo"
    for page, plain in {
        "a{{gap|3em}}b": "a b", "{{overfloat left|যদি|depth=4em}}প্রেম": "যদি প্রেম", "{{rh|1|title|2}}\nx": "x", "{{c|১২}}\nx": "x", "{{c|x ১২}}": "x ১২", "{{x}}y": "y", "{{x|[[p|q]]}}": "q",
        "{{block|one\ntwo": "one\ntwo", "one}} two": "one two", "{{lone\nline": "line", "[[open {{a|b}}": "[[open b", "a | b]]": "a | b]]", "<section begin=x/>\u200bকা\u09be\u09c7&nbsp;ত": "কা\u09cb ত",
        "<noinclude>{{x|\n}}</noinclude>:: k :<!-- {{ -->": "k", "{{a|" * 300 + "deep" + "}}" * 300: "deep", "": "",
    }.items():
        assert M.strip_markup(page) == plain, page
    assert M.strip_markup("a{{rule|4em}}b", M.TemplateRules(newline=("rule",))) == "a\nb"
    page = '<section begin="a"/>one<section end="a"/>\n## b ##\ntwo\n## c ##\nthree'
    assert M.section_of(page, "a", "a") == "one" and M.section_of(page, "b", "b").strip() == "two" and M.section_of(page, None, None) == page
    assert M.section_of(page, "c", "c").strip() == "three" and M.section_of(page, "none", "a") == '<section begin="a"/>one' and M.section_of(page, "b", None).endswith("three")
    df = spark.createDataFrame([(page, "a", "a"), (None, "a", None)], "t string, b string, e string")
    assert [r[0] for r in df.select(M.section_text("t", "b", "e")).collect()] == ["one", None]


def test_category(spark):
    known = {"puja": "Puja", "prem": "Prem"}
    for value, want in (("Puja (12)", ("Puja", None, 12)), ("Puja 12", ("Puja", None, 12)), ("PREM", ("Prem", None, None)), ("some play", ("plays", "Some Play", None)), ("other (3)", (None, None, None)), (None, (None, None, None))):
        assert tuple(one(spark, value, lambda c: X.canonical_category(c, known, ["some-play"])))[:3] == want
    more = dict(native={"Puja": "পূজা", "Late": "শেষ", "Bhanu": "ভানু"}, appendix=("^late", "Late"), beginnings={"bhanu": "bhanu songs"})
    for value, want in (("Some play nn (4)", ("plays", "Some Play", None, None)), ("some play (scene 2)", ("plays", "Some Play", None, None)), ("Late ones (3)", ("Late", None, None, "শেষ")), ("Bhanu x / y (7)", ("Bhanu", None, 7, "ভানু")), ("Puja (54A)", ("Puja", None, None, "পূজা")), ("puja / prem 5", ("Puja", None, 5, "পূজা")), ("Puja Sub: x (1)", ("Puja", None, None, "পূজা"))):
        assert tuple(one(spark, value, lambda c: X.canonical_category(c, known | {"bhanu songs": "Bhanu"}, ["some-play"], **more))) == want, value


def test_sql_names(spark):
    sql.register(spark)
    assert spark.sql("select seq_ratio('abcd', 'bcde') r, nfc('é') n, block_overlap('abcdefgh', 'abcdefgh') b").first() == (0.75, "é", 1.0)


def test_zone_day(spark):
    row = spark.sql("select timestamp'2024-01-01 05:00:00' t").select(C.day_in_zone("t").alias("d"), C.season_now("t").alias("s")).first()
    assert row["d"] == datetime.date(2023, 12, 31) and tuple(row["s"]) == ("Sheet", "Basanta")
    assert F is not None
