import random

import pytest

from sargam.llm.stuffed import page_curves, page_terms, stuffed_pages

WORDS = [a + b for a in ("lan", "har", "stan", "tem", "cad", "mir", "flu", "bran", "sil", "thre", "mon", "gar") for b in ("tern", "bour", "za", "po", "ence", "ror", "te", "ch", "shold", "soon", "den", "ver")]


def prose(rng, n):
    return " ".join(f"The {rng.choice(WORDS)} of a {rng.choice(WORDS)} {rng.choice(WORDS)} the {rng.choice(WORDS)}." for _ in range(n))


@pytest.fixture(scope="module")
def reasons(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(3, 30))) for k in range(400)]
    rows += [(1000, "buy flute " * 60), (1001, "\n".join(rng.choice(["hd lesson", "new ticket", "song x"]) for _ in range(40))), (1002, "\n".join(f"{rng.choice(WORDS)} https://a.example/{k}" for k in range(30)))]
    rows += [(1003, " ".join(f"#tag{k}" for k in range(30))), (1004, "One sentence before it. " + " ".join(f"{rng.choice(['Buy', 'Best'])} flute in {rng.choice(['Kasba', 'Norapur', 'Dhuli'])}." for _ in range(40)))]
    refrain = "the same line of song again\n"
    rows += [(1005, "".join(prose(rng, 1) + "\n" + refrain for _ in range(12))), (1006, prose(rng, 12) + "\nhttps://a.example/x\n#one #two"), (1007, None), (1008, ""), (1009, "a b"), (1011, "#a #b #c #d"), (1012, "https://a.example/1 https://b.example/2"), (1013, "https://a.example/1"), (1014, prose(rng, 12) + "".join(f"\n[{k}] {rng.choice(WORDS)} {rng.choice(WORDS)}, https://a.example/{k}" for k in range(5))), (None, "buy flute " * 60), (1010, prose(rng, 3000))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, page string, n int")
    return {r["page"]: r["reason"] for r in stuffed_pages(df, "doc_id", "text").collect()}


def test_stuffed(reasons):
    assert all(reasons[k] == "divergence" for k in (1000, 1001, 1002, 1003, 1004, 1011, 1012))


def test_every_report_comes_from_the_curve(spark):
    """The verdict is a function of the three measures of the curve and its length class alone."""
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randrange(3, 30))) for k in range(300)] + [(1000 + k, " / ".join(f"{rng.choice(WORDS[:8])} {rng.choice(WORDS[8:40])} {rng.choice(WORDS[40:50])}" for _ in range(40))) for k in range(10)]
    rows += [(2000 + k, " ".join(f"{rng.choice(WORDS)} {rng.choice(WORDS)}{rng.choice(WORDS)}." for _ in range(rng.randrange(20, 90)))) for k in range(300)]
    got = stuffed_pages(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()
    flagged = {r["page"]: r["reason"] for r in got if r["reason"]}
    assert {k for k in flagged if k >= 1000 and k < 2000} == set(range(1000, 1010)) and not [k for k in flagged if k < 1000]
    assert all(r["repetition"] - r["expected"] >= (0.55 if r["reason"] == "divergence" else 0.35) for r in got if r["reason"])


def test_plain(reasons):
    assert not [k for k, v in reasons.items() if k < 1000 and v]
    assert reasons[1005] is None and reasons[1006] is None and reasons[1010] is None
    assert reasons[1009] is None and reasons[1013] is None and reasons[1014] is None and not {1007, 1008, None} & set(reasons)


def test_empty(spark):
    assert stuffed_pages(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_curve_values(spark):
    row = page_curves(spark.createDataFrame([(1, "a a a a b b c d"), (2, "x y z")], "i int, t string"), "i", "t").where("page = 1").first()
    import math

    import numpy as np

    f = np.array([4, 2, 1, 1])
    slope, inner = np.polyfit(np.log([1, 2, 3, 4]), np.log(f), 1)
    assert row["slope"] == pytest.approx(slope) and row["repetition"] == pytest.approx((4 * math.log(4) + 2 * math.log(2)) / 8)
    assert row["residual"] == pytest.approx(float(np.sqrt(np.mean((np.log(f) - slope * np.log([1, 2, 3, 4]) - inner) ** 2))))


def test_terms():
    family, counts = page_terms("x y\nx y\nlabel [one two](http://a.example/p) #t <a href='b.test/q'>three</a>")
    assert family == "latin" and counts == {"x": 1, "y": 1, "\x01again": 1, "two": 1, "three": 1, "\x01link": 4, "\x01tag": 1}
    assert page_terms(None) == ("none", {}) and page_terms("") == ("none", {})
