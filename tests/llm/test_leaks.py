import math
import random

from sargam.llm.leaks import alignment, leaked_items, leaks, reparameterised, words_of

ITEM = "Whoever studies the honest teacher will find that a field once recorded its rainy harmonium beside the threshold of 1952. Between stanza and childhood the writer places a solemn evening, softened often by strangers."
BENGALI = "আর নদী ঘরে রাতে পথে কোন দিনের গান শোনা যায় তবু মনে আসে সেই সুরের ছায়া। ভোরে পাখি ডাকে দূরে কেন বনে হাওয়া চলে আমার তোমার আকাশ জুড়ে।"


def found(spark, docs, items=((1, ITEM), (2, BENGALI))):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, item string, hash int")
    i = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {tuple(r) for r in leaks(d, "doc_id", "text", i, "item_id", "text").collect()}


def test_cases(spark):
    words = ITEM.split()
    changed = [w for k, w in enumerate(words) if k % 7 != 3]
    doubled = [x for k, w in enumerate(words) for x in ([w, w] if k % 6 == 1 else [w])]
    docs = [
        (1, "Before. " + ITEM + " After."), (2, "x " * 50 + " ".join(words[5:17])), (3, " ".join(words[5:12])), (4, "a b c " + " ".join(changed)), (5, " ".join(doubled).upper()),
        (6, " ".join(words[:16]) + " other text of quite some length in the middle here " + " ".join(words[16:])), (7, "<p>" + ITEM.replace(" ", "</b> <b>").replace("e", "е") + "</p>"),
        (8, "Whoever studies the silver market will find that a harvest once welcomed its light bridge beside the well of 1986. Between wall and bell the writer places a gentle lamp, wrapped slowly by strangers."),
        (9, BENGALI.replace(" ", "\n")), (9, BENGALI), (10, None), (11, ""), (None, ITEM), (12, "w " * 100_000 + ITEM), (13, "নদী " + BENGALI.replace("।", " , ")),
    ]
    assert found(spark, docs) == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (7, 1), (9, 2), (12, 1), (13, 2)}


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert leaked_items(spark.createDataFrame([(1, ITEM)], "d bigint, t string"), "d", "t", spark.createDataFrame([], "i bigint, t string"), "i", "t").count() == 0


QUESTION = "In the village of the river old Ramesh bought 12 mangoes and gave Sunita 5 of them, then Ramesh walked for 3 hours with the other 7 mangoes to the market and sold each for 12 rupees"


def test_slots_of_reparameterised_questions(spark):
    items = spark.createDataFrame([(1, QUESTION)], "i bigint, t string")
    other = QUESTION.replace("Ramesh", "Vikram").replace("12", "30").replace("Sunita", "Anjali").replace(" 5 ", " 8 ").replace(" 3 hours", " 9 days").replace(" 7 ", " 22 ").replace("mangoes", "lemons").replace("river", "lake").replace("market", "town")
    mixed = other.replace("for 30", "for 31")
    docs = spark.createDataFrame([(1, QUESTION), (2, "So. " + other), (3, mixed), (4, QUESTION.replace("12", "13"))], "d bigint, t string")
    rows = {r["doc"]: r for r in leaked_items(docs, "d", "t", items, "i", "t").collect()}
    assert (rows[1]["slots_changed"], rows[1]["consistent"], rows[1]["in_order"]) == (0, True, rows[1]["words"])
    assert rows[2]["slots"] == 10 and rows[2]["slots_changed"] == 9 and rows[2]["consistent"] and rows[2]["in_order"] < 0.75 * rows[2]["words"]
    assert not rows[3]["consistent"] and rows[4]["slots_changed"] == 2 and rows[4]["consistent"]
    assert {tuple(r) for r in leaks(docs, "d", "t", items, "i", "t").collect()} == {(1, 1), (4, 1)}
    assert {r["doc"] for r in reparameterised(docs, "d", "t", items, "i", "t").collect()} == {2, 4}


def edited(rng, words, share=0.75):
    """The words with as many changed, left out and doubled as a case may have, at regular or random places, perhaps interrupted."""
    lost = len(words) - math.ceil(share * len(words))
    every = rng.random() < 0.4
    at = set(range(rng.randrange(4), len(words), 4)) if every else set(rng.sample(range(len(words)), lost))
    at = set(sorted(at)[:lost])
    at -= {k for k in at if {k - 1, k - 2} <= at}  # the case is of single words: no three in a row
    out = []
    for k, w in enumerate(words):
        if k in at:
            if rng.random() < 0.6:
                out.append(f"zz{rng.randrange(99)}")
        else:
            out += [w, w] if rng.random() < 0.15 else [w]
    if rng.random() < 0.5:
        cut = rng.randrange(1, len(out))
        out = out[:cut] + [f"yy{rng.randrange(999)}" for _ in range(30)] + out[cut:]
    return out


def test_no_edit_within_the_definition_is_lost(spark):
    rng = random.Random(17)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "pi", "so", "du")]
    items = [(k, [rng.choice(vocabulary) for _ in range(n)]) for k, n in enumerate((4, 5, 7, 9, 12, 16, 20, 28, 30, 31, 33, 40, 48, 60, 75))]
    docs, want = [], set()
    for k, words in items:
        for _ in range(25):
            want.add((len(docs), k))
            docs.append((len(docs), " ".join(rng.sample(vocabulary, 5) + edited(rng, words)).title()))
        if len(words) >= 28:
            for _ in range(10):
                at, cut = rng.randrange(len(words) - 11), rng.randrange(1, 12)
                want.add((len(docs), k))
                docs.append((len(docs), " ".join(words[at : at + cut] + ["xx"] * rng.choice([0, 40]) + words[at + cut : at + 12])))
    d = spark.createDataFrame(docs, "d bigint, t string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "i bigint, t string")
    got = {tuple(r) for r in leaks(d, "d", "t", i, "i", "t").collect()}
    assert want <= got
    by_shuffle = leaked_items(d, "d", "t", i, "i", "t", index_limit=0)
    assert sorted(map(tuple, by_shuffle.collect())) == sorted(map(tuple, leaked_items(d, "d", "t", i, "i", "t").collect()))


def test_alignment_against_brute_force():
    """Equals the best chain over all places with one jump, worked out by trying all predecessors."""
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.choice("abcdefg") for _ in range(8)]
        doc = [rng.choice("abcdefgxyz") for _ in range(14)]
        places = {w: [j for j, x in enumerate(doc) if x == w] for w in set(doc)}
        best = {}
        for j, w in enumerate(doc):
            for i, v in enumerate(item):
                if v == w:
                    for jumps in (0, 1):
                        options = [best[i - a, j - b, jumps] for a in (1, 2, 3) for b in (1, 2, 3) if (i - a, j - b, jumps) in best]
                        options += [best[i - a, k, 0] for a in (1, 2, 3) for k in range(j) if jumps and (i - a, k, 0) in best]
                        best[i, j, jumps] = 1 + max(options, default=0)
        words, run = alignment(places, item)
        assert words == max(best.values(), default=0) and run <= words <= len(item)


def test_words():
    assert words_of("It&#39;s <b>ＯＫ</b>—নদী​র") == ["it", "s", "ok", "নদীর"]
