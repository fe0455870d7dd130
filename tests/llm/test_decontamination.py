import pytest

from strata.llm import decontamination
from strata.llm.decontamination import ORACLE_SQL, flags, op9_decontamination
from tests.oracle import agree

ITEM = "A farmer called Adam sells 12 apples and 30 pears on monday for 3.5 euros , then Adam gives 12 apples to Berta who pays nothing"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    at = f"/root/testdata/{sf}"
    df = op9_decontamination(spark, at)
    assert agree(df, ORACLE_SQL, at) > 0
    assert df.where("contaminated").count() > 0


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, item_id string, at int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.contaminated, r.n_items, r.item_id) for r in flags(docs, bench).collect()), key=str)


def test_reparameterised_questions(spark):
    other = ITEM.replace("Adam", "Carla").replace("12", "70").replace("30", "8").replace("3.5", "9").replace("Berta", "Denis")
    broken = ITEM.replace("then Adam gives 12", "then Emil gives 45")
    merged = ITEM.replace("30", "12")
    texts = [(1, "Before this. " + ITEM + " and more"), (2, "x y " + other + "\nend."), (3, broken), (4, merged), (5, ITEM.lower()), (6, "A farmer called nobody")]
    assert run(spark, texts, [(7, ITEM)]) == [(1, True, 1, 7), (2, True, 1, 7), (3, False, 0, None), (4, True, 1, 7), (5, True, 1, 7), (6, False, 0, None)]


def test_edges(spark):
    plain = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(None, plain), (1, None), (1, ""), (1, plain), (2, plain), (2, plain), (3, "b " * 50_000), (4, "one two three")]
    items = [(None, plain), (5, plain), (5, plain), (4, plain), (6, None), (7, ""), (8, "one two three"), (9, "1 2 3 4 5 6 7 8 9 10")]
    want = [(None, True, 4, 4), (1, False, 0, None), (1, False, 0, None), (1, True, 4, 4), (2, True, 4, 4), (2, True, 4, 4), (3, False, 0, None), (4, True, 1, 8)]
    assert run(spark, texts, items) == sorted(want, key=str)
    assert run(spark, texts[:1], [])[0][1] is False


def test_names_at_sentence_starts(spark):
    tom = "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have?"
    sam = tom.replace("Tom", "Sam").replace("3", "4").replace("5", "9")
    assert [r[1] for r in run(spark, [(1, sam), (2, sam.replace("Sam buys", "Ann buys"))], [(7, tom)])] == [True, False]


def test_case_and_merged_values(spark):
    texts = [(1, "say " + ITEM.lower()), (2, ITEM.upper()), (3, ITEM.replace("30", "12"))]
    assert [r[1] for r in run(spark, texts, [(7, ITEM)])] == [True] * 3


def test_short_and_placeholder_heavy_items(spark):
    sum_ = "Compute 12 * 7 + 5 - 3 * 14 / 2 + 9 = ?"
    texts = [(1, "x " + sum_ + " y"), (2, "so what is nine times six ?"), (3, "nine times"), (4, sum_.replace("14", "15"))]
    assert [r[1] for r in run(spark, texts, [(7, sum_), (8, "What is nine times six")])] == [True, True, False, False]


def test_long_verbatim_run(spark):
    item = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(59)]
    texts = [(1, "x " + " ".join(item[10:30]) + " y"), (2, " ".join(item[10:29]))]
    assert [r[1] for r in run(spark, texts, [(7, " ".join(item))])] == [True, False]


def test_windows_are_told_by_their_words(spark):
    texts = ["", "a", "a b", "a b a b a b a b a b a b", "b a b c a b c a b c d e f", " ".join("abcdefghij"), " ".join("abcdefghij")[2:]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("filter(split(text, ' '), w -> w <> '') AS w")
    for n in range(1, 10):
        words = {}
        for r in decontamination._hashed(df, "h", "w", n).collect():
            own = [tuple(r.w[k : k + n]) for k in range(len(r.w) - n + 1)]
            assert len(own) == len(r.h)
            for window, h in zip(own, r.h):
                assert words.setdefault(window, h) == h
        assert len(set(words.values())) == len(words) > 0


def test_words_are_built_once(spark, monkeypatch):
    """A document's words are replaced and lower-cased once, not anew for each step that reads them."""
    plans, keep = [], decontamination.Scratch.keep
    monkeypatch.setattr(decontamination.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df))
    assert [r[1] for r in run(spark, [(1, ITEM)], [(7, ITEM)])] == [True]
    assert [p.count("lower(") for p in plans if "lower(" in p] == [1, 1]  # of the items and of the documents


def test_capitals_beyond_the_basic_plane(spark):
    df = spark.createDataFrame([("the 𝐀bc ran . 𝐀bc sat",)], "text string")
    assert decontamination.valued(df).first().valued == "the \x01𝐀bc ran \x05𝐀bc sat"
