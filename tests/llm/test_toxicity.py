import pickle
import random
import zlib

import pytest

from strata.llm import toxicity
from strata.llm.toxicity import fit, op8_toxicity, score_documents, train


@pytest.fixture(scope="module")
def model():
    places = ("mill", "river", "house", "stones", "trees", "boats", "bridge")
    people = ("writer", "reader", "farmer", "driver", "keeper")
    bad = ("idiot", "moron", "worthless", "stupid")
    texts, labels = [], []
    for k in range(600):
        words = ["the", people[k % 5], "ran", "past", "the", places[k % 7], "and", "saw", "a", places[k // 7 % 7], "of", "note"]
        if k % 3 == 0:
            words[k % 12] = bad[k // 3 % 4]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return fit(texts, labels)


def test_restores_disguised_words(model):
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("w0rthl3ss", "worthless"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid")):
        assert model.restore(token) == word, token
    for text in ("you 1d10t", "such an i d i o t again", "m-o-r-o-n", "STUPIIIID"):
        assert model.score(text) >= 0.7, text
    for text in ("the old mill", "", None, "1234 5678", "%%% *** $$$", "a b c d e"):
        assert model.score(text) < 0.3, text


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op8_toxicity(spark, at).collect()}
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    labels = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{at}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(p == t for p, t in labels) >= 0.98 * len(labels)
    assert sum(p and t for p, t in labels) >= 0.85 * sum(t for _, t in labels)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "idiot", 0.5), (1, None, 0.1), (2, "", 0.2), (2, "x", None), (3, "ab " * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1, None), (1, None, 1), (2, 0, 0), (2, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or -1, r.predicted) for r in score_documents(docs, labels).collect()) == [(-1, 0), (1, 0), (2, 0), (2, 0), (3, 0)]
    assert score_documents(docs.limit(0), labels.limit(0)).collect() == []


def test_long_runs_and_tokens(model):
    spaced = " ".join("theoldmillbytheriver" * 12 + "youareanidiot" * 3)
    stretched = "stu" + "u" * 60 + "pid"
    parted = "i" + "-" * 60 + "d.i.o.t"
    glued = "the.old.mill.by.the.river.past.the.bridge.and.the.trees.you.1d10t"
    for text in (spaced, stretched, parted, glued):
        assert model.score(text) >= 0.7, text
    for text in (" ".join("theoldmillbytheriver" * 12), "the.old.mill.by.the.river.past.the.bridge.and.the.trees", "a" * 100_000, "-" * 100_000):
        assert model.score(text) < 0.3, text[:80]


def test_learns_from_all_labelled_rows(spark):
    own = [k for k in range(12_000) if zlib.crc32(str(k).encode()) % 3 != 1]
    texts = {k: f"the {'rotten' if k % 5 == 0 else 'old'} mill number w{k % 97} z{k % 7} by{'' if k % 11 else ' rotten'}" for k in own}
    documents = spark.createDataFrame([(k, texts[k]) for k in own], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in own], "doc_id long, toxic int")
    got, want = pickle.loads(train(documents, labels)), fit([texts[k] for k in own], [int(k % 5 == 0) for k in own])
    assert len(own) > 7_000 and got.weights == pytest.approx(want.weights) and got.trigrams == pytest.approx(want.trigrams)
    assert got.layer == pytest.approx(want.layer, rel=1e-6)


def test_filters_miss_nothing(model):
    """Batches are scored as each text is alone, and what the filters let go holds nothing to restore."""
    r = random.Random(3)
    texts = ["".join(r.choice("ab1 .-*\n\t$!_/\\'éñ€  ?x") for _ in range(r.randrange(14))) for _ in range(30_000)]
    texts += [None, "", "you i d i o t", "a m.o-r o n, x", "m-o-r-o-n", "STUPIIIID", "1d10t!", "i" + "-" * 60 + "d.i.o.t", "the old\x1cmill\u3000idiot"]
    lows = [(t or "").lower() for t in texts]
    parted = {k for k, t in enumerate(lows) if toxicity._PARTED.search(t)}
    assert parted and parted <= toxicity._may_part(lows)
    tokens = sorted({w for t in lows for w in t.split()})
    hides = dict(zip(tokens, toxicity._may_hide(tokens)))
    assert all(hides[t] for t in tokens if any(toxicity._SUSPECT.search(p) for p in toxicity._pieces(t)))
    words = [t.strip(toxicity._EDGE) for t in tokens] + list(model.weights) + [g.strip("^$") for g in model.weights]
    assert model.of_words(words) == [model.of_word(w) for w in words]
    assert model.scores(texts) == [model.score(t) for t in texts]


def test_texts_stay_where_they_are(spark, monkeypatch):
    """The labels go to the texts, whatever the size of the documents: no text is shuffled."""
    plans, keep = [], toxicity.Scratch.keep
    monkeypatch.setattr(toxicity.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    documents = spark.createDataFrame([(k, f"the {'rotten' if k % 5 == 0 else 'old'} mill w{k % 7}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that Spark finds large
    try:
        few = train(documents, labels)
        assert not any("SortMergeJoin" in p for p in plans)
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 10)
        many = train(documents, labels)
        assert any("SortMergeJoin" in p for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    a, b = pickle.loads(few), pickle.loads(many)
    assert a.weights == b.weights and a.trigrams == b.trigrams and a.layer == pytest.approx(b.layer)
