import re
from collections import Counter

import corpus_pipeline
from strata.llm.decontamination import flags
from strata.llm.simhash import near_copies
from strata.llm.toxicity import score_documents

from .test_packing import check
from .test_substring_dedup import brute as brute_repeats


def test_stages_against_their_operators(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns

    def stage(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, tiny)
        assert k == 4 or out.columns == columns
        return out.cache()

    rows = lambda df: Counter(tuple(r) for r in df.collect())
    one = stage(0, docs)
    bad = {r.doc_id for r in score_documents(docs, spark.read.parquet(f"{tiny}/labels.parquet")).collect() if r.predicted}
    assert rows(one) == Counter({r: n for r, n in rows(docs).items() if r[0] not in bad})
    two = stage(1, one)
    first = {r.component_id for r in near_copies(one).collect()}
    assert rows(two) == Counter({r: n for r, n in rows(one).items() if r[0] in first}) and two.count() < one.count()
    three = stage(2, two)
    want = {i: (n, sha) for i, _, n, sha in brute_repeats([(r.doc_id, r.text) for r in two.collect()], 20)}
    before = {r.doc_id: r for r in two.collect()}
    assert three.count() == two.count()
    for r in three.collect():
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
        assert len(words(before[r.doc_id].text)) - len(words(r.text)) == want[r.doc_id][0]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        assert want[r.doc_id][0] or r.text == before[r.doc_id].text
    four = stage(3, three)
    leaks = {r.doc_id for r in flags(three, spark.read.parquet(f"{tiny}/benchmark.parquet")).collect() if r.contaminated}
    assert rows(four) == Counter({r: n for r, n in rows(three).items() if r[0] not in leaks})
    five = stage(4, four)
    used, bound = check([(r.doc_id, r.text) for r in four.collect()], five.collect(), 4096)
    assert used <= bound + 1


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0


def test_stages_with_odd_rows(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(None, text, "en", None, 1, "q"), (1, text, None, "s", None, "q"), (1, text, None, "s", None, "q"), (2, None, "en", "s", 0, "q"), (3, "", "en", "s", 0, None), (4, "other words here", "en", "s", 3, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, str(tmp_path)).cache()
            assert now.columns == docs.columns
        assert sorted(r.doc_id for r in now.collect()) == ([] if empty else [1, 2, 4])
