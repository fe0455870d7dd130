import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strata.llm.packing import Ids, intervals, op2_packing, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows, limit):
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            want[(i, k // limit, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by), -(-sum(r.length for r in rows) // limit)


def test_whole_table(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    used, bound = check(docs, op2_packing(spark, tiny).collect(), 4096)
    assert used <= bound + 1


def test_plans_use_every_length():
    rng = random.Random(2)
    for _ in range(40):
        limit = rng.choice([8, 32, 100, 4096])
        counts = {rng.randint(1, limit): rng.choice([1, 2, 5, 1000]) for _ in range(rng.randint(0, 40))}
        templates = plan(counts, limit)
        used = Counter()
        for lengths, times in templates:
            assert times > 0 and sum(lengths) <= limit
            for n in lengths:
                used[n] += times
        assert used == Counter(counts)
        assert len(intervals(templates)) == sum(len(x) for x, _ in templates)
    assert plan({4096: 3, 4000: 5, 96: 5, 2000: 2, 1096: 2, 1000: 2}) and sum(t for _, t in plan({4000: 5, 96: 5, 2000: 2, 1096: 2, 1000: 2})) == 7


def test_ids_are_the_tokenizers():
    own = Ids(PATH)
    texts = ["I'm 'she'd it's", "a<|endoftext|>b", "İstanbul ΣΑΣ", "é é Ǆ", "x y\x1cz\x85", "12 345 ''re don't 'LL", "", None, "…—“q” €5 ½", "日本 語", "A" * 5000, "🙂!?"]
    assert list(own.of(texts)) == [own.whole(t or "") for t in texts]


def test_edges(spark):
    rows = [(None, None), (None, ""), (1, "one two"), (1, "one two"), (2, "word " * 700), (3, " \n")]
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, length int, part string")
    check(rows, pack(df, PATH, limit=64).collect(), 64)
    assert pack(df.limit(0), PATH).collect() == []


def test_all_exact_fills_are_used():
    counts = {60: 3, 59: 3, 2: 50, 23: 50, 29: 2, 7: 50, 3: 50, 41: 3, 47: 50, 56: 1, 1: 2, 32: 50, 9: 3, 35: 2, 30: 3, 21: 2, 12: 3, 44: 50, 8: 3, 34: 50, 51: 2, 57: 2, 5: 2}
    assert sum(n for _, n in plan(counts, 60)) == 219  # 220 with one pair for each shortest member
