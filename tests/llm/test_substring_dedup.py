import hashlib
import random
import re
from collections import defaultdict

from strata.llm.substring_dedup import op4_substring_dedup, remove_repeats


def brute(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i, s: (i is not None, i or 0, s)
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, key(i, s)), key(i, s))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key(i, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    assert sum(x[2] for x in want) > 0
    assert rows_of(op4_substring_dedup(spark, tiny)) == want


def test_random_overlaps(spark):
    rng = random.Random(3)
    passages = [[rng.choice("abcde") for _ in range(rng.randint(3, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a:] if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200, "x " * 90), (201, "x " * 40), (202, "é ß " * 12)]
    for window, anchor in ((5, 2), (8, 3), (6, 6)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert rows_of(remove_repeats(df, window, anchor)) == brute(rows, window)


def test_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr("strata.llm.common.LEAST_BLOCKS", 5)
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        passages = [[rng.choice("ab" if seed == 3 else "abcd") for _ in range(rng.randint(3, 30))] for _ in range(8)]
        rows = []
        for i in range(120):
            parts = []
            for _ in range(rng.randint(0, 5)):
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                parts += p[a : rng.randint(a, len(p))]
            rows.append((rng.choice([i, i // 2, None]), " ".join(parts)))
        for window, anchor in ((4, 2), (7, 3)):
            df = spark.createDataFrame(rows, "doc_id long, text string")
            assert rows_of(remove_repeats(df, window, anchor)) == brute(rows, window)


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(30))
    rows = [(None, p), (1, None), (1, ""), (2, p), (2, p), (3, " \t\n"), (4, "a " + p), (5, p.upper())]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, h string")
    assert rows_of(remove_repeats(df)) == brute(rows, 20)
    assert remove_repeats(df.limit(0)).collect() == []


def test_a_copy_and_another_text_share_an_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 0, sha(a)), (2, 30, sha("")), (2, 0, sha(b))])


def test_many_copies_of_a_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(25)) for x in "ab")
    rows = [(i, a if i % 3 else b) for i in range(7, 400)] + [(3, f"{a} {b}"), (None, "z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(remove_repeats(docs)) == brute(rows, 20)
