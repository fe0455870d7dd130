import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm.context_tree import _Lookup, log_kt, op1_context_tree, score_texts


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())


class Tree:
    """Context-tree weighting by the book: dictionaries and recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for t in texts:
            for context, bits in self.steps(t):
                for prefix, bit in bits:
                    for d in range(depth + 1):
                        c = context[depth - d :]
                        self.counts[c, prefix, bit] += 1
                        if d:
                            self.children.setdefault((c[1:], prefix), set()).add(c)
        self.memo = {}

    def steps(self, t):
        s = b"\xff" * self.depth + b" ".join(words(t)) + b"\xff"
        for k in range(self.depth, len(s)):
            yield s[k - self.depth : k], [((1 << j) | (s[k] >> (8 - j)), s[k] >> (7 - j) & 1) for j in range(8)]

    def n(self, c, prefix):
        return self.counts[c, prefix, 0], self.counts[c, prefix, 1]

    def log_weighted(self, c, prefix):
        if (c, prefix) not in self.memo:
            a, b = self.n(c, prefix)
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(c) == self.depth:
                self.memo[c, prefix] = own, 1.0
            else:
                below = sum(self.log_weighted(x, prefix)[0] for x in self.children.get((c, prefix), ()))
                both = np.logaddexp(own, below) - math.log(2)
                self.memo[c, prefix] = both, math.exp(own - math.log(2) - both)
        return self.memo[c, prefix]

    def one(self, context, prefix):
        total, left, last = 0.0, 1.0, 0.5
        for d in range(self.depth + 1):
            c = context[self.depth - d :]
            a, b = self.n(c, prefix)
            if not a + b:
                return total + left * last
            last, w = (b + 0.5) / (a + b + 1), self.log_weighted(c, prefix)[1]
            total, left = total + left * w * last, left * (1 - w)
        return total

    def score(self, t):
        out = 0.0
        for context, bits in self.steps(t):
            for prefix, bit in bits:
                p = self.one(context, prefix)
                out += math.log10(p if bit else 1 - p)
        return out


def brute(rows, depth):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held) if not h]
    tree = Tree(train, depth)
    count = Counter(w for t in train for w in words(t))
    total, distinct, ends = sum(count.values()) + len(train), len(count) + bool(train), len(train)
    scores = {t: tree.score(t) for _, t in rows}
    for (i, t), h in zip(rows, held):
        c = [count[w] for w in words(t)] + [ends]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (distinct + 1))) for x in c)
        yield i, h, len(c), sum(x > 0 for x in c), total, base, scores[t]


def same(df, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    want = sorted(want, key=lambda r: (str(r[0]), r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-7)


def test_brute_force(spark, tiny):
    rows = [(r.doc_id, (r.text or "")[:400]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()][:60]
    rows += [(None, None), (1, ""), (1, " \n"), (7, "é ß \U0001f642 日本"), (7, "é ß \U0001f642 日本"), (8, "Aa aA AA")]
    df = spark.createDataFrame([(i, t, 3.0, "x") for i, t in rows], "doc_id long, text string, score double, block string").repartition(3)
    for depth in (2, 4):
        same(score_texts(df, depth), list(brute(rows, depth)))


def test_probabilities_sum_to_one():
    texts = ["abab abba", "ab ba ab", ""]
    tree = Tree(texts, 3)
    for context in (b"\xff\xff\xff", b"aba", b"zzz"):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for j in range(8):
                one = tree.one(context, (1 << j) | (byte >> (8 - j)))
                p *= one if byte >> (7 - j) & 1 else 1 - one
            total += p
        assert total == pytest.approx(1.0)


def test_whole_table_beats_its_base(spark):
    rows = op1_context_tree(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.96 * sum(r.base_score for r in held)


def test_edges(spark):
    df = spark.createDataFrame([(7, "a b"), (7, None)], "doc_id long, text string")
    held = df.where("doc_id is null").union(spark.createDataFrame([(None, "a b")], "doc_id long, text string"))
    assert score_texts(df.limit(0)).collect() == []
    same(score_texts(held, 3), list(brute([(None, "a b")], 3)))


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    table = _Lookup(keys, np.arange(len(keys)).astype(float))
    values, has = table.of(keys)
    assert has.all() and (values == np.arange(len(keys))).all()
    assert not table.of(keys + 1)[1][~np.isin(keys + 1, keys)].any()
    assert np.allclose(log_kt(np.array([0.0, 3.0]), np.array([0.0, 2.0])), [0.0, math.lgamma(3.5) + math.lgamma(2.5) - math.lgamma(6) - math.log(math.pi)])
