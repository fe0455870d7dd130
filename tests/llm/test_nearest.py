import numpy as np

from strata.llm.nearest import neighbours, op7_nearest


def brute(rows, every=100, k=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in sorted(good):
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(b) - np.array(a)) ** 2).sum())), i) for i, b in good if (i, b) != (q, a) and len(b) == len(a))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return out


def recall(got, want):
    """The share of the true neighbours found, a farther one at the same distance counting as one."""
    by, hit, n = {}, 0, 0
    for q, _, i, d in got:
        by.setdefault(q, []).append((d, i))
    for q, _, i, d in want:
        n += 1
        hit += any(abs(d - x) <= 1e-9 and i == j for x, j in by.get(q, ()))
    return hit / max(n, 1)


def rows_of(df):
    return [(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()]


def test_recall_on_whole_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        got = rows_of(op7_nearest(spark, f"/root/testdata/{sf}"))
        want = brute(rows)
        assert len(got) == len(want)
        assert recall(got, want) >= 0.95


def test_recall_across_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(rows_of(neighbours(df, every=20, rows=300, queries=30)), brute(kept, 20)) >= 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (100, [5.0, 5.0]), (200, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id long, embedding array<float>, own int, rank string")
    assert sorted(rows_of(neighbours(df))) == sorted(brute(rows))
    assert neighbours(df.limit(0)).collect() == []
    many = spark.createDataFrame([(i, [2.0, 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    got = rows_of(neighbours(many, rows=64))
    assert sorted(r[2] for r in got if r[0] == 100) == list(range(10)) and all(r[3] == 0 for r in got)
