import random
import re

import numpy as np
import xxhash

from strata.llm.simhash import chains_hold, near_copies, op6_simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    own = sorted(set(fps))
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            r = find(f)
            least[r] = min(least.get(r, i), i)
    return [(i, f, least.get(find(f))) for i, f in zip(ids, fps)]


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    want = groups([d.doc_id for d in docs], [fingerprint(d.text) for d in docs])
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op6_simhash(spark, tiny).collect())
    assert got == sorted(want)
    assert len({x[2] for x in want}) < len(want)


def test_links_of_planted_fingerprints(spark, monkeypatch):
    from strata.llm import simhash
    from strata.llm.common import Scratch
    from strata.llm.components import connected

    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set()
    for s in seeds:
        for _ in range(12):
            x = s
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = {f: c for _, f, c in groups(fps, fps)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    for hot in (4096, 1):
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        edges = simhash._index(df, hot).repartition("key").sortWithinPartitions("key").mapInArrow(simhash._edge_rows(3), "a long, b long")
        roots = {r.node: r.root for r in connected(edges, Scratch(spark)).collect()}
        mine = {}
        for f, s in zip(fps, signed):
            mine.setdefault(roots.get(s, s), set()).add(f)
        theirs = {}
        for f in fps:
            theirs.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_chains_never_prune_a_link():
    rng = random.Random(1)
    xs = [sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 1, 2, 3) for _ in range(300)]
    assert chains_hold(np.array(xs, np.uint64)).all()
    far = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    assert not chains_hold(far).all()


def test_edges(spark):
    rows = [(None, None), (3, ""), (4, " \n"), (5, "One two"), (6, "one TWO"), (6, "one two"), (None, "a b c d"), (7, "É a b c"), (8, "x " * 5000)]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, key int, fp string")
    got = [(r.doc_id, r.fp, r.component_id) for r in near_copies(df).collect()]
    want = groups([i for i, _ in rows], [fingerprint(t) for _, t in rows])
    want = [(i, int(np.uint64(f).view(np.int64)), c) for i, f, c in want]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_copies(df.limit(0)).collect() == []
