import pytest

from strata.llm.licenses import ORACLE_SQL, TEMPLATES, heavy, op10_licenses, scan, vectors
from tests.oracle import agree


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    at = f"/root/testdata/{sf}"
    df = op10_licenses(spark, at).cache()
    agree(df, ORACLE_SQL, at)
    kinds = {r.origin: r["count"] for r in df.groupBy("origin").count().collect()}
    assert kinds.get("own", 0) > 0 and kinds.get("inherited", 0) > 0


def run(spark, rows):
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, line int")
    return sorted(((r.path, r.license, r.origin, r.directory) for r in scan(df).collect()), key=str)


def test_nearest_ancestor(spark):
    apache = "# Copyright 2020\n# " + TEMPLATES[0][1] + ".\n\nimport x"
    rows = [("LICENSE", "Released under the MIT License."), ("a/b/COPYING", TEMPLATES[4][1]), ("a/b/c/x.py", "print(1)"), ("a/y.py", ""), ("a/b/z.py", apache), ("ab/q.py", None), ("top.py", "words " * 30)]
    assert run(spark, rows) == [
        ("LICENSE", "MIT", "own", None), ("a/b/COPYING", "GPL-3.0", "own", None), ("a/b/c/x.py", "GPL-3.0", "inherited", "a/b"),
        ("a/b/z.py", "Apache-2.0", "own", None), ("a/y.py", "MIT", "inherited", ""), ("ab/q.py", "MIT", "inherited", ""), ("top.py", "MIT", "inherited", ""),
    ]


def test_edges(spark):
    rows = [(None, "Released under the MIT License."), (None, None), ("a/x", "w " * 100_000), ("a/x", "Released under the MIT License."), ("a/x", "Released under the MIT License."), ("b//c", ""), ("", "text")]
    got = run(spark, rows)
    assert got == sorted([(None, "MIT", "own", None), (None, None, "none", None), ("a/x", None, "none", None), ("a/x", "MIT", "own", None), ("a/x", "MIT", "own", None), ("b//c", None, "none", None), ("", None, "none", None)], key=str)
    df = spark.createDataFrame([("a", "b")], "path string, text string")
    assert scan(df.limit(0)).collect() == []


def test_heavy_words_lose_no_match():
    weight = {w: 1.0 + len(w) % 3 for _, t in TEMPLATES for w in __import__("strata.llm.licenses", fromlist=["x"])._plain_words(t)}
    vs = vectors(TEMPLATES, weight)
    needed = set(heavy(vs, 0.6))
    for v in vs:
        rest = {w: x for w, x in v.items() if w not in needed}
        assert sum(x * x for x in rest.values()) ** 0.5 < 0.6


def test_common_words_outside_the_templates_weigh_little(spark):
    line = "Copyright 2024 The Example Authors and Contributors. All rights reserved."
    rows = [("a/x", line)] + [(f"b/{k}", "copyright 2024 the example authors and contributors of this text") for k in range(60)] + [(f"c/{k}", "nothing of note") for k in range(20)]
    got = dict((p, (name, origin)) for p, name, origin, _ in run(spark, rows))
    assert got["a/x"] == ("Proprietary", "own")
    assert all(got[f"b/{k}"][1] == "none" for k in range(60))
