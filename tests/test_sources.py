import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strata.sources import readers as R
from strata.sources import writers as W


def test_json_lines_are_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert R.json_lines(spark, str(tmp_path / "a.jsonl"), "a long").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": "x"}\n')
    with pytest.raises(Exception):
        R.json_lines(spark, str(tmp_path / "b.jsonl"), "a long").collect()
    lines = R.numbered_lines(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.source_line, r.line) for r in lines] == [(1, '{"a": 1}'), (2, '{"a": 2}')]


def test_strict_documents(spark):
    texts = ['{"a":1}', '{"a":1,"a":2}', "{", '{"a":1e999}', "null"]
    got = R.json_documents(spark.createDataFrame([(t,) for t in texts], "line string")).select("fault").collect()
    assert [r.fault for r in got] == [None, "not strict JSON", "not strict JSON", "not finite", None]


def test_lexical_tokens(spark):
    docs = spark.createDataFrame([("1", '{"a":[1.0,"x",null],"b/c":1e2}'), ("2", '{"a":1,"a":2}'), ("3", "[1] 2"), ("4", "[NaN]")], "document_id string, document string")
    got = sorted((r.document_id, r.pointer, r.token) for r in R.lexical_tokens(docs).where("fault is null").collect())
    assert got == [("1", "/a/0", "1.0"), ("1", "/a/1", '"x"'), ("1", "/a/2", "null"), ("1", "/b~1c", "1e2")]
    assert R.lexical_tokens(docs).where("fault is not null").count() == 3


def test_ledger(spark, tmp_path):
    lines, before = [], None
    for k in range(1, 6):
        lines.append(json.dumps({"previous_record_sha256": before, "record_id": f"r{k}", "sequence": k}, separators=(",", ":")))
        before = hashlib.sha256(lines[-1].encode()).hexdigest()
    (tmp_path / "good").write_text("\n".join(lines) + "\n")
    assert R.ledger_faults(R.numbered_lines(spark, str(tmp_path / "good"))).collect() == []
    bad = [*lines[:2], lines[2].replace("r3", "rX"), lines[3], lines[4].replace(",", ", ")]
    (tmp_path / "bad").write_text("\n".join(bad) + "\n")
    assert [(r.source_line, r.fault) for r in R.ledger_faults(R.numbered_lines(spark, str(tmp_path / "bad"))).orderBy("source_line").collect()] == [(4, "not chained"), (5, "not canonical")]


def test_pins_and_inventory(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "a").write_text("x\ny\n")
    (d / "b").write_text("z\n")
    sha = hashlib.sha256(b"x\ny\n").hexdigest()
    pins = spark.createDataFrame([("a", 4, sha, 2), ("b", 2, "0" * 64, 1), ("c", 1, "0" * 64, 1)], "name string, bytes long, sha256 string, lines long")
    assert sorted((r.name, r.fault) for r in R.pinned(spark, str(d), pins).collect()) == [("b", "changed"), ("c", "missing")]
    assert [(r.name, r.fault) for r in R.inventory(spark, str(d), spark.createDataFrame([("a",), ("q",)], "name string")).orderBy("name").collect()] == [("b", "unexpected"), ("q", "missing")]


def test_csv_form(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in R.csv_form(spark, str(tmp_path / "f.csv"), ["a", "b"]).collect()] == [("1", "x\ny")]
    with pytest.raises(ValueError):
        R.csv_form(spark, str(tmp_path / "f.csv"), ["b", "a"])


def test_layout_words(spark):
    xml = '<doc><page width="9"><line><word xMin="1" yMin="2" xMax="3" yMax="4">ab</word><word xMin="5" yMin="2" xMax="6" yMax="4">c</word></line></page></doc>'
    got = R.layout_words(spark.createDataFrame([("p", xml)], "page_id string, xml string")).orderBy("word_index").collect()
    assert [(r.text, r.x0, r.y1, r.start, r.end) for r in got] == [("ab", 1.0, 4.0, 0, 2), ("c", 5.0, 4.0, 3, 4)]
    page = spark.createDataFrame([("p", "ab c", [("ab", [0.0, 0.0, 1.0, 1.0], [0, 2]), ("c", [1.0, 0.0, 0.0, 1.0], [3, 4]), ("x", [0.0, 0.0, 1.0, 1.0], [0, 1])])], "page_id string, text string, words array<struct<text:string,bbox:array<double>,span:array<int>>>")
    assert [(r.word_index, r.fault) for r in R.page_faults(page).collect()] == [(1, "box"), (2, "span")]


def test_table_function(spark):
    df = spark.createDataFrame([('{"views":[{"sha256":"x"},2]}',)], "v string")
    assert [(r.key, r.value) for r in R.table_function(df, "v", "$.views").collect()] == [(0, '{"sha256":"x"}'), (1, "2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, "a\n", 1.5)], "id long, b string, a double")
    receipt = W.write_verified(df, "id", str(tmp_path / "out")).collect()[0]
    assert receipt["rows"] == 2
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == '{"a":1.5,"b":"a\\n","id":1}\n{"a":null,"b":"é","id":2}\n'
    with pytest.raises(Exception):
        W.canonical_json_lines(df, "id", str(tmp_path / "out"))
    with pytest.raises(ValueError):
        W.verify_json_lines(spark, df.withColumn("b", F.lit("other")), str(tmp_path / "out"))
    W.csv_export(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").option("multiLine", "true").option("nullValue", "\\N").csv(str(tmp_path / "csv")).count() == 2
    child = spark.createDataFrame([(1,), (None,)], "p long")
    assert W.snapshot({"a": df, "c": child}, str(tmp_path / "snap"), [("c", "p", "a", "id")]) == {"a": 2, "c": 2}
    with pytest.raises(ValueError):
        W.snapshot({"a": df, "c": spark.createDataFrame([(9,)], "p long")}, str(tmp_path / "snap2"), [("c", "p", "a", "id")])
