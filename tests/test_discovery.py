from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.operators import addressed as A
from strata.operators import discovery as D
from strata.streaming.append_once import append_once, conflicts, windowed_counts

PAGE = """<html><body><h1>Reportes</h1><span class="current">1</span><a href="/page/2/">2</a><a rel="next" href="/page/2/">»</a>
<article><a href="/doc/reporte-269/">Reporte de conflictos sociales n.° 269 – julio 2026</a><a href="/up/Reporte-269.pdf">PDF</a><p>Publicado: 13/08/2026</p></article>
<article><a href="/doc/otros/">Informe sobre derechos</a></article><footer>Reporte de conflictos sociales n.° 1</footer></body></html>"""


def test_records(spark):
    df = spark.createDataFrame([("https://x.org/page/1/", "catalogue", PAGE), ("https://x.org/page/2/", "catalogue", "<p>nothing</p>")], "page_url string, page_role string, html string")
    got = D.parse_pages(df).orderBy("page_url").collect()
    r = got[0]
    assert (r.number, r.period, r.date, r.next_url) == (269, "2026-07", "13/08/2026", "https://x.org/page/2/")
    assert r.title == "Reporte de conflictos sociales n.° 269 – julio 2026"
    assert [(x.url, x.role) for x in r.links] == [("https://x.org/doc/reporte-269/", "landing_page"), ("https://x.org/up/Reporte-269.pdf", "direct_download")]
    assert (got[1].scope, got[1].next_url) == (None, None)


def test_numbers_periods_and_dates(spark):
    rows = [
        ("Reporte de conflictos sociales N° 12", 12, None, None), ("reporte 2019", None, None, None), ("Conflictos sociales N 57", 57, None, None), ("Reporte n.° 117", 117, None, None),
        ("13 de agosto de 2026, julio 2026", None, "2026-07", None), ("Reporte 7 julio 2026", 7, "2026-07", None), ("2004 junio", None, "2004-06", None), ("2004 junio 12", None, None, None),
        ("Reporte Mensual N° 112 – Jun-2013", 112, "2013-06", None), ("Reporte N° 206 Abril -2021", 206, "2021-04", None), ("Reporte N° 23 - Enero 2006", 23, "2006-01", None),
        ("Reporte Mensual N° 31 Junio 2006", 31, "2006-06", None), ("junio – 2008", None, "2008-06", None), ("7 junio 2008", None, None, None), ("el 7 de junio 2008; mayo 2009", None, "2009-05", None),
        ("lunes, 13 julio 2026", None, None, "lunes, 13 julio 2026"), ("julio 13, 2026", None, None, "julio 13, 2026"), ("julio 13, 2026 y 01/02/2003", None, None, "01/02/2003"), ("julio de 2026", None, None, None), (None, None, None, None), ("", None, None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    c = F.col("t")
    got = df.select(c, S.report_number(c), S.reference_period(c), S.date_text(c)).collect()
    assert [tuple(r) for r in got] == rows


def test_walk(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", None)], "page_url string, next_url string")
    assert [(r.page_url, r.stop) for r in D.walk(links, "a", 10).orderBy("place").collect()] == [("a", None), ("b", None), ("c", "repeated_url")]
    assert [r.stop for r in D.walk(links, "a", 2).orderBy("place").collect()] == [None, "page_cap"]
    assert D.walk(links, "z", 5).collect()[0].stop == "no_next_link"


def test_addressed_cells(spark):
    doc = '{"tables":[{"cells":[["a",null,""],[0,false,"0"],["x"]]}]}'
    cells = A.cells_of(spark.createDataFrame([("i", doc)], "input_id string, document string"))
    plan = spark.createDataFrame([("i", 0, 0, 2, [(0, "f"), (1, "g"), (2, "h")]), ("j", 0, 0, 0, [(0, "f")])], "input_id string, table_index int, first_row int, last_row int, columns array<struct<column:int,field:string>>")
    got = A.extract(plan, cells, spark.createDataFrame([("i",)], "input_id string"))
    assert [(r.row, r.column, r.status) for r in got.where("input_id = 'i'").orderBy("row", "column").collect()] == [(0, 0, "text"), (0, 1, "null"), (0, 2, "empty"), (1, 0, "number"), (1, 1, "boolean"), (1, 2, "text"), (2, 0, "text"), (2, 1, "missing"), (2, 2, "missing")]
    assert {r.input_id: r.state for r in A.accounting(got).collect()} == {"i": "partial", "j": "unprocessed"}


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0].x


def test_scalars(spark):
    import uuid

    c = F.col
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("a", "ñ b", ""):
        assert one(spark, S.uuid5(space, c("v")), v=name) == str(uuid.uuid5(uuid.UUID(space), name))
    assert one(spark, S.normalize_url(c("v")), v="HTTPS://Ex.ORG.:443/a?utm_source=x&b=1#f") == "https://ex.org/a?b=1"
    assert one(spark, S.normalize_url(c("v")), v="https://u:p@ex.org/") is None
    assert one(spark, S.acquisition_url(c("v"), ["ex.org"]), v="https://ex.org/a b/é.pdf") == "https://ex.org/a%20b/%C3%A9.pdf"
    assert one(spark, S.acquisition_url(c("v"), ["ex.org"]), v="https://ex.org/a/../b") is None
    assert one(spark, S.report_number(c("v")), v="Reporte de conflictos sociales N.º 117") == 117
    assert one(spark, S.reference_period(c("v")), v="13 de agosto de 2026 y julio 2026") == "2026-07"
    assert one(spark, S.date_text(c("v")), v="el 3 de mayo de 2020 o 13/08/2026") == "13/08/2026"
    assert one(spark, S.qualified_whitespace(c("v")), v="a \n b") == "a b" and one(spark, S.qualified_whitespace(c("v")), v="1 2") is None and one(spark, S.qualified_whitespace(c("v")), v="a\tb") is None
    assert one(spark, S.occurrences(c("t"), c("p")), t="12 a 12.5 (12) 112", p="12") == [0, 11]
    assert one(spark, S.fold(c("v")), v="  ÁÉ ß ") == "ae ss"
    assert one(spark, S.clean_text(c("v")), v=" a  b\n") == "a b"
    assert one(spark, S.retry_after(c("v"), F.lit("2026-01-01 00:00:00").cast("timestamp")), v="120") == 120.0
    assert one(spark, S.retry_after(c("v"), F.lit("2026-01-01 00:00:00").cast("timestamp")), v="Thu, 01 Jan 2026 00:01:00 GMT") == 60.0
    assert one(spark, S.resolve(c("v"), "/a/1"), v='{"a":[1,"x"]}') == '"x"' and one(spark, S.resolve(c("v"), "/b~1c"), v='{"b/c":0}') == "0"
    assert [one(spark, S.strictly_equal(c("a"), c("b")), a=a, b=b) for a, b in (("0", "0"), ("0", "false"), ('"0"', "0"), ('{"a":1,"b":2}', '{"b":2,"a":1}'))] == [True, False, False, True]
    assert [one(spark, S.typed_value(c("v"), c("k")), v=v, k=k) for v, k in (('a"b', "string"), ("1.5", "number"), ("x", "number"), ("true", "boolean"), ('{"b":1,"a":2}', "json"))] == ['"a\\"b"', "1.5", None, "true", '{"a":2,"b":1}']
    assert one(spark, S.span_is(c("t"), F.lit(1), F.lit(3), c("p")), t="añbc", p="ñb") is True
    assert one(spark, S.is_period(c("v")), v="2020-13") is False
    assert one(spark, S.reorder(F.array(*map(F.lit, "abc")), F.array(F.lit(2), F.lit(0)))) == ["c", "a"]
    assert one(spark, S.host_class(c("v"), ["a.org"], ["b.org"]), v="https://b.org/x") == "pending_review"
    assert one(spark, S.canonical_json(c("b").alias("b"), c("a").alias("a")), a=1, b="é") == '{"a":1,"b":"é"}'


def test_streams(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.union(df.limit(50)).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def drain(out, mode):
        q = out.writeStream.format("memory").queryName(f"strata_{mode}_{len(out.columns)}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{len(out.columns)}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(f"strata_{mode}_{len(out.columns)}").collect()

    assert len(drain(append_once(stream(), "event_id", "ts"), "append")) == df.count()
    got = drain(windowed_counts(stream(), "ts", "event_type"), "append")
    assert 0 < sum(r.n for r in got) <= df.count() + 50
    assert conflicts(df.union(df.withColumn("value", F.lit(-1.0)).limit(3)), "event_id").count() == 3
