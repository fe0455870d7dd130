"""Strict readers: JSON lines, JSON documents, pinned files, ledgers, CSV forms, word boxes in XML, folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line, of exactly the schema; a line that does not fit ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, source_line from 1, line) of text files; numbers follow the place in the file, which one task reads whole."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    return text.select("file", F.posexplode("lines").alias("n", "line")).where("line <> ''").select("file", (F.col("n") + 1).alias("source_line"), "line")


def json_documents(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds ``document`` (VARIANT) and ``fault``: JSON with a repeated key, or with a number that is not finite, is at fault."""
    v = F.try_parse_json(column)
    odd = F.to_json(v).rlike("NaN|Infinity") | F.col(column).rlike(r"[0-9][eE]\+?[0-9]{3,}")
    return lines.withColumn("document", v).withColumn("fault", F.when(v.isNull(), "not strict JSON").when(odd, "not finite"))


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, content) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def pinned(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """What differs between files and their pins (name, bytes, sha256, lines): missing, unexpected, or changed."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    lines = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n")).cast("long") - 1
    have = binary(spark, path).select(name.alias("name"), F.col("bytes").alias("b"), F.col("sha256").alias("s"), lines.alias("l"))
    both = pins.join(have, "name", "full_outer")
    fault = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("bytes") != F.col("b")) | (F.col("sha256") != F.col("s")) | (F.col("lines") != F.col("l")), "changed")
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select("name", "fault")


def inventory(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are there but not expected, and expected ones (name) that are not there."""
    have = binary(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return have.join(expected, "name", "left_anti").select("name", F.lit("unexpected").alias("fault")).unionByName(expected.join(have, "name", "left_anti").select("name", F.lit("missing").alias("fault")))


def ledger_faults(lines: DataFrame) -> DataFrame:
    """Lines (file, source_line, line) of a hash-chained ledger that break it: no JSON, not canonical, out of sequence, or not chained to the line before."""
    w = Window.partitionBy("file").orderBy("source_line")
    v = F.try_parse_json("line")
    x = lines.withColumns({
        "seq": F.try_variant_get(v, "$.sequence", "bigint"), "previous": F.try_variant_get(v, "$.previous_record_sha256", "string"),
        "before": F.lag(F.sha2("line", 256)).over(w), "nth": F.row_number().over(w), "canonical": F.to_json(v) == F.col("line"), "ok": v.isNotNull(),
    })
    fault = F.when(~F.col("ok"), "not JSON").when(~F.col("canonical"), "not canonical").when(~F.col("seq").eqNullSafe(F.col("nth").cast("long")), "out of sequence").when(~F.col("previous").eqNullSafe(F.col("before")), "not chained")
    return x.withColumn("fault", fault).where("fault IS NOT NULL").select("file", "source_line", "fault")


def csv_form(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A form with exactly these columns in this order; another header or a ragged row ends the read."""
    header = spark.read.text(path).limit(1).collect()  # a form's header: one line
    if not header or header[0][0].lstrip("﻿").split(",") != columns:
        raise ValueError(f"the header must be {columns}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").option("multiLine", "true").option("escape", '"').csv(path)


def layout_words(pages: DataFrame, column: str = "xml") -> DataFrame:
    """Words of pages in bbox-layout XML: page, index, text, box, and where each starts in the page's text."""
    at = lambda a: F.expr(f"xpath({column}, '//word/@{a}')")
    words = F.arrays_zip(F.expr(f"xpath({column}, '//word/text()')").alias("text"), at("xMin").alias("x0"), at("yMin").alias("y0"), at("xMax").alias("x1"), at("yMax").alias("y1"))
    rows = pages.select("page_id", F.posexplode(words).alias("word_index", "w"))
    rows = rows.select("page_id", "word_index", F.col("w.text").alias("text"), *[F.col(f"w.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("page_id").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before).withColumn("end", F.col("start") + F.length("text"))


def page_faults(pages: DataFrame) -> DataFrame:
    """Words of native pages (page_id, text, words: array of text, bbox, span) whose span is not their text, or whose box is no box."""
    w = pages.select("page_id", "text", F.posexplode("words").alias("word_index", "w"))
    a, b = F.get("w.span", F.lit(0)), F.get("w.span", F.lit(1))
    box = [F.get("w.bbox", F.lit(k)) for k in range(4)]
    fault = F.when(F.substring("text", a.cast("int") + 1, (b - a).cast("int")) != F.col("w.text"), "span").when(~F.coalesce((box[2] >= box[0]) & (box[3] >= box[1]), F.lit(False)), "box")
    return w.withColumn("fault", fault).where("fault IS NOT NULL").select("page_id", "word_index", "fault")


def table_function(df: DataFrame, column: str, path: str) -> DataFrame:
    """Elements of a JSON array inside a document, as (key from 0, value JSON)."""
    items = F.from_json(F.get_json_object(column, path), "array<string>")
    return df.select("*", F.posexplode(items).alias("key", "value"))


def _tokens(text: str):
    """(pointer, source text) of every scalar of a JSON text, numbers as they are written; strict about keys, ends and surrogates."""
    out: list[tuple[str, str]] = []
    escape = lambda k: k.replace("~", "~0").replace("/", "~1")

    class Number(str):
        pass

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key repeats")
        return dict(items)

    def bad(x):
        raise ValueError(f"{x} is no JSON")

    def walk(v, at):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{at}/{escape(k)}")
        elif isinstance(v, list):
            for k, x in enumerate(v):
                walk(x, f"{at}/{k}")
        elif isinstance(v, Number):
            out.append((at, str(v)))
        else:
            if isinstance(v, str):
                v.encode()  # a lone surrogate is no text
            out.append((at, json.dumps(v, ensure_ascii=False)))

    walk(json.loads(text, object_pairs_hook=pairs, parse_int=Number, parse_float=Number, parse_constant=bad), "")
    return out


def lexical_tokens(documents: DataFrame, column: str = "document") -> DataFrame:
    """(document_id, pointer, token, fault) of JSON texts, numbers as written. Spark keeps no source text of numbers, hence Python, over Arrow batches."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            ids, pointers, tokens, faults = [], [], [], []
            for i, text in zip(batch.column("document_id").to_pylist(), batch.column(column).to_pylist()):
                try:
                    found = [(p, t, None) for p, t in _tokens(text or "")]
                except (ValueError, RecursionError) as e:
                    found = [(None, None, str(e)[:80])]
                for p, t, f in found:
                    ids.append(i)
                    pointers.append(p)
                    tokens.append(t)
                    faults.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *[pa.array(x, pa.string()) for x in (pointers, tokens, faults)]], names=["document_id", "pointer", "token", "fault"])

    return documents.select(F.col("document_id").cast("string").alias("document_id"), column).mapInArrow(rows, "document_id string, pointer string, token string, fault string")
