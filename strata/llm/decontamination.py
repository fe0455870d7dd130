"""Benchmark passages in documents, re-parameterised ones included, by template canonicalisation.

Numbers, units after numbers, and names (capitalised words inside a sentence,
and the same words where a sentence starts) become typed placeholders; the
lower-cased words are looked up as they are, too.  Windows of ``window`` consecutive template words of
the benchmark meet those of the documents in a hash join.  Where an item has
placeholders, the values that its slots take in the document must be
consistent: one value of the item always becomes the same value.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Template words of a window.
WINDOW = 8
#: Words of a window that must not be placeholders.
LITERAL = 4
#: Consecutive words of an item from which a document contains the item, whatever their share.
RUN = 20
#: Share of an item's windows from which a document contains the item.
SHARE = 0.5
#: Rows up to which the benchmark's windows, or the documents to look at again, are sent to all tasks; beyond, joins shuffle.
BROADCAST_ROWS = 400_000

# Units of measure, as words after a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles g gram grams kg kilogram kilograms mg lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh kph c f k celsius fahrenheit kelvin dollar dollars usd euro euros eur gbp cent cents percent % b kb mb gb tb hz khz mhz ghz w kw v a j n pa"
).split()

#: Kinds of windows: typed placeholders, those with known names at sentence starts as well, and lower-cased words.
_TYPED, _KNOWN, _PLAIN = 0, 1, 2

_NAME, _NUMBER, _UNIT, _POINT, _START = "\x01", "\x02", "\x03", "\x04", "\x05"
# What decides at most places stands first; the look behind comes after it.
_START_AT = rf"((?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{_NAME}])\p{{Lu}}[\p{{L}}\p{{N}}]*)"
_NAME_AT = rf"{_START}(?=\p{{Lu}}\p{{Ll}})(?<=[^.!?:…\x20\x09-\x0D][\x20\x09-\x0D]{_START})"
_POINT_AT = r"(?<=\p{N})[.,:/](?=\p{N})"
_NUMBER_AT = rf"(\p{{N}}[\p{{N}}{_POINT}]*)"
_SLOT_AT = rf"(?<![^ ])([{_NAME}-{_UNIT}])[^ ]*"


def valued(df: DataFrame) -> DataFrame:
    """Adds valued, the words of ``text``, lower-cased and parted by one blank; each placeholder is its mark and what it stands for, a capitalised word that may start a sentence is marked, too."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), _START_AT, f"{_START}$1")
    df = df.withColumn("t", F.lower(F.regexp_replace(t, _NAME_AT, _NAME)))  # a column of its own, or each use would build it anew
    t = F.col("t")
    words = lambda t: F.regexp_replace(t, rf"[^a-z\p{{L}}\p{{N}}%{_NAME}-{_START}]+", " ")
    n = F.regexp_replace(F.regexp_replace(t, _POINT_AT, _POINT), _NUMBER_AT, f" {_NUMBER}$1 ")
    n = F.concat(words(n), F.lit(" "))
    n = F.regexp_replace(n, rf"({_NUMBER}[^ ]* +)({'|'.join(UNITS)}) ", f"$1{_UNIT}$2 ")
    n = F.regexp_replace(n, " +", " ")
    return df.withColumn("valued", F.trim(F.when(t.rlike(r"\p{N}"), n).otherwise(words(t)))).drop("t")  # few texts pay for the steps on numbers


def _is_slot(w: Column) -> Column:
    return F.substring(w, 1, 1).isin(_NAME, _NUMBER, _UNIT)


def templates(df: DataFrame) -> DataFrame:
    """Replaces valued by plain (the words alone), template (names inside sentences are placeholders) and known (words that are such names are placeholders where sentences start, too)."""
    v = F.col("valued")
    split = lambda t: F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))
    df = df.withColumn("plain", split(F.translate(v, _NAME + _NUMBER + _UNIT + _START, "")))
    df = df.withColumn("template", F.when(v.rlike(f"[{_NAME}-{_UNIT}]"), split(F.translate(F.regexp_replace(v, _SLOT_AT, "$1"), _START, ""))).otherwise(F.col("plain")))
    df = df.withColumn("own", F.when(v.contains(_NAME) & v.contains(_START), split(v)))
    df = df.withColumn("names", F.array_distinct(F.filter("own", lambda w: w.startswith(_NAME))))
    start = lambda w, i: F.when(w.startswith(_START) & F.array_contains("names", F.concat(F.lit(_NAME), F.substring(w, 2, 1 << 30))), F.lit(_NAME)).otherwise(F.get("template", i))
    known = F.when((F.size("names") > 0) & F.exists("own", lambda w: w.startswith(_START)), F.transform("own", start)).otherwise(F.col("template"))
    return df.withColumn("known", known).drop("names", "own", "valued")


def _hashed(df: DataFrame, name: str, words: str, n: int, where: Column | None = None) -> DataFrame:
    """Adds ``name``, the hashes of all windows of ``n`` words of the array ``words``, where asked for; each is made of the hashes of two shorter windows."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    df = df.withColumn(f"{name}_1", one if where is None else F.when(where, one)).withColumn(name, F.col(f"{name}_1"))

    def followed(by: str, after: int) -> Column:
        most = F.greatest(F.least(F.size(name), F.size(by) - after), F.lit(0))
        return F.zip_with(F.slice(name, 1, most), F.slice(by, after + 1, most), lambda a, b: F.xxhash64(a, b))

    size = 1
    for bit in bin(n)[3:]:
        df, size = df.withColumn(name, followed(name, size)), 2 * size
        if bit == "1":
            df, size = df.withColumn(name, followed(f"{name}_1", size)), size + 1
    return df.drop(f"{name}_1")


def _starts(words: Column, n: int) -> Column:
    """The places where windows of ``n`` words start."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _placed(hashes: str, other: str | None = None) -> Column:
    """The windows of an array of hashes, with their places; none for null, and only those that differ from another's at the same place."""
    all_ = F.transform(hashes, lambda h, i: F.struct(i.alias("place"), h.alias("h")))
    some = all_ if other is None else F.filter(all_, lambda w: w["h"] != F.get(other, w["place"]))
    return F.coalesce(some, F.array().cast("array<struct<place:int,h:bigint>>"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, to be broadcast if those are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The benchmark items that each document contains, in whole, for ``share`` of their windows at least or for ``RUN`` consecutive words.

    A row of ``documents`` is known by doc_id and its text's hash, so rows
    that share an id stand for themselves and copies of a row are one.  Items of
    equal id and text are one; those of fewer words than a window are looked up
    whole, as plain words.  Texts without words contain nothing and are
    contained nowhere; null ids are kept.
    Windows with fewer than ``LITERAL`` words that are no placeholders are
    looked up as plain words only.  Other columns are not read.

    Returns doc_id, text_hash, item_id, matched (windows found), windows (of the item), share.
    """
    scratch = Scratch(documents.sparkSession)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    items = templates(valued(benchmark.select("item_id", "text").distinct()).select("item_id", F.xxhash64("text").alias("item_hash"), "valued"))
    items = scratch.keep(items)  # read several times below
    literal = lambda words, i: F.size(F.filter(F.slice(words, i + 1, window), lambda w: ~_is_slot(w))) >= LITERAL
    rows = lambda kind, hashes, ok: F.transform(F.filter(_starts(F.col("plain"), window), ok), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.get(hashes, i).alias("h")))
    typed = lambda i: literal("template", i)
    none_type = "array<struct<kind:int,at:int,h:bigint>>"
    none = F.array().cast(none_type)
    known = F.when(F.col("known") != F.col("template"), rows(_KNOWN, "of_known", lambda i: literal("known", i))).otherwise(none)
    wanted = F.concat(rows(_TYPED, "of_template", typed), rows(_TYPED, "of_plain", typed), known, rows(_PLAIN, "of_plain", lambda i: i >= 0))
    few = [r.n for r in items.select(F.size("plain").alias("n")).where(F.col("n").between(1, window - 1)).distinct().collect()]  # fewer than window

    def hashed(df: DataFrame) -> DataFrame:
        df = _hashed(df, "of_template", "template", window)
        df = _hashed(df, "of_plain", "plain", window, F.col("plain") != F.col("template"))
        df = _hashed(df, "of_known", "known", window, F.col("known") != F.col("template"))
        for k in few:
            df = _hashed(df, f"of_{k}", "plain", k)
        return df

    whole = F.lit(None)
    for k in few:
        whole = F.when(F.size("plain") == k, F.array(F.struct(F.lit(_PLAIN).alias("kind"), F.lit(0).alias("at"), F.get(f"of_{k}", F.lit(0)).alias("h")))).otherwise(whole)
    wanted = F.concat(wanted, F.coalesce(whole.cast(none_type), none))
    windows = hashed(items).withColumn("of_plain", F.coalesce("of_plain", "of_template"))
    wanted = scratch.keep(windows.select("item_id", "item_hash", F.inline(F.array_distinct(wanted))))
    sizes = wanted.groupBy("item_id", "item_hash", "kind").agg(F.countDistinct("at").alias("windows"))

    words = templates(valued(documents.select("doc_id", text_hash.alias("text_hash"), "text")).drop("text"))
    own = F.concat(_placed("of_template"), _placed("of_plain", "of_template"), _placed("of_known", "of_template"), *[_placed(f"of_{k}") for k in few])
    words = hashed(words)
    seen = words.select("doc_id", "text_hash", F.inline(own))
    met = seen.join(_sent(wanted, wanted.count()), "h")
    lines = met.groupBy("doc_id", "text_hash", "item_id", "item_hash", "kind", (F.col("place") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("at"))
    lines = scratch.keep(lines)

    slotted = items.where(F.exists("known", _is_slot)).select("item_id", "item_hash", "plain", "template", "known")
    n = wanted.select("item_id", "item_hash").distinct().count()
    doubtful = lines.where(F.col("kind") != _PLAIN).join(_sent(slotted, n), (lines.item_hash == slotted.item_hash) & lines.item_id.eqNullSafe(slotted.item_id), "left_semi")
    looked = doubtful.select("doc_id", "text_hash").distinct()
    texts = documents.select(F.col("doc_id").alias("id"), text_hash.alias("hash"), "text")
    looked = texts.join(_sent(looked, doubtful.count()), (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").dropDuplicates(["id", "hash"])
    looked = templates(valued(looked.select("id", "hash", "text"))).select("id", "hash", F.col("plain").alias("own"))
    a, b = doubtful.alias("a"), slotted.alias("b")
    pairs = a.join(b, (F.col("a.item_hash") == F.col("b.item_hash")) & F.col("a.item_id").eqNullSafe(F.col("b.item_id"))).join(looked, (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id")))
    pairs = pairs.withColumn("marked", F.when(F.col("kind") == _KNOWN, F.col("known")).otherwise(F.col("template")))
    slots = F.filter(
        F.transform(F.col("marked"), lambda m, i: F.struct(m.alias("m"), F.concat(m, F.get("plain", i)).alias("w"), F.get(F.col("own"), i + F.col("shift")).alias("v"), F.exists("at", lambda s: (s <= i) & (i < s + window)).alias("held"))),
        lambda s: s["held"] & _is_slot(s["m"]),
    )
    pairs = pairs.select(F.col("a.item_id"), F.col("a.item_hash"), "doc_id", "text_hash", "kind", "shift", F.array_distinct(F.transform(slots, lambda s: F.struct(s["w"], s["v"]))).alias("s"))
    broken = pairs.where(F.size(F.array_distinct(F.transform("s", lambda s: s["w"]))) != F.size("s"))
    # what breaks the placeholders of a line takes its plain windows along
    broken = broken.select("doc_id", "text_hash", "item_id", "item_hash", "shift", F.explode(F.when(F.col("kind") == _TYPED, F.array(F.lit(_TYPED), F.lit(_PLAIN))).otherwise(F.array(F.col("kind")))).alias("kind"))
    # a long verbatim run holds whatever else its line says
    reach = RUN - window
    runs = lambda at: F.exists(F.transform(at, lambda a, i: F.get(at, i + reach) - a), lambda d: d == reach)
    runs = lines.where((F.col("kind") == _PLAIN) & (F.size("at") > reach) & runs(F.sort_array("at"))) if reach >= 0 else lines.limit(0)
    runs = runs.select("doc_id", "text_hash", "item_id", "item_hash", "kind", "shift", "at", F.lit(True).alias("run"))
    l, r = lines.alias("l"), broken.alias("r")
    same = F.lit(True)
    for c in ("text_hash", "item_hash", "kind", "shift"):
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    kept = l.join(r, same & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.item_id").eqNullSafe(F.col("r.item_id")), "left_anti")

    kept = kept.withColumn("run", F.lit(False)).unionByName(runs)
    of = ["doc_id", "text_hash", "item_id", "item_hash", "kind"]
    found = kept.select(*of, "run", F.explode("at").alias("at")).groupBy(*of, "at").agg(F.max("run").alias("run")).groupBy("doc_id", "text_hash", "item_id", "item_hash", "kind").agg(F.count("*").alias("matched"), F.max("run").alias("run"))
    f, s = found.alias("f"), _sent(sizes, n).alias("s")
    out = f.join(s, (F.col("f.item_hash") == F.col("s.item_hash")) & F.col("f.item_id").eqNullSafe(F.col("s.item_id")) & (F.col("f.kind") == F.col("s.kind")))
    out = out.select("doc_id", "text_hash", F.col("f.item_id"), F.col("f.item_hash"), F.struct((F.col("matched") / F.col("windows")).alias("share"), "matched", "windows").alias("best"), "run")
    out = out.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.max("best").alias("best"), F.max("run").alias("run")).where((F.col("best.share") >= share) | F.col("run"))
    return out.select("doc_id", "text_hash", "item_id", "best.matched", "best.windows", "best.share")


def flags(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (of the highest share, then the smallest) and share, for each row of ``documents``."""
    found = contaminated(documents, benchmark, window, share)
    best = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.max(F.struct("share", (-F.col("item_id")).alias("least"))).alias("best"))
    own = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    d, b = own.alias("d"), best.alias("b")
    out = d.join(b, (F.col("d.text_hash") == F.col("b.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    return out.select(F.col("d.doc_id"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.least")).alias("item_id"), F.col("best.share").alias("share"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of ``documents`` that contain no benchmark item, whole."""
    found = Scratch(documents.sparkSession).keep(contaminated(documents, benchmark, window, share).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    of = (F.col("bad_hash") == F.xxhash64(F.coalesce("text", F.lit("")))) & F.col("bad_id").eqNullSafe(F.col("doc_id"))
    return documents.join(_sent(found, found.count()), of, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on all documents and items; nulls, ties, repeats and empty tables as in ``contaminated`` and ``flags``."""
    return flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_valued(text: str) -> str:
    """``valued`` in SQL; RE2 has no lookaround, so what may overlap is replaced twice."""
    t = f"coalesce({text}, '')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([^.!?:…\\x20\\x09-\\x0D][\\x20\\x09-\\x0D])(\\p{{Lu}}\\p{{Ll}}[\\p{{L}}\\p{{N}}]*)', '\\1' || chr(1) || '\\2', 'g')"
    t = f"lower(regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}\\x01])(\\p{{Lu}}\\p{{Ll}}[\\p{{L}}\\p{{N}}]*)', '\\1' || chr(5) || '\\2', 'g'))"
    for _ in range(2):
        t = f"regexp_replace({t}, '(\\p{{N}})[.,:/](\\p{{N}})', '\\1' || chr(4) || '\\2', 'g')"
    t = f"regexp_replace({t}, '(\\p{{N}}[\\p{{N}}\\x04]*)', ' ' || chr(2) || '\\1 ', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}%\\x01-\\x05]+', ' ', 'g') || ' '"
    t = f"regexp_replace({t}, '(\\x02[^ ]* +)({'|'.join(UNITS)}) ', '\\1' || chr(3) || '\\2 ', 'g')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


_SLOT = "regexp_matches({}, '^[\\x01-\\x03]')"


def _sql_templates(key: str, rows: str) -> str:
    """p (plain), t (names inside sentences are placeholders) and k (known names at sentence starts, too) of rows (key, text)."""
    return f"""SELECT {key}, text, p, t, CASE WHEN len(names) = 0 THEN t ELSE
  list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i][1] = chr(5) AND list_contains(names, chr(1) || v[i][2:]) THEN chr(1) ELSE t[i] END) END AS k
FROM (SELECT {key}, text, v, list_filter(v, lambda x: x[1] = chr(1)) AS names, list_transform(v, lambda x: regexp_replace(x, '[\\x01-\\x03\\x05]', '', 'g')) AS p,
  list_transform(v, lambda x: CASE WHEN {_SLOT.format("x")} THEN x[1] ELSE replace(x, chr(5), '') END) AS t
  FROM (SELECT {key}, text, CASE WHEN w = '' THEN [] ELSE string_split(w, ' ') END AS v FROM (SELECT {key}, text, {_sql_valued("text")} AS w FROM ({rows}))))"""


def _sql_windows(key: str, words: str, of: str, n: str = str(WINDOW)) -> str:
    return f"SELECT {key}, text, i AS pos, array_to_string({words}[i + 1 : i + {n}], ' ') AS g FROM (SELECT *, unnest(range(len({words}) - {n} + 1)) AS i FROM {of} WHERE len({words}) >= {n})"


def _sql_item_windows(kind: int, words: str, literal: str = "", where: str = "true") -> str:
    held = f"len(list_filter({literal}[i + 1 : i + {WINDOW}], lambda x: NOT {_SLOT.format('x')})) >= {LITERAL}" if literal else "true"
    return f"SELECT item_id, text, {kind} AS kind, i AS pos, array_to_string({words}[i + 1 : i + {WINDOW}], ' ') AS g FROM (SELECT *, unnest(range(len(p) - {WINDOW - 1})) AS i FROM b WHERE len(p) >= {WINDOW} AND {where}) WHERE {held}"


ORACLE_SQL = f"""
WITH b AS ({_sql_templates("item_id", "SELECT DISTINCT item_id, text FROM benchmark")}),
d AS ({_sql_templates("doc_id", "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents")}),
bw AS ({_sql_item_windows(0, "t", "t")} UNION {_sql_item_windows(0, "p", "t")} UNION {_sql_item_windows(1, "k", "k", "k <> t")} UNION {_sql_item_windows(2, "p")}
       UNION SELECT item_id, text, 2, 0, array_to_string(p, ' ') FROM b WHERE len(p) BETWEEN 1 AND {WINDOW - 1}),
sizes AS (SELECT item_id, text, kind, count(DISTINCT pos) AS windows FROM bw GROUP BY ALL),
few AS (SELECT DISTINCT len(p) AS n FROM b WHERE len(p) BETWEEN 1 AND {WINDOW - 1}),
dw AS ({_sql_windows("doc_id", "t", "d")} UNION {_sql_windows("doc_id", "p", "d")} UNION {_sql_windows("doc_id", "k", "d")}
       UNION {_sql_windows("doc_id", "p", "(SELECT d.*, n FROM d, few)", "n")}),
lines AS (SELECT dw.doc_id, dw.text, item_id, bw.text AS item, kind, dw.pos - bw.pos AS shift, list(DISTINCT bw.pos) AS ats FROM dw JOIN bw USING (g) GROUP BY ALL),
marked AS (SELECT l.*, CASE WHEN kind = 1 THEN b.k ELSE b.t END AS m, b.p AS bp, d.p AS dp FROM lines l
           JOIN b ON b.item_id IS NOT DISTINCT FROM l.item_id AND b.text = l.item JOIN d ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text = l.text
           WHERE kind <> 2 AND len(list_filter(b.k, lambda x: {_SLOT.format("x")})) > 0),
slots AS (SELECT DISTINCT doc_id, text, item_id, item, kind, shift, m[i + 1] || bp[i + 1] AS x, dp[i + shift + 1] AS y FROM (SELECT *, unnest(range(len(m))) AS i FROM marked)
          WHERE {_SLOT.format("m[i + 1]")} AND len(list_filter(ats, lambda s: s <= i AND i < s + {WINDOW})) > 0),
broken0 AS (SELECT doc_id, text, item_id, item, kind, shift FROM slots GROUP BY ALL HAVING count(*) <> count(DISTINCT x)),
broken AS (SELECT * FROM broken0 UNION SELECT doc_id, text, item_id, item, 2, shift FROM broken0 WHERE kind = 0),
runs AS (SELECT *, len(list_filter(ats, lambda a: len(list_filter(ats, lambda c: c BETWEEN a AND a + {RUN - WINDOW})) = {RUN - WINDOW + 1})) > 0 AND kind = 2 AS run FROM lines),
kept AS (SELECT l.* FROM runs l WHERE run OR NOT EXISTS (SELECT 1 FROM broken r WHERE r.doc_id IS NOT DISTINCT FROM l.doc_id AND r.text = l.text
         AND r.item_id IS NOT DISTINCT FROM l.item_id AND r.item = l.item AND r.kind = l.kind AND r.shift = l.shift)),
one AS (SELECT doc_id, text, item_id, item, kind, pos, bool_or(run) AS run FROM (SELECT *, unnest(ats) AS pos FROM kept) GROUP BY doc_id, text, item_id, item, kind, pos),
found AS (SELECT doc_id, one.text, one.item_id, one.item, count(*) / any_value(windows) AS share, bool_or(run) AS run FROM one
          JOIN sizes s ON s.item_id IS NOT DISTINCT FROM one.item_id AND s.text = one.item AND s.kind = one.kind GROUP BY doc_id, one.text, one.item_id, one.item, one.kind),
held AS (SELECT doc_id, text, item_id, item, max(share) AS share FROM found GROUP BY ALL HAVING max(share) >= {SHARE} OR bool_or(run)),
best AS (SELECT doc_id, text, count(*) AS n_items, min(item_id) FILTER (share = top) AS item_id, max(share) AS share
         FROM (SELECT *, max(share) OVER (PARTITION BY doc_id, text) AS top FROM held) GROUP BY doc_id, text)
SELECT o.doc_id, f.n_items IS NOT NULL AS contaminated, coalesce(f.n_items, 0) AS n_items, f.item_id, f.share
FROM documents o LEFT JOIN best f ON f.doc_id IS NOT DISTINCT FROM o.doc_id AND f.text = coalesce(o.text, '')
"""
