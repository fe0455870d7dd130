"""Scalar expressions: ratios, ids, periods, URLs, text, JSON and boxes. All are Columns; the two pandas functions say why."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- ratios --------------------------------------------------------------------


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator; 1.0 where nothing was to be found."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(numerator.cast("double") / denominator)


def at_least(observed: Column, threshold: Column) -> Column:
    """Whether an unrounded figure reaches its threshold; a missing one does not."""
    return F.coalesce(observed >= threshold, F.lit(False))


# -- ids -----------------------------------------------------------------------


def joined_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix-<hash of the parts, joined by U+001F>; a null part counts as the text None."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, length))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID, version 5, of ``name`` in a namespace given as a UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def canonical_json(*fields: Column | str) -> Column:
    """Compact JSON of the fields with sorted keys, nulls kept, text unescaped."""
    columns = [F.col(f) if isinstance(f, str) else f for f in fields]
    names = sorted((c._jc.toString().rsplit(" AS ", 1)[-1].strip("`"), k) for k, c in enumerate(columns))
    return F.to_json(F.struct(*[columns[k] for _, k in names]), {"ignoreNullFields": "false"})


def json_text(value: Column) -> Column:
    """JSON text in canonical form (object keys sorted); null where it is no valid JSON or repeats a key."""
    return F.to_json(F.try_parse_json(value))


# -- months and dates ------------------------------------------------------------


def is_period(value: Column) -> Column:
    """Whether a text is a month YYYY-MM of the years 0001 to 9999."""
    return F.coalesce(value.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$") & ~value.startswith("0000"), F.lit(False))


def months(first: Column, last: Column) -> Column:
    """All months from first to last, both YYYY-MM; an error where they run backwards."""
    a, b = F.to_date(F.concat(first, F.lit("-01"))), F.to_date(F.concat(last, F.lit("-01")))
    grid = F.transform(F.sequence(a, b, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    return F.when(a <= b, grid).otherwise(F.raise_error(F.lit("the first month is after the last")))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number of seconds or an HTTP date; never below zero, null for anything else."""
    seconds = F.expr("null").cast("double")
    number = F.when(value.rlike(r"^\s*[0-9]+\s*$"), F.trim(value).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    late = F.greatest(F.lit(0.0), F.unix_timestamp(date).cast("double") - F.unix_timestamp(now))
    return F.coalesce(number, F.when(date.isNotNull(), late), seconds)


# -- texts -----------------------------------------------------------------------

# Months as they are written in Spanish, with the number of each, and the forms in which numbers, periods and dates of reports are accepted.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9,
    "octubre": 10, "noviembre": 11, "diciembre": 12, "jun": 6,
}
_MONTH = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
_DASH = r"\s*[-\u2013\u2014]\s*"
_NUMBER_SHAPES = (r"\bn\s*[.º°oª]*\s*[-:]?\s*([0-9]{1,4})\b", r"\breporte\s+(?:n\s*[.º°oª]*\s*)?([0-9]{1,4})\b")
_DAY, _AFTER_DAY = "(?:0?[1-9]|[12][0-9]|3[01])", r"(?:\s+de\s+|\s+|\s*[,./:\-\u2013\u2014]\s*)"
_PERIOD = rf"\b(?:{_MONTH})(?:\s+|{_DASH})[0-9]{{4}}\b|\b[0-9]{{4}}(?:\s+|{_DASH})(?:{_MONTH})\b(?!{_AFTER_DAY}{_DAY}\b)|\bjun{_DASH}[0-9]{{4}}\b"
_WEEKDAY = "lunes|martes|miércoles|miercoles|jueves|viernes|sábado|sabado|domingo"
_DATE_SHAPES = (r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", rf"\b(?:{_WEEKDAY}),\s*[0-9]{{1,2}}\s+(?:{_MONTH})\s+[0-9]{{4}}\b", rf"\b(?:{_MONTH})\s+[0-9]{{1,2}},\s*[0-9]{{4}}\b")
_ANY_CASE = "(?iU)"


def clean_text(text: Column) -> Column:
    """White space of any script as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def report_number(text: Column) -> Column:
    """The number of a report named in a text: the first after N, else the first after reporte; one that looks like a year is none."""
    found = [F.regexp_extract(text, _ANY_CASE + shape, 1).try_cast("int") for shape in _NUMBER_SHAPES]
    return F.coalesce(*[F.when(~n.between(1900, 2100), n) for n in found])


def reference_period(text: Column) -> Column:
    """The first month and year named in a text, as YYYY-MM; one that a day of the month stands at is a date and does not count.

    A report's number is no day: those of up to two digits are masked before
    periods are looked for.
    """
    for shape in _NUMBER_SHAPES:
        text = F.regexp_replace(text, f"{_ANY_CASE}({shape.replace('([0-9]{1,4})', ')[0-9]{1,2}')}", "$1#")
    found = F.regexp_extract_all(text, F.lit(rf"{_ANY_CASE}(?:\b{_DAY}{_AFTER_DAY})?(?:{_PERIOD})"), F.lit(0))
    first = F.get(F.filter(found, lambda p: ~p.rlike(rf"{_ANY_CASE}^{_DAY}{_AFTER_DAY}")), F.lit(0))
    table = F.create_map(*[F.lit(x) for m, k in MONTHS.items() for x in (m, f"{k:02d}")])
    return F.concat(F.regexp_extract(first, "([0-9]{4})", 1), F.lit("-"), table[F.lower(F.regexp_extract(first, r"(\p{L}+)", 1))])


def date_text(text: Column) -> Column:
    """The first date in a text, as written: with slashes, else with a weekday, else with a month's name before the day."""
    found = [F.regexp_extract(text, _ANY_CASE + shape, 0) for shape in _DATE_SHAPES]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def qualified_whitespace(text: Column) -> Column:
    """Blanks and line feeds collapsed; null where other white space occurs, or where a gap stands between digits and would change a number."""
    odd = text.rlike(r"(?U)[\s&&[^ \n]]") | text.rlike(r"[0-9][ \n]+[0-9]")
    return F.when(~odd, F.trim(F.regexp_replace(text, "[ \n]+", " ")))


def span_is(text: Column, start: Column, end: Column, part: Column) -> Column:
    """Whether the code points from start to end of a text are ``part``."""
    return F.coalesce(F.substring(text, start + 1, end - start) == part, F.lit(False))


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """The code point at which a column (from 1) of a line (from 1) stands."""
    before = F.slice(F.split(text, "\n", -1), F.lit(1), line - 1)
    return F.aggregate(before, F.lit(0), lambda n, l: n + F.length(l) + 1) + column - 1


def html_escape(text: Column) -> Column:
    """Text for HTML, line feeds as breaks."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def occurrences(text: Column, part: Column) -> Column:
    """Where ``part`` stands in ``text`` (code points from 0), overlaps included, not inside a longer word or number."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - F.length(part)))
    word = lambda c: F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))

    def stands(k):
        before = F.when(k > 0, F.substring(text, k, F.lit(1)))
        after = F.substring(text, k + F.length(part) + 1, F.lit(1))
        head, tail = F.substring(part, F.lit(1), F.lit(1)), F.substring(part, F.length(part), F.lit(1))
        number = F.coalesce(tail.rlike("[0-9]") & F.substring(text, k + F.length(part) + 1, F.lit(2)).rlike("^[.,][0-9]"), F.lit(False))
        return (F.substring(text, k + 1, F.length(part)) == part) & ~(word(before) & word(head)) & ~(word(after) & word(tail)) & ~number

    return F.when(F.length(part) > 0, F.filter(places, stands)).otherwise(F.array().cast("array<int>"))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Case and accents folded, white space collapsed. Spark has no Unicode normalisation, hence pandas."""
    return text.map(lambda t: None if t is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().split()))


# -- URLs ------------------------------------------------------------------------


def normalize_url(url: Column) -> Column:
    """An absolute URL with lower-case scheme and host, without default port, fragment and utm parameters; null where it is none or holds credentials."""
    whole = r"^(?i)(https?)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?$"
    part = lambda k: F.regexp_extract(url, whole, k)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"\.(?=$|:)", ""), "^", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")), "&")
    good = url.rlike(whole) & ~part(2).contains("@")
    return F.when(good, F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def host_of(url: Column) -> Column:
    return F.regexp_extract(normalize_url(url), r"^https?://([^/:]+)", 1)


def link_role(url: Column) -> Column:
    """What a link leads to, by the end of its path."""
    path = F.lower(F.regexp_extract(normalize_url(url), r"^https?://[^/]+([^?]*)", 1))
    return F.when(path.rlike(r"\.(pdf|docx?|xlsx?|zip)$"), "direct_download").when(path.rlike(r"(\.html?|/)$"), "landing_page").otherwise("other")


def acquisition_url(url: Column, hosts: list[str]) -> Column:
    """A URL fit for download: https, an approved host, no query or fragment, no dot segments or control characters; else null."""
    path = F.regexp_extract(url, r"^https://[^/?#]+(/[^?#]*)$", 1)
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    fine = (path != "") & F.regexp_extract(F.lower(url), "^https://([^/?#]+)", 1).isin(*hosts) & plain.isNotNull() & ~plain.rlike(r"[\x00-\x1f\x7f]|(^|/)\.{1,2}(/|$)|\\")
    again = F.replace(F.replace(F.url_encode(plain), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.when(fine, F.concat(F.lit("https://"), F.regexp_extract(F.lower(url), "^https://([^/?#]+)", 1), again))


def host_class(url: Column, approved: list[str], pending: list[str]) -> Column:
    host = host_of(url)
    return F.when(host.isin(*approved), "authoritative").when(host.isin(*pending), "pending_review").otherwise("unsupported")


# -- JSON ------------------------------------------------------------------------


def json_kind(value: Column) -> Column:
    """null, boolean, string, number, array or object, of a JSON text; null where it is no valid JSON. Strings stay strings, zero stays a number."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def finite_json(value: Column) -> Column:
    """JSON text in which every number is finite and no key repeats; else null."""
    return F.when(F.try_parse_json(value).isNotNull() & ~F.to_json(F.try_parse_json(value)).rlike('"?(NaN|-?Infinity)"?') & ~value.rlike(r"[0-9][eE]\+?[0-9]{3,}"), value)


def pointer_path(pointer: str) -> str:
    """A JSON pointer (RFC 6901) as the path that variant_get takes; leading zeros are no index."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer starts with /")
    out = "$"
    for step in pointer.split("/")[1:]:
        name = step.replace("~1", "/").replace("~0", "~")
        out += f"[{name}]" if name.isdigit() and (name == "0" or name[0] != "0") else f"['{name}']" if "'" not in name else f'["{name}"]'
    return out


def resolve(value: Column, pointer: str) -> Column:
    """The JSON text at a pointer of a document; null where there is nothing, the text null for a null."""
    return F.to_json(F.try_variant_get(F.try_parse_json(value), pointer_path(pointer), "variant"))


def contract_of(document: Column, field: str, contracts: list[str], base: str) -> Column:
    """Which contract a JSON object follows, by its discriminating field: one of ``contracts``, or ``base`` where the field is absent; null for anything else."""
    found = F.try_variant_get(F.try_parse_json(document), f"$.{field}", "string")
    is_object = json_kind(document) == "object"
    return F.when(is_object & found.isNull(), base).when(is_object & found.isin(*contracts), found)


def strictly_equal(a: Column, b: Column) -> Column:
    """Equality of JSON texts that tells 0, false, 0.0 and "0" apart."""
    x, y = F.try_parse_json(a), F.try_parse_json(b)
    return (F.schema_of_variant(x) == F.schema_of_variant(y)) & (F.to_json(x) == F.to_json(y))


def typed_value(value: Column, kind: Column) -> Column:
    """A form's text as JSON of its declared kind (string, number, boolean, json); null where it does not fit."""
    number = F.when(value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?$"), value)
    return (
        F.when(kind == "string", F.get(F.split(F.substring(F.to_json(F.array(value)), 2, 1 << 30), r"\]$"), F.lit(0)))
        .when(kind == "number", number).when(kind == "boolean", F.when(value.isin("true", "false"), value)).when(kind == "json", json_text(value))
    )


# -- boxes -----------------------------------------------------------------------


def box_ok(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    finite = ~F.isnan(x0 + y0 + x1 + y1) & (F.abs(x0 + y0 + x1 + y1) < float("inf"))
    return F.coalesce(finite & (x1 >= x0) & (y1 >= y0), F.lit(False))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How much two intervals share; zero where they only touch or lie apart."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share area; a common edge is none."""
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def inside(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether box a lies wholly in box b."""
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def same_line(y0: Column, y1: Column, z0: Column, z1: Column) -> Column:
    """Whether two words stand on one line: they share 0.75 of the lower height, and their centres are a quarter of it apart at most."""
    low = F.least(y1 - y0, z1 - z0)
    return (F.least(y1, z1) - F.greatest(y0, z0) >= 0.75 * low) & (F.abs((y0 + y1) / 2 - (z0 + z1) / 2) <= 0.25 * low)


# -- arrays ----------------------------------------------------------------------


def sorted_unique_pages(pages: Column) -> Column:
    """Whether an array of pages is sorted, unique and positive."""
    return (F.array_sort(F.array_distinct(pages)) == pages) & F.forall(pages, lambda p: p >= 1)


def has_repeats(items: Column) -> Column:
    return F.size(F.array_distinct(items)) != F.size(items)


def disjoint(*items: Column) -> Column:
    """Whether no two of the arrays share an element."""
    out = F.lit(True)
    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            out = out & ~F.arrays_overlap(a, b)
    return out


def reorder(items: Column, places: Column) -> Column:
    """The items at the places (from 0), in the places' order."""
    return F.transform(places, lambda k: F.get(items, k))
