"""Constraints as queries: each rule gives the rows that break it, as (rule_id, key, detail). An empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of an annotation by what they ask of its value.
VALUE_REQUIRED, VALUE_FORBIDDEN = ("observed",), ("not_reported", "not_applicable", "structurally_unavailable", "illegible_uninspectable")
COMMENT_REQUIRED = ("source_ambiguous", "annotation_uncertain")


def broken(df: DataFrame, rule: str, key: Column, fault: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which ``fault`` holds; an unknown fault is none."""
    return df.where(F.coalesce(fault, F.lit(False))).select(F.lit(rule).alias("rule_id"), key.cast("string").alias("key"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def row_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """All row rules in one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return df.select(key.cast("string").alias("key"), F.explode(found).alias("rule_id")).select("rule_id", "key", F.lit(None).cast("string").alias("detail"))


def unique(df: DataFrame, rule: str, key: list[str]) -> DataFrame:
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    return broken(counts, rule, F.concat_ws("|", *key), F.col("n") > 1, F.col("n"))


def references(df: DataFrame, rule: str, key: str, to: DataFrame, to_key: str) -> DataFrame:
    """Values of a foreign key that the other table lacks; null refers to nothing."""
    missing = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().join(to.select(F.col(to_key).alias("k")), "k", "left_anti")
    return missing.select(F.lit(rule).alias("rule_id"), F.col("k").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def columns_exactly(df: DataFrame, names: list[str]) -> list[str]:
    """What a relation has too much or too little of, by column names."""
    return [f"unknown {c}" for c in df.columns if c not in names] + [f"missing {c}" for c in names if c not in df.columns]


def schema_drift(df: DataFrame, wanted: str) -> bool:
    """Whether a relation's schema differs from a stored one (the JSON of its StructType)."""
    import json

    plain = lambda s: [(f["name"], f["type"]) for f in json.loads(s)["fields"]]
    return plain(df.schema.json()) != plain(wanted)


def state_faults(state: Column, value: Column, comment: Column) -> Column:
    """What is wrong with an annotation's state, value (JSON text) and comment; null if nothing."""
    has, said = value.isNotNull(), F.coalesce(F.trim(comment) != "", F.lit(False))
    return (
        F.when(state.isin(*VALUE_REQUIRED) & ~has, "a value is required").when(state.isin(*VALUE_FORBIDDEN) & has, "a value is forbidden")
        .when((state == "explicit_zero") & ~F.coalesce(value.rlike(r"^-?0+(\.0+)?$"), F.lit(False)), "zero is required")
        .when(state.isin(*COMMENT_REQUIRED) & ~said, "a comment is required")
        .when(~state.isin("explicit_zero", *VALUE_REQUIRED, *VALUE_FORBIDDEN, *COMMENT_REQUIRED), "unknown state")
    )


def date_pair_faults(date_observed: Column, precision_observed: Column, precision_unresolved: Column) -> Column:
    """An observed precision needs an observed date; an observed date needs an observed or unresolved precision."""
    return F.when(precision_observed & ~date_observed, "precision without date").when(date_observed & ~precision_observed & ~precision_unresolved, "date without precision")


def first_rule(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(*_pair(rules[0]))
    for r in rules[1:]:
        out = out.when(*_pair(r))
    return out.otherwise(otherwise)


def _pair(rule):
    return F.coalesce(rule[0], F.lit(False)), rule[1]


def attempt_outcome(status: Column, error: Column, bytes_: Column, content_type: Column, signature: Column, location_ok: Column, most: int) -> Column:
    """How a download attempt came out, by ordered rules."""
    return first_rule(
        (error.isNotNull(), "transport_error"), (status.isin(408, 425, 429, 500, 502, 503, 504), "transient_http"), (status.between(300, 399) & location_ok, "redirect"),
        (status.between(300, 399), "rejected_redirect"), (status != 200, "http_error"), (bytes_ > most, "body_size"), (~content_type.startswith("application/pdf"), "content_type"), (~signature.startswith("%PDF-"), "signature"),
        otherwise="success",
    )


def unsafe_claims(text: Column, words: list[str]) -> Column:
    """The deny-listed words that a text holds, whatever their case."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.lower(w)))


def repository_fault(path: Column, size: Column, most: int) -> Column:
    """Why a file may not be in a repository, by the first rule that holds; null if none does."""
    low = F.lower(path)
    found = first_rule(
        (low.rlike(r"\.(parquet|duckdb|sqlite3?|db|pdf|docx?|xlsx?|zip|7z|rar|tar|gz)$"), "extension"), (low.rlike(r"(^|/)(\.env[^/]*|id_rsa|credentials(\.json)?|secrets?\.(ya?ml|json))$"), "filename"), (size > most, "size"), otherwise="",
    )
    return F.when(found != "", found)
