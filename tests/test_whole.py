"""Queries read whole tables: each is held against its SQL without the filters on ids, or against all ids."""

import pytest

from strata import registry
from strata.plans.pages import _words
from tests.oracle import agree, duck_rows

registry.load()

#: Filters on ids that the registered SQL still has.
FILTERS = (" WHERE o_orderkey <= 200", " WHERE l_orderkey <= 200 AND l_linenumber <= 4", " WHERE doc_id % 3 = 0", " WHERE doc_id % 9 = 0", "doc_id % 2 = 0 AND ")
NAMES = [*(f"inspect_{n}" for n in ("units", "priority", "regional", "dependencies", "limits", "trace")), "inspect_qualifiers", "inspect_contexts", "escaped_texts", "line_offsets", "title_preference"]


@pytest.mark.parametrize("name", NAMES)
def test_all_ids(spark, tiny, name):
    sql = registry.ORACLE_SQL[name]
    for f in FILTERS:
        sql = sql.replace(f, "")
    assert agree(registry.QUERIES[name](spark, tiny), sql, tiny) > 0


def test_all_orders_are_pages(spark, tiny):
    _, orders = duck_rows("SELECT o_orderkey::VARCHAR FROM orders", tiny)
    assert {r.page_id for r in _words(spark, tiny).select("page_id").distinct().collect()} == {k for k, in orders}
