from strata.plans.pages import store


def test_named_queries(spark, tiny):
    s = store(spark, tiny)
    units = s.units().collect()
    assert len(units) == s.t["units"].count() and all(u.body_cells == 3 * u.body_rows for u in units)
    assert [u.unit_key for u in units] == sorted(u.unit_key for u in units)
    priority, regional = s.priority().collect(), s.regional().collect()
    even = {u.unit_key for u in units if u.physical_page % 2 == 0}
    assert len(priority) == sum(u.body_rows for u in units if u.unit_key in even) and len(regional) == sum(u.body_rows for u in units if u.unit_key not in even)
    assert all(r.Lugar_address == f"{r.row_key}:0" for r in priority)
    assert s.limits().count() == 1 + 3 * len(units)
    trace = s.trace().collect()
    assert len(trace) == 1 and trace[0].cell_key == s.first_cell().collect()[0].cell_key
    assert s.trace("no such cell").collect() == []
    q = s.cell_qualifiers().collect()
    assert {r.target_kind for r in q} == {"table_proposal", "column"} and all(r.cell_key.endswith(":1") for r in q if r.target_kind == "column")
