"""The distance queries answer for every part, not for some of them."""

from __future__ import annotations

import duckdb
import pytest

from veilmark.plans import registry

CUT = "WHERE q.rid % 100 = 0"
NAMES = ["distance_numeric", "distance_numeric_generalized", "distance_numeric_ranges", "distance_categorical_edge", "distance_categorical_generalized", "distance_nodes", "distance_matrix", "record_distance"]


@pytest.mark.parametrize("name", NAMES)
def test_every_part_has_its_distances(spark, sf, name):
    """Side by side with the SQL form, whose own choice of parts is taken out here."""
    duck = duckdb.connect()
    duck.sql(f"create view part as select * from '{sf}/part.parquet'")
    found = duck.sql(registry.SQL[name].replace(CUT, ""))
    expected = {r[found.columns.index("rid")]: dict(zip(found.columns, r)) for r in found.fetchall()}
    got = [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()]
    assert len(got) == len(expected) == duck.sql("select count(*) from part").fetchall()[0][0]
    for r in got:
        assert r == pytest.approx({k: float(v) for k, v in expected[r["rid"]].items()}, abs=2e-6)
