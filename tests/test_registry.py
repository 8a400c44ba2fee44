"""Driver-contract checks on the registered queries."""

import re

import __spark_entry__ as E
from conftest import SF001

LIGHT = ["period_workspace", "kpi_overview", "insight_winners", "source_tree3", "register_version",
         "clean_records", "map_columns", "transcripts_filtered", "funnel_yoy_events", "driver_ranking"]


def own(names):
    """Without the queries of the optional training-data subpackage."""
    return {k for k in names if k != "pipeline" and not re.match(r"op\d+_", k)}


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(own(q)) >= 100


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "entity_name" in df.columns


def test_sample_queries_run_with_stable_schema(spark):
    q = E.queries()
    for name in LIGHT:
        a = q[name](spark, SF001)
        b = q[name](spark, SF001)
        assert a.schema == b.schema, name
        a.limit(1).collect()


def test_every_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert own(q) == own(o)
