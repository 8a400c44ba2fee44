import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from funnelyard.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="funnelyard-tests")
    yield s
    s.stop()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


M_SCHEMA = ("dataset_id string, owner string, cluster string, lead_type string, main_source string, "
            "source string, campus_name string, state string, program_name string, cy_leads long, "
            "cy_registration long, cy_admission long, py_leads long, py_registration long, py_admission long")


def metrics_df(spark, recs):
    """Build a metrics table from dicts (missing fields None / 0)."""
    cols = [c.split()[0] for c in M_SCHEMA.split(", ")]
    data = []
    for r in recs:
        data.append(tuple(r.get(c, 0 if c.startswith(("cy_", "py_")) else None) for c in cols))
    return spark.createDataFrame(data, M_SCHEMA)
