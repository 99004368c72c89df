"""Every registered query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from loomgraph.plans import QUERIES
from loomgraph.sources.views import TABLES

#: A sample of each section; bench and the driver run all of them.
NAMES = ["b1_dictionary", "c2_alignment", "c5_path_mapping", "d8_directions", "d9_propagation", "f3_top_distinct", "f5_prefix_budget", "g3_inject_front", "e2_recall_table", "e10_scores", "m8_listwise", "k1_prompts", "k1_modes", "k2_records", "f10_rebuilt", "s3_step_counts", "m11_retrieval"]


@pytest.fixture(scope="module")
def oracle(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if x is None or x != x else round(float(x), 5) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind in "fiu" else int(x) if isinstance(x, int) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, data_dir, oracle, name):
    got = QUERIES[name](spark, data_dir).toPandas()
    want = oracle.execute(QUERIES[name].sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in _rows(got.astype(object))] == [tuple(map(str, r)) for r in _rows(want.astype(object))]


def test_every_inventory_id_is_covered():
    sections = {"A": 22, "B": 16, "C": 19, "D": 12, "E": 20, "F": 10, "G": 9, "H": 22, "K": 8, "M": 15, "S": 6, "U": 4}
    #: Ids without a query: readers and sinks of files and settings, which tests/test_sources.py covers, and trainers outside the engine.
    elsewhere = {"A5", "A6", "A7", "A22", "M15"}
    want = {f"{s}{k}" for s, n in sections.items() for k in range(1, n + 1)} - elsewhere
    assert not want - {c for q in QUERIES.values() for c in q.covers}
