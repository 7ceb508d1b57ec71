"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from skarn import catalog

from .conftest import SMALL


#: Queries without SQL: tests of their own hold them to brute force (test_texts, test_leiden, test_summaries, test_json_tree).
BRUTE = ["community_names", "compressed_responses", "compressed_texts", "leiden_assigned", "leiden_communities", "markdown_chunks", "memory_filled", "outputs_summary", "paragraph_chunks", "plain_chunks"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def _rows(frame):
    frame = frame[sorted(frame.columns)]

    def shown(v):
        if v is None or pd.isna(v):
            return "null"
        # A column of numbers with nulls comes as floats from one side.
        return f"{float(v):.6f}" if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(shown, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert name in BRUTE and len(got)
