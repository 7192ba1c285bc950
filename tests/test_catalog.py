"""Every catalogued query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_queries_match_sql(spark):
    import duckdb

    from tallywright.plans import queries as catalog

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wrong = [name for name, sql in catalog.ORACLES.items() if canonical(catalog.QUERIES[name](spark, str(DATA)).toPandas()) != canonical(db.sql(sql).df())]
    assert not wrong
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
