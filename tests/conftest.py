import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("ROWLENS_MEMORY", "3g")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rowlens.session import local_session

    return local_session(4, 4, name="tests")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con
