"""Every registered query against its SQL on the smallest tables."""

import math

import pandas as pd
import pytest

from rowlens.plans import catalog
from tests.conftest import SMALL


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    try:
        number = float(value)
        return round(number, 6)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(repr, ([plain(v) for v in r] for r in frame[names].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(name, spark, duck):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
