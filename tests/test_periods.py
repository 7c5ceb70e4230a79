"""Postings by period: a change rewrites its own periods only, equals the plain operators, and survives a stop half way."""

import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowlens.operators import periods, retention, snapshot
from rowlens.plans import catalog
from rowlens.plans.projection import AS_OF, canonical
from tests.conftest import SMALL


@pytest.fixture()
def table(spark, tmp_path):
    stored, _ = catalog._jobs(spark, SMALL)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return periods.PeriodTable(spark, str(tmp_path / "postings"), ddl).create(stored)


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.path, "rows").rglob("*.parquet")}


def bag(rows):
    return Counter(map(str, rows.select(*sorted(c for c in rows.columns if c != periods.PERIOD)).collect()))


def period_of(path):
    return path.parent.name.split("=")[1]


def test_a_batch_rewrites_its_periods_only(spark, table):
    stored, batch = catalog._jobs(spark, SMALL)
    few = batch.orderBy("posting_id").limit(2)
    before = files(table)
    changed = table.apply(few)
    after = files(table)
    assert 0 < len(changed) < len({period_of(p) for p in before})
    assert all(after.get(p) == t for p, t in before.items() if period_of(p) not in changed)
    assert {period_of(p) for p in after.keys() - before.keys()} <= set(changed)
    want, _ = snapshot.apply_batch(stored, few)
    assert bag(table.read()) == bag(want)
    # an empty batch writes nothing
    assert table.apply(few.limit(0)) == [] and files(table) == after
    assert table.log().count() == 3


def test_a_purge_rewrites_its_periods_only(spark, table):
    stored, _ = catalog._jobs(spark, SMALL)
    flags, applications = canonical(spark, SMALL, "flags"), canonical(spark, SMALL, "applications")
    # the oldest period goes as a whole
    oldest = min(period_of(p) for p in files(table))
    gone = stored.filter(F.date_format("first_seen_at", "yyyy-MM") == oldest)
    marks, applied = flags.join(gone, "posting_id", "left_anti").select(*flags.columns), applications.join(gone, "posting_id", "left_anti").select(*applications.columns)
    rows = stored.withColumn("is_active", F.col("is_active") & (F.date_format("first_seen_at", "yyyy-MM") != oldest))
    table = periods.PeriodTable(spark, table.path + "-2", table.columns).create(rows)
    before = files(table)
    changed = table.purge(marks, applied, AS_OF)
    after = files(table)
    assert oldest in changed and oldest not in {period_of(p) for p in after}
    assert all(after.get(p) == t for p, t in before.items() if period_of(p) not in changed)
    assert bag(table.read()) == bag(retention.kept_postings(rows, marks, applied, AS_OF))
    assert table.purge(marks, applied, AS_OF) == [] and files(table) == after


def test_a_change_that_stopped_is_ended(spark, table, monkeypatch):
    stored, batch = catalog._jobs(spark, SMALL)
    few = batch.orderBy("posting_id").limit(3)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(periods.PeriodTable, "_swap", stop)
        with pytest.raises(RuntimeError):
            table.apply(few)
    assert bag(table.read()) == bag(stored)
    # half of it was written
    name = table.log().filter("state = 'staged'").first()
    shutil.rmtree(Path(table.path, "rows", f"{periods.PERIOD}={name.periods[0]}"), ignore_errors=True)
    table.recover()
    assert bag(table.read()) == bag(snapshot.apply_batch(stored, few)[0])
    assert not list(Path(table.path, "stage").iterdir())


def test_no_rows_and_rows_without_a_first_sight(spark, table):
    stored, batch = catalog._jobs(spark, SMALL)
    rows = stored.limit(5).withColumn("first_seen_at", F.lit(None).cast("timestamp"))
    odd = periods.PeriodTable(spark, table.path + "-3", table.columns).create(rows)
    assert {period_of(p) for p in files(odd)} == {"none"} and bag(odd.read()) == bag(rows)
    empty = periods.PeriodTable(spark, table.path + "-4", table.columns).create(stored.limit(0))
    assert empty.read().count() == 0
    empty.apply(batch)
    assert bag(empty.read()) == bag(snapshot.apply_batch(stored.limit(0), batch)[0])
