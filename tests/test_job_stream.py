"""The stream of a job's state against the same batches applied one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowlens.operators import snapshot
from rowlens.streaming import ingest

pytest.importorskip("google.protobuf")

T0 = datetime(2026, 1, 1)
POSTING = "posting_id string, fingerprint string, source string, company_slug string, source_job_id string, content_hash string, title string, is_canonical boolean, is_active boolean, first_seen_at timestamp, last_seen_at timestamp"


def invented(seed, days):
    """Batches of records: few fingerprints, boards and aggregators, contents that repeat."""
    r = random.Random(seed)
    batches = []
    for day in range(days):
        rows = {}
        for _ in range(24):
            n, source = r.randrange(200), r.choice(("lever", "ashby", "indeed"))
            posting_id = f"{source}-{n}"
            seen = T0 + timedelta(days=day, minutes=r.randrange(1000))
            rows[posting_id] = (posting_id, f"f{n % 12}", source, f"b{n % 2}", str(n), f"h{r.randrange(3)}", f"title {day}", True, True, seen, seen)
        batches.append(list(rows.values()))
    return batches


def test_stream_equals_batches(spark, tmp_path):
    batches = invented(3, 3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stored, moved = spark.createDataFrame([], POSTING), []
    for rows in batches:
        stored, moves = snapshot.apply_batch(stored, spark.createDataFrame(rows, POSTING))
        stored = spark.createDataFrame(stored.collect(), POSTING)
        moved += [(r.old_id, r.new_id, r.is_new) for r in moves.collect()]

    changes = []
    (tmp_path / "in").mkdir()
    records = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = ingest.job_stream(records, 365 * 86400).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    started = started.foreachBatch(lambda frame, number: changes.append((number, frame.collect())))
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, POSTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = started.trigger(availableNow=True).start()
        query.awaitTermination()
    state, aliases = {}, []
    for _, rows in sorted(changes, key=lambda x: x[0]):
        for r in rows:
            if r.alias_of:
                aliases.append((r.posting_id, r.alias_of, r.is_new))
            if not (r.alias_of and r.is_new):
                state[r.posting_id] = (r.content_hash, r.seen, r.is_active, r.is_canonical)
    want = {r.posting_id: (r.content_hash, r.seen, r.is_active, r.is_canonical) for r in stored.select("posting_id", "content_hash", F.unix_timestamp("last_seen_at").alias("seen"), "is_active", "is_canonical").collect()}
    assert state == want and sorted(aliases) == sorted(moved) and any(n for _, _, n in moved) and any(not n for _, _, n in moved)


def test_silence_closes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = timedelta(days=1)
    make = lambda n, source, when: (f"p{n}", f"f{n}", source, "b", str(n), "h", "t", True, True, when, when)
    batches = [[make(1, "lever", T0), make(2, "lever", T0)], [make(2, "lever", T0 + 5 * day)], [make(3, "lever", T0 + 9 * day)], [make(4, "lever", T0 + 10 * day)]]
    state = {}
    (tmp_path / "in").mkdir()
    records = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = ingest.job_stream(records, 7 * 86400).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    started = started.foreachBatch(lambda frame, _: state.update({r.posting_id: r.is_active for r in frame.collect()}))
    for rows in batches:
        spark.createDataFrame(rows, POSTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        started.trigger(availableNow=True).start().awaitTermination()
    assert state == {"p1": False, "p2": True, "p3": True, "p4": True}
    stored = spark.createDataFrame([x for rows in ([batches[0][0]], batches[1], batches[2], batches[3]) for x in rows], POSTING)
    assert {r.posting_id: r.is_active for r in snapshot.close_silent(stored, str(T0 + 10 * day), 7 * 86400).collect()} == state
