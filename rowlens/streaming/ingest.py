"""Streams: records archived and normalized as they come, events in windows, and the breaker's state per source.

State is never the source of truth: what a stream keeps can be recomputed from
the archive or the run log, and the batch operators give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rowlens.config import Geo, Taxonomy
from rowlens.operators.health import BASE_DELAY, FAILURES, MAX_DELAY, THRESHOLD
from rowlens.operators.normalize import normalize
from rowlens.operators.snapshot import step


def fresh_records(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """Records of a stream, each content of a record once within the watermark."""
    return raw.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source", "company_slug", "source_job_id", "content_hash"])


def ingest(raw: DataFrame, archive: str, postings: str, rules: Taxonomy | None = None, geo: Geo | None = None, then: Callable[[DataFrame, int], None] | None = None):
    """A writer that archives every micro-batch before it normalizes it.

    Batches are written to folders of their own number, so a repeated batch
    replaces itself. ``then`` gets the normalized batch (dedup, scoring, texts).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{archive}/batch={number}")
        kept = spark.read.schema(batch.schema).parquet(f"{archive}/batch={number}")
        normalize(kept, rules, geo).write.mode("overwrite").parquet(f"{postings}/batch={number}")
        if then is not None:
            then(spark.read.parquet(f"{postings}/batch={number}"), number)

    return raw.writeStream.foreachBatch(write)


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """source, window and counts of runs by event time; late runs within ``delay`` still count."""
    w = F.window("started_at", width, slide) if slide else F.window("started_at", width)
    return events.withWatermark("started_at", delay).groupBy(w.alias("window"), "source").agg(F.count(F.lit(1)).alias("runs"), F.sum("fetched").alias("fetched"), F.count_if(F.col("status").isin(*FAILURES)).alias("failures"))


class Breaker(StatefulProcessor):
    """Failures in a row per source; emits state and retry second after every batch of its runs, in order of start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("breaker", "failures int, status string, ended double, started double, run_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, status, ended, started, run_id = self.value.get() or (0, "", 0.0, 0.0, "")
        runs = pd.concat(list(rows)).sort_values(["started", "run_id"])
        for r in runs.itertuples(index=False):
            if r.status == "skipped" or (r.started, r.run_id) <= (started, run_id):
                continue
            failures = failures + 1 if r.status in FAILURES else 0
            status, ended, started, run_id = r.status, r.ended, r.started, r.run_id
        self.value.update((failures, status, ended, started, run_id))
        tripped = status in FAILURES and (status == "blocked" or failures >= THRESHOLD)
        retry = ended + min(BASE_DELAY * 2.0 ** (failures - 1), MAX_DELAY) if tripped else None
        yield pd.DataFrame({"source": [key[0]], "failures": [failures], "open": [tripped], "retry_at_s": [retry]})

    def close(self) -> None:
        pass


def breaker_stream(runs: DataFrame) -> DataFrame:
    """source, failures, open and retry_at_s from a stream of aggregate runs."""
    rows = runs.filter("company_slug is null").select("source", "run_id", "status", F.unix_micros("started_at").cast("double").alias("started"), F.unix_timestamp("ended_at").cast("double").alias("ended"))
    return rows.groupBy("source").transformWithStateInPandas(Breaker(), "source string, failures int, open boolean, retry_at_s double", "Update", "None")


JOB = "posting_id string, source string, company_slug string, source_job_id string, content_hash string, seen long, is_active boolean, is_canonical boolean"
CHANGES = "fingerprint string, posting_id string, content_hash string, seen long, is_active boolean, is_canonical boolean, alias_of string, is_new boolean"


class Job(StatefulProcessor):
    """The rows of one fingerprint: repeats, take-overs, aliases, reopening, and closing after a silence.

    Steps are those of a batch (``snapshot.step``), in the order of a batch, so the state after any
    number of micro-batches is that of the same batches applied one by one. A timer closes rows
    that nothing named for ``silence_s`` seconds of event time. Emitted are rows that changed, and aliases
    (``alias_of``; a new posting that is only an alias leaves no row in the state).
    """

    def __init__(self, silence_s: int):
        self.silence_s = silence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names = ", ".join(part for part in JOB.split(", ") if not part.startswith("posting_id"))
        self.rows = handle.getMapState("rows", "posting_id string", names)

    def _load(self) -> dict[str, dict]:
        names = [part.split(" ")[0] for part in JOB.split(", ")][1:]
        found = {}
        for (posting_id,), values in self.rows.iterator():
            found[posting_id] = {"posting_id": posting_id, **dict(zip(names, values)), "from_batch": False, "touched": False, "alias_of": None}
        return found

    def _keep(self, row: dict) -> None:
        names = [part.split(" ")[0] for part in JOB.split(", ")][1:]
        self.rows.updateValue((row["posting_id"],), tuple(row[n] for n in names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        before = {k: dict(r) for k, r in state.items()}
        batch = pd.concat(list(rows)).sort_values(["seen", "source", "source_job_id"]).drop_duplicates("posting_id", keep="last")
        for new in batch.to_dict("records"):
            step(state, {k: new[k] for k in ("posting_id", "source", "company_slug", "source_job_id", "content_hash", "seen")} | {"is_active": True, "is_canonical": False})
        out = []
        for posting_id, row in state.items():
            old, alias = before.get(posting_id), row["alias_of"]
            if old is None or any(old[c] != row[c] for c in ("content_hash", "seen", "is_active", "is_canonical")) or alias:
                out.append((key[0], posting_id, row["content_hash"], int(row["seen"]), bool(row["is_active"]), bool(row["is_canonical"]), alias, old is None))
            if old is not None or alias is None:
                self._keep(row | {"seen": int(row["seen"])})
        latest = max((r["seen"] for r in state.values()), default=0)
        self.handle.registerTimer((int(latest) + self.silence_s) * 1000)
        for due in {int(r["seen"]) for r in state.values() if r["is_active"]}:
            self.handle.registerTimer((due + self.silence_s) * 1000)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs() // 1000, []
        for row in self._load().values():
            if row["is_active"] and row["seen"] + self.silence_s <= now:
                row["is_active"] = False
                self._keep(row)
                out.append((key[0], row["posting_id"], row["content_hash"], int(row["seen"]), False, bool(row["is_canonical"]), None, False))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def job_stream(records: DataFrame, silence_s: int, delay: str = "0 seconds") -> DataFrame:
    """Changes of the postings' state from a stream of normalized records (fingerprint, identity, content_hash, last_seen_at); rows later than ``delay`` still count, only timers go by the watermark."""
    rows = records.withWatermark("last_seen_at", delay)
    rows = rows.select("fingerprint", "posting_id", "source", "company_slug", "source_job_id", "content_hash", F.unix_timestamp("last_seen_at").alias("seen"), "last_seen_at")
    return rows.groupBy("fingerprint").transformWithStateInPandas(Job(silence_s), CHANGES, "Update", "EventTime")
