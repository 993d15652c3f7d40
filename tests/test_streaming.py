"""The streamed log against the batch rules, with late and out-of-order files."""

import json
from datetime import datetime, timedelta, timezone

from sundown.operators import events as ev
from sundown.streaming import chain, logs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def row(campaign, n, kind, hours, before=None, key=None, payload=None):
    return (campaign, n, kind, START + timedelta(hours=hours), key or f"{campaign}{n}", before, f"{campaign}-{n}", json.dumps(payload or {}))


def land(spark, folder, *batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(list(rows), logs.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_state_equals_batch(spark, tmp_path, got):
    first = [row("a", 1, "CAMPAIGN_CREATED", 0), row("a", 3, "MIGRATION_STARTED", 2, "a-2")]
    second = [row("a", 2, "INVENTORY_RECORDED", 1, "a-1"), row("a", 3, "MIGRATION_STARTED", 2, "a-2"), row("b", 1, "CAMPAIGN_CREATED", 3)]
    land(spark, tmp_path / "log", first, second)
    stream = logs.read_log(spark, str(tmp_path / "log"))
    logs.write_updates(logs.stream_campaign_state(stream, "2 days"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    streamed = logs.latest(spark.read.parquet(str(tmp_path / "state")), ["campaign_id"])
    whole = ev.campaign_state(spark.createDataFrame(first + second[:1] + second[2:], logs.LOG_SCHEMA))
    names = ("campaign_id", "state", "events", "reconciled")
    assert got(streamed, *names) == got(whole, *names) and got(streamed, "missing") == [(0,), (0,)]


def audit(spark, folder, *batches, delay="12 hours", chunk=4):
    """The present first failures after each landed batch."""
    seen = []
    for rows in batches:
        land(spark, folder / "log", rows)
        found = chain.stream_chain_findings(logs.read_log(spark, str(folder / "log")), delay, chunk)
        logs.write_updates(found, str(folder / "out"), str(folder / "cp")).awaitTermination()
        seen.append(logs.present_failures(spark.read.schema(chain.OUTPUT + ", batch int").parquet(str(folder / "out"))))
    return seen


INVALID, MISMATCH, ROLLBACK = "INTEGRITY_EVENT_SEQUENCE_INVALID", "INTEGRITY_EVENT_CHAIN_MISMATCH", "RUNTIME_CLOCK_ROLLBACK"


def test_gap_fails_only_after_watermark(spark, tmp_path, got):
    early = [row("a", 1, "CAMPAIGN_CREATED", 0), row("a", 3, "MIGRATION_STARTED", 2, "a-2"), row("g", 1, "CAMPAIGN_CREATED", 0), row("g", 3, "CAMPAIGN_BLOCKED", 2, "g-2"),
             row("x", 1, "CAMPAIGN_CREATED", 0), row("x", 2, "CAMPAIGN_BLOCKED", 1, "broken"), row("n", 1, "CAMPAIGN_BLOCKED", 0)]
    later = [row("a", 2, "INVENTORY_RECORDED", 1, "a-1")]
    ends = [row("z", 1, "CAMPAIGN_CREATED", 500)], [row("z", 2, "CAMPAIGN_BLOCKED", 501, "z-1")]
    first, *_, last = [got(f) for f in audit(spark, tmp_path, early, later, *ends)]
    assert first == [("n", 1, INVALID), ("x", 2, MISMATCH)]
    assert last == [("g", 3, INVALID), ("n", 1, INVALID), ("x", 2, MISMATCH)]


def test_weeks_between_events_borders_of_chunks_and_retries(spark, tmp_path, got):
    week = 24 * 7

    def chain_of(campaign, count):
        return [row(campaign, n, "CAMPAIGN_CREATED" if n == 1 else "CAMPAIGN_BLOCKED", n * 3 * week, n > 1 and f"{campaign}-{n - 1}" or None)
                for n in range(1, count + 1)]

    whole, cut, back = chain_of("w", 9), chain_of("c", 9), chain_of("b", 6)
    del cut[4]
    back[4] = row("b", 5, "CAMPAIGN_BLOCKED", 6 * week, "b-4")
    other = row("o", 1, "CAMPAIGN_CREATED", 1, key="again")
    events = sorted(whole + cut + back + [row("o", 1, "CAMPAIGN_CREATED", 0), other[:6] + ("o-other",) + other[7:]], key=lambda r: r[3])
    parts = [events[i::3] for i in range(3)] + [whole[:2], [row("z", 1, "CAMPAIGN_CREATED", 20_000)], [row("z", 2, "CAMPAIGN_BLOCKED", 21_000, "z-1")]]
    last = got(audit(spark, tmp_path, *parts, delay="200 days")[-1])
    assert last == [("b", 5, ROLLBACK), ("c", 6, INVALID), ("o", 1, INVALID)]
    log = spark.createDataFrame(events, logs.LOG_SCHEMA)
    batch = ev.stream_audit(log, log.select("campaign_id").distinct()).filter("refusal_code IS NOT NULL")
    assert got(batch, "campaign_id", "failed_at", "refusal_code") == last


def test_a_predecessor_that_still_comes_takes_the_failure_back(spark, tmp_path, got):
    found = audit(
        spark, tmp_path, [row("a", 2, "CAMPAIGN_BLOCKED", 10, "a-1"), row("z", 1, "CAMPAIGN_CREATED", 15)], [row("z", 2, "CAMPAIGN_BLOCKED", 16, "z-1")],
        [row("a", 1, "CAMPAIGN_CREATED", 14.5)], delay="2 hours")
    assert [got(f) for f in found][1:] == [[("a", 2, INVALID)], [("a", 2, ROLLBACK)]]


def test_late_events_are_split_off_and_none_is_lost(spark, tmp_path, got):
    batches = ([row("a", 1, "CAMPAIGN_CREATED", 100)], [row("a", 2, "CAMPAIGN_BLOCKED", 99), row("b", 1, "CAMPAIGN_CREATED", 1), row("b", 2, "CAMPAIGN_BLOCKED", 90)],
               [row("b", 3, "CAMPAIGN_BLOCKED", 200)], [row("a", 9, "CAMPAIGN_RETIRED", 101, key="a1"), row("a", 10, "CAMPAIGN_RETIRED", 191)])
    land(spark, tmp_path / "log", *batches)
    log = logs.read_log(spark, str(tmp_path / "log"))
    logs.split_late(log, str(tmp_path / "side"), str(tmp_path / "cp"), "10 hours").awaitTermination()
    rows = logs.split_events(spark, str(tmp_path / "side"))
    assert got(rows.filter("late"), "campaign_id", "sequence") == [("a", 9), ("b", 1), ("b", 2)]
    assert got(rows, "idempotency_key") == sorted((r[4],) for b in batches for r in b)
    again = logs.split_late(log, str(tmp_path / "side"), str(tmp_path / "cp"), "10 hours")
    again.awaitTermination()
    assert rows.count() == 7
    assert spark.read.parquet(str(tmp_path / "side" / "border")).count() == 4


def test_conflicts(spark, tmp_path, got):
    land(spark, tmp_path / "log", [row("a", 1, "CAMPAIGN_CREATED", 100)], [row("a", 2, "CAMPAIGN_BLOCKED", 99)], [row("a", 9, "CAMPAIGN_RETIRED", 101, key="a1")])
    conflicts = logs.stream_conflicts(logs.read_log(spark, str(tmp_path / "log")), "30 days")
    logs.write_updates(conflicts, str(tmp_path / "clash"), str(tmp_path / "cp2")).awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "clash")), "idempotency_key") == [("a1",)]


def test_landed_files_grow_with_the_log(spark, make, tmp_path, monkeypatch):
    from sundown.plans import streaming_plans as sp
    from sundown.sources.tables import Tables

    make("event_id bigint", *[(i,) for i in range(90)]).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(sp, "FILE_ROWS", 10)
    assert sp.batch_files(Tables(spark, str(tmp_path))) == 3
