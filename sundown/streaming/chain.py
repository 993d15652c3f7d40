"""The chain audit of a streamed log: keyed state without a time bound.

A campaign's sequence is cut into chunks, each a state key of its own, so a campaign that holds a
large share of the stream is spread over the state partitions; the last event of a chunk is also
sent to the next one as the predecessor of its first. A key remembers one slot per sequence number
for good, so a predecessor may come weeks before or after its successor. A missing predecessor is
reported when the watermark passes the event that lacks it (a timer), and taken back if it still
comes: an update carries the present finding of its event, null when there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sundown.operators.events import kind

CHUNK = 1_024
OUTPUT = "campaign_id string, sequence bigint, check int, refusal_code string"
_INVALID, _MISMATCH, _ROLLBACK = "INTEGRITY_EVENT_SEQUENCE_INVALID", "INTEGRITY_EVENT_CHAIN_MISMATCH", "RUNTIME_CLOCK_ROLLBACK"
#: One entry per known sequence number; ``code`` is what was reported last, ``own`` false for the predecessor from the chunk before.
_SLOTS = (
    "sequence array<bigint>, digest array<string>, before array<string>, at array<bigint>, created array<boolean>, "
    "twice array<boolean>, own array<boolean>, code array<string>"
)
_FIELDS = ("sequence", "digest", "before", "at", "created", "twice", "own", "code")


def finding(slot: dict, earlier: dict | None, passed_us: int) -> str | None:
    """The first failing check of a slot, or null: it holds, or its predecessor may still come.

    The number before the code tells a broken stream (0) from a first event that creates nothing (1).
    """
    first = slot["sequence"] == 1
    if not first and earlier is None:
        return f"0{_INVALID}" if slot["at"] < passed_us else None
    if slot["before"] != (None if first else earlier["digest"]):
        return f"0{_MISMATCH}"
    if not first and slot["at"] < earlier["at"]:
        return f"0{_ROLLBACK}"
    if slot["twice"]:
        return f"0{_INVALID}"
    return f"1{_INVALID}" if first and not slot["created"] else None


class ChainAudit(StatefulProcessor):
    """State per (campaign, chunk)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slots", _SLOTS)

    def _slots(self) -> dict[int, dict]:
        if not self.state.exists():
            return {}
        columns = self.state.get()
        return {row[0]: dict(zip(_FIELDS, row, strict=True)) for row in zip(*columns, strict=True)}

    def _settle(self, key: tuple, slots: dict[int, dict], watermark_ms: int, touched: set[int] | None) -> Iterator[pd.DataFrame]:
        """Report what changed, remember all slots and ask to be woken for the earliest gap that is still open."""
        passed, rows, open_ = watermark_ms * 1000, [], []
        for number, slot in slots.items():
            if not slot["own"]:
                continue
            earlier = slots.get(number - 1)
            if touched is None or number in touched or number - 1 in touched:
                code = finding(slot, earlier, passed)
                if code != slot["code"]:
                    rows.append((key[0], number, int((code or "0")[0]), code and code[1:]))
                    slot["code"] = code
            if number > 1 and earlier is None and slot["code"] is None:
                open_.append(slot["at"])
        held = list(slots.values())
        self.state.update(tuple([s[f] for s in held] for f in _FIELDS))
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)
        if open_:
            self.handle.registerTimer(max(min(open_) // 1000, watermark_ms) + 1)
        if rows:
            found = pd.DataFrame(rows, columns=["campaign_id", "sequence", "check", "refusal_code"])
            yield found.astype({"sequence": "int64", "check": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots, touched = self._slots(), set()
        for frame in rows:
            columns = [frame[c].tolist() for c in ("sequence", "event_digest", "previous_event_digest", "at", "created", "own")]
            for number, digest, before, at, created, own in zip(*columns, strict=True):
                before = None if pd.isna(before) else before
                known = slots.get(number)
                twice = False
                if known is not None:
                    twice = known["twice"] or known["digest"] != digest
                    if known["digest"] <= digest:  # a retry, or another event of this number: the smaller digest stands for it
                        if twice != known["twice"]:
                            known["twice"] = twice
                            touched.add(number)
                        continue
                code = known["code"] if known is not None else None
                slots[number] = dict(zip(_FIELDS, (number, digest, before, at, created, twice, own, code), strict=True))
                touched.add(number)
        yield from self._settle(key, slots, timerValues.getCurrentWatermarkInMs(), touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._slots(), timerValues.getCurrentWatermarkInMs(), None)

    def close(self) -> None:
        pass


def stream_chain_findings(log: DataFrame, delay: str, chunk: int = CHUNK) -> DataFrame:
    """Updates (campaign_id, sequence, check, refusal_code) of every event whose finding changed.

    Retries, rows of one sequence number with the same digest, count once. Rows later than the
    watermark are left out by the operator; :func:`sundown.streaming.logs.split_late` keeps them.
    """
    rows = log.withWatermark("occurred_at", delay).select(
        "campaign_id", "sequence", "occurred_at", "event_digest", "previous_event_digest",
        F.unix_micros("occurred_at").alias("at"), (kind() == "CAMPAIGN_CREATED").alias("created"),
        F.floor(F.col("sequence") / chunk).alias("home"), F.floor((F.col("sequence") + 1) / chunk).alias("next"),
    )
    places = F.array_distinct(F.array("home", "next"))
    dealt = rows.select("*", F.explode(places).alias("chunk")).withColumn("own", F.col("chunk") == F.col("home"))
    return dealt.drop("home", "next").groupBy("campaign_id", "chunk").transformWithStateInPandas(
        statefulProcessor=ChainAudit(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )
