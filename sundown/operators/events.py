"""Event logs of many campaigns: audits of the stream, and folds into the present state.

A log is a DataFrame ``(campaign_id, sequence, event_type, occurred_at, idempotency_key,
previous_event_digest, event_digest, payload)`` with the payload as JSON text. Ordered
rules go through :func:`sundown.functions.ordered.sliced_before`, so one very long campaign
is worked on by many tasks and each rule evaluates its input once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sundown.functions.hashing import row_text
from sundown.functions.checks import differs, first_code, first_failure
from sundown.functions.ordered import CHUNK_ROWS, TIME_BITS, sliced_before
from sundown.operators.policy import AnyPolicy, CampaignPolicy, decide
from sundown.session import cut_lineage
from sundown.vocabulary import (
    CAMPAIGN_MOVES,
    CONSUMER_MOVES,
    DEDICATED_DISPOSITIONS,
    DISPOSITIONS,
    IMPORTABLE_DISPOSITIONS,
    OPEN_DISPOSITIONS,
    pairs,
)

# The payload fields the folds read.
PAYLOAD = (
    "consumers array<struct<id:string,disposition:string>>, consumer_ids array<string>, consumer_id string, "
    "disposition string, state string, decision string, blocker_codes array<string>, "
    "evidence_envelope struct<mode:string,sources:array<struct<id:string,required:boolean,status:string>>>, "
    "input_digests map<string,string>, receipt struct<receipt_digest:string,expires_at:string>, "
    "waiver struct<consumer_id:string>, "
    "policy struct<requires_live_evidence:boolean,require_reconciliation:boolean,allow_waivers:boolean,waivers_satisfy_closure:boolean>"
)
MEMBERSHIP = ("INVENTORY_RECORDED", "INVENTORY_EXTENDED", "RECONCILIATION_RECORDED")
INVENTORY = ("INVENTORY_RECORDED", "INVENTORY_EXTENDED")


def kind() -> Column:
    return F.col("event_type")


def slices_of(chunk_rows: int) -> dict[str, int]:
    """Slices of ``chunk_rows`` positions of a sequence, cut finer where one holds more rows."""
    return {"bits": max(0, (chunk_rows - 1).bit_length()), "rows": chunk_rows}


def typed(events: DataFrame) -> DataFrame:
    """The log with its payload parsed into column ``p``."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


# --- stream audits ------------------------------------------------------------------


def stream_audit(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """First failure of each campaign's stream: sequence, chain, time, then the creating event.

    The predecessor comes from an equality join on (campaign, sequence - 1), which
    spreads one long campaign over all tasks; up to the first failure the sequence is
    dense, so that is the preceding event.
    """
    slots = events.groupBy("campaign_id", "sequence").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by(
            F.struct("event_digest", "previous_event_digest", "occurred_at", "event_type"), "event_digest"
        ).alias("e"),
    )
    before = slots.select(
        "campaign_id",
        (F.col("sequence") + 1).alias("sequence"),
        F.col("e.event_digest").alias("digest_before"),
        F.col("e.occurred_at").alias("time_before"),
    )
    first = F.col("sequence") == 1
    code = first_code(
        [
            (~first & F.col("digest_before").isNull(), "INTEGRITY_EVENT_SEQUENCE_INVALID"),
            (differs("e.previous_event_digest", "digest_before"), "INTEGRITY_EVENT_CHAIN_MISMATCH"),
            (F.coalesce(F.col("e.occurred_at") < F.col("time_before"), F.lit(False)), "RUNTIME_CLOCK_ROLLBACK"),
            (F.col("copies") > 1, "INTEGRITY_EVENT_SEQUENCE_INVALID"),
        ]
    )
    checked = slots.join(before, ["campaign_id", "sequence"], "left").select(
        "campaign_id",
        "sequence",
        "copies",
        code.alias("code"),
        (first & (F.col("e.event_type") != "CAMPAIGN_CREATED")).alias("not_created"),
    )
    failed = F.col("code").isNotNull()
    per_campaign = checked.groupBy("campaign_id").agg(
        F.sum("copies").cast("bigint").alias("events"),
        F.min_by("code", F.when(failed, F.col("sequence"))).alias("stream_code"),
        F.min(F.when(failed, F.col("sequence"))).alias("stream_at"),
        F.max("not_created").alias("not_created"),
    )
    invalid = F.lit("INTEGRITY_EVENT_SEQUENCE_INVALID")
    return campaigns.select("campaign_id").join(per_campaign, "campaign_id", "left").select(
        "campaign_id",
        F.coalesce("events", F.lit(0).cast("bigint")).alias("events"),
        F.when(F.col("events").isNull(), invalid)
        .when(F.col("stream_code").isNotNull(), F.col("stream_code"))
        .when(F.col("not_created"), invalid)
        .alias("refusal_code"),
        F.when(F.col("events").isNull(), F.lit(0))
        .when(F.col("stream_code").isNotNull(), F.col("stream_at"))
        .when(F.col("not_created"), F.lit(1))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("failed_at"),
    )


def idempotent_dedupe(arrivals: DataFrame) -> DataFrame:
    """One row per (campaign, idempotency key): the first arrival, or a conflict when contents differ."""
    content = F.sha2(row_text(("event_type", "payload")), 256)
    return (
        arrivals.withColumn("_h", content)
        .groupBy("campaign_id", "idempotency_key")
        .agg(
            F.count(F.lit(1)).alias("arrivals"),
            (F.min("_h") != F.max("_h")).alias("_conflict"),
            F.min_by(F.struct("sequence", "event_type", "payload"), F.struct("sequence", "_h")).alias("_kept"),
        )
        .select(
            "campaign_id",
            "idempotency_key",
            "arrivals",
            "_kept.*",
            F.when(F.col("_conflict"), F.lit("INTEGRITY_IDEMPOTENCY_CONFLICT")).alias("refusal_code"),
        )
    )


def state_after() -> Column:
    """Campaign state an event leads to; null for events that leave it alone."""
    return (
        F.when(kind() == "CAMPAIGN_CREATED", F.lit("PROPOSED"))
        .when(kind() == "INVENTORY_RECORDED", F.lit("INVENTORIED"))
        .when(kind() == "MIGRATION_STARTED", F.lit("MIGRATING"))
        .when(kind() == "RECONCILIATION_RECORDED", F.lit("RECONCILING"))
        .when(
            kind() == "POLICY_EVALUATED",
            F.when(F.col("p.decision") == "READY_TO_RETIRE", F.lit("READY")).otherwise(F.lit("BLOCKED")),
        )
        .when(kind() == "CAMPAIGN_BLOCKED", F.lit("BLOCKED"))
        .when(kind() == "CAMPAIGN_RESUMED", F.col("p.state"))
        .when(kind() == "CAMPAIGN_RETIRED", F.lit("RETIRED"))
    )


def campaign_transitions(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First illegal state change of each campaign; campaigns without one are absent."""
    moves = typed(events).select("campaign_id", "sequence", "event_type", state_after().alias("to_state"))
    moves = moves.filter(F.col("to_state").isNotNull() | (kind() == "INVENTORY_EXTENDED"))
    placed = sliced_before(moves, ["campaign_id"], ["sequence"], **slices_of(chunk_rows), last={"from_state": F.col("to_state")})
    prior = F.coalesce("from_state", F.lit(""))
    legal = (
        F.when(kind() == "CAMPAIGN_CREATED", F.lit(True))
        .when(kind() == "INVENTORY_EXTENDED", prior.isin("INVENTORIED", "MIGRATING", "BLOCKED"))
        .when((kind() == "INVENTORY_RECORDED") & (prior == "INVENTORIED"), F.lit(True))
        .otherwise(F.concat_ws(">", prior, "to_state").isin(*pairs(CAMPAIGN_MOVES)))
    )
    return first_failure(
        placed.filter(~legal), ["campaign_id"], ["sequence"], ["sequence", "event_type", "from_state", "to_state"]
    ).withColumn("refusal_code", F.lit("POLICY_ILLEGAL_CAMPAIGN_TRANSITION"))


# --- consumers ----------------------------------------------------------------------


def annotate(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each event with what was in force at it: inventory epoch, reconciliation, envelope, inputs.

    ``epoch`` is the sequence of the last recorded inventory, which starts the consumer
    set anew; ``recon`` that of the last reconciliation since, 0 when there is none.
    The consumer rules read this several times, so it is written to the checkpoint folder.
    """
    parsed = typed(events).select("campaign_id", "sequence", "event_type", "occurred_at", "p")
    sequence = F.col("sequence").cast("bigint")
    zero = F.lit(0).cast("bigint")
    placed = sliced_before(
        parsed,
        ["campaign_id"],
        ["sequence"],
        **slices_of(chunk_rows),
        last={
            "epoch": F.when(kind() == "INVENTORY_RECORDED", sequence),
            "recon": F.when(kind() == "RECONCILIATION_RECORDED", sequence).when(kind() == "INVENTORY_RECORDED", zero),
            "envelope": F.when(kind().isin(*MEMBERSHIP), F.col("p.evidence_envelope")),
            "reconciled": F.when(kind().isin(*MEMBERSHIP), kind() == "RECONCILIATION_RECORDED"),
        },
        first={
            "inputs": F.when(kind() == "CAMPAIGN_CREATED", F.array_sort(F.map_entries("p.input_digests"))),
            "policy": F.when(kind() == "CAMPAIGN_CREATED", F.col("p.policy")),
        },
        include_current=True,
    )
    named = placed.withColumn("epoch", F.coalesce("epoch", zero)).withColumn("recon", F.coalesce("recon", zero))
    return cut_lineage(
        named.select("campaign_id", "sequence", "event_type", "occurred_at", "p", "epoch", "recon", "envelope", "reconciled", "inputs", "policy")
    )


_SHARED = ["campaign_id", "epoch", "recon", "sequence", "event_type", "occurred_at"]


def _listed(annotated: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Every (event, consumer) pair of the events that list consumers."""
    no_receipt = F.lit(None).cast("struct<receipt_digest:string,expires_at:string>")
    return (
        annotated.filter(kind().isin(*kinds))
        .select(*_SHARED, F.explode("p.consumers").alias("c"))
        .select(*_SHARED, F.lit(True).alias("member"), F.col("c.id").alias("consumer_id"),
                F.col("c.disposition").alias("requested"), no_receipt.alias("receipt"))
    )


def _raw_touches(annotated: DataFrame) -> DataFrame:
    """Every (event, consumer) pair that may add a consumer or change its disposition."""
    changes = annotated.filter(
        kind().isin("CONSUMER_DISPOSITION_CHANGED", "WAIVER_RECORDED", "RECEIPT_ACCEPTED")
    ).select(
        *_SHARED,
        F.lit(False).alias("member"),
        F.when(kind() == "WAIVER_RECORDED", F.col("p.waiver.consumer_id")).otherwise(F.col("p.consumer_id")).alias("consumer_id"),
        F.when(kind() == "WAIVER_RECORDED", F.lit("WAIVED"))
        .when(kind() == "RECEIPT_ACCEPTED", F.lit("VALIDATED"))
        .otherwise(F.col("p.disposition"))
        .alias("requested"),
        F.when(kind() == "RECEIPT_ACCEPTED", F.col("p.receipt")).alias("receipt"),
    )
    return _listed(annotated, MEMBERSHIP).unionByName(changes)


_CONSUMER = ["campaign_id", "epoch", "consumer_id"]


def consumer_touches(annotated: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Touches that took effect, with the disposition before; and changes of unknown consumers.

    In one epoch the first listing of a consumer adds it and later listings change
    nothing; a change needs the consumer to be there.
    """
    cut = slices_of(chunk_rows)
    seen = sliced_before(
        _raw_touches(annotated), _CONSUMER, ["sequence"], **cut, first={"since": F.when(F.col("member"), F.col("sequence"))}
    )
    effective = seen.filter(F.col("member") == F.col("since").isNull()).drop("since")
    unknown = seen.filter(~F.col("member") & F.col("since").isNull()).drop("since")
    return sliced_before(effective, _CONSUMER, ["sequence"], **cut, last={"prior": F.col("requested")}), unknown


def consumer_transitions(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First illegal consumer change of each campaign; campaigns without one are absent."""
    annotated = annotate(events, chunk_rows)
    touches, unknown = consumer_touches(annotated, chunk_rows)
    illegal = F.lit("POLICY_ILLEGAL_CONSUMER_TRANSITION")
    kept = ["campaign_id", "sequence", "check", "consumer_id", "from_disposition", "to_disposition", "refusal_code"]
    ids = F.transform("p.consumers", lambda c: c["id"])
    repeated = annotated.filter(kind().isin(*INVENTORY) & (F.size(F.array_distinct(ids)) != F.size(ids))).select(
        "campaign_id", "sequence", F.lit(0).alias("check"), F.lit("").alias("consumer_id"),
        F.lit("").alias("from_disposition"), F.lit("").alias("to_disposition"), F.lit("IDENTITY_AMBIGUOUS").alias("refusal_code"))
    imported = _listed(annotated, INVENTORY).filter(~F.col("requested").isin(*IMPORTABLE_DISPOSITIONS)).select("campaign_id", "sequence", F.lit(1).alias("check"), "consumer_id", F.lit("").alias("from_disposition"),
             F.col("requested").alias("to_disposition"), illegal.alias("refusal_code"))
    missing = unknown.select(
        "campaign_id", "sequence", F.lit(2).alias("check"), "consumer_id", F.lit("").alias("from_disposition"),
        F.col("requested").alias("to_disposition"), F.lit("IDENTITY_NOT_FOUND").alias("refusal_code"))
    undedicated = (kind() == "CONSUMER_DISPOSITION_CHANGED") & F.col("requested").isin(*DEDICATED_DISPOSITIONS)
    moved = touches.filter(
        ~F.col("member")
        & (undedicated | ~F.concat_ws(">", "prior", "requested").isin(*pairs(CONSUMER_MOVES)))
    ).select("campaign_id", "sequence", F.lit(3).alias("check"), "consumer_id", F.col("prior").alias("from_disposition"),
             F.col("requested").alias("to_disposition"), illegal.alias("refusal_code"))
    failures = repeated.unionByName(imported).unionByName(missing).unionByName(moved)
    return first_failure(failures.select(*kept), ["campaign_id"], ["sequence", "check", "consumer_id"], kept[1:]).drop("check")


# Fixed value: what a part of the campaign fold holds beside its campaign.
FOLD = (
    "state struct<at:bigint,value:string>, last_event_at timestamp, events bigint, reconciled struct<at:bigint,value:boolean>, "
    "envelope struct<at:bigint,value:struct<mode:string,sources:array<struct<id:string,required:boolean,status:string>>>>, "
    "epoch bigint, snapshots bigint, receipts bigint, head struct<at:bigint,value:string>, "
    "policy struct<at:bigint,value:struct<requires_live_evidence:boolean,require_reconciliation:boolean,allow_waivers:boolean,"
    "waivers_satisfy_closure:boolean>>"
)


def _held(value: Column, condition: Column) -> Column:
    """The value with the place it was set at, where it was set."""
    return F.when(condition, F.struct(F.col("sequence").cast("bigint").alias("at"), value.alias("value")))


def campaign_fold(events: DataFrame) -> DataFrame:
    """A part of the campaign fold: mergeable, so any split of a log folds to the same state.

    A part keeps for every value the sequence number that set it, so parts can be merged in any
    order (:func:`merge_folds`), stored, and continued with later events only.
    """
    after = state_after()
    membership = kind().isin(*MEMBERSHIP)
    zero = F.lit(0).cast("bigint")
    return typed(events).groupBy("campaign_id").agg(
        F.max(_held(after, after.isNotNull())).alias("state"),
        F.max("occurred_at").alias("last_event_at"),
        F.count(F.lit(1)).alias("events"),
        F.max(_held(kind() == "RECONCILIATION_RECORDED", membership)).alias("reconciled"),
        F.max(_held(F.col("p.evidence_envelope"), membership & F.col("p.evidence_envelope").isNotNull())).alias("envelope"),
        F.coalesce(F.max(F.when(kind() == "INVENTORY_RECORDED", F.col("sequence").cast("bigint"))), zero).alias("epoch"),
        F.count_if(membership).alias("snapshots"),
        F.count_if(kind() == "RECEIPT_ACCEPTED").alias("receipts"),
        F.max(_held(F.col("event_digest"), F.lit(True))).alias("head"),
        F.min(_held(F.col("p.policy"), kind() == "CAMPAIGN_CREATED")).alias("policy"),
    )


def merge_folds(parts: DataFrame) -> DataFrame:
    """One part per campaign from any number of them, of events that no two parts share."""
    added = ("events", "snapshots", "receipts")
    latest = ("state", "last_event_at", "reconciled", "envelope", "epoch", "head")
    merged = parts.groupBy("campaign_id").agg(
        *[F.max(c).alias(c) for c in latest], *[F.sum(c).alias(c) for c in added], F.min("policy").alias("policy"))
    return merged.select(parts.columns)


def finish_fold(parts: DataFrame) -> DataFrame:
    """The present state that one part per campaign stands for."""
    return parts.select(
        "campaign_id", F.col("state.value").alias("state"), "last_event_at", "events",
        F.coalesce("reconciled.value", F.lit(False)).alias("reconciled"), F.col("envelope.value").alias("envelope"), "epoch", "snapshots",
        "receipts", F.col("head.value").alias("head_digest"), F.col("policy.value").alias("policy"),
    )


def campaign_state(events: DataFrame) -> DataFrame:
    """Present state of each campaign by partial aggregation; no ordering of the log is needed."""
    return finish_fold(campaign_fold(events))


def continue_fold(stored: DataFrame, later: DataFrame) -> DataFrame:
    """A stored fold and the events since: reads nothing of the log before them."""
    return merge_folds(stored.unionByName(campaign_fold(later)))


def consumer_state(annotated: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Present consumers of each campaign with disposition and last accepted receipt, from annotated events."""
    touches, _ = consumer_touches(annotated, chunk_rows)
    folded = touches.groupBy(*_CONSUMER).agg(
        F.max_by("requested", "sequence").alias("disposition"),
        F.max_by("receipt.receipt_digest", F.when(F.col("receipt").isNotNull(), F.col("sequence"))).alias("receipt_digest"),
        F.min("sequence").alias("added_at"),
    )
    present = annotated.groupBy("campaign_id").agg(F.max("epoch").alias("epoch"))
    return folded.join(present, ["campaign_id", "epoch"], "left_semi").select(
        "campaign_id", "consumer_id", "disposition", "receipt_digest", "added_at"
    )


def _late_consumers(annotated: DataFrame) -> DataFrame:
    """When consumers of a reconciliation are outside the inventory: +1 as it lists them, -1 as they are added."""
    first_listed = (
        _listed(annotated, INVENTORY).groupBy(*_CONSUMER)
        .agg(F.min(F.struct(F.col("sequence").alias("at"), F.col("recon").alias("in_recon"))).alias("listed"))
    )
    observed = (
        annotated.filter(kind() == "RECONCILIATION_RECORDED")
        .select("campaign_id", "epoch", "recon", "sequence", F.explode(F.array_distinct("p.consumer_ids")).alias("consumer_id"))
        .join(first_listed, _CONSUMER, "left")
        .filter(F.col("listed").isNull() | (F.col("listed.at") > F.col("sequence")))
    )
    closes = F.col("listed.in_recon") == F.col("recon")
    steps = F.array_compact(F.array(
        F.struct(F.col("sequence").cast("bigint").alias("sequence"), F.lit(1).cast("bigint").alias("step")),
        F.when(closes, F.struct(F.col("listed.at").cast("bigint").alias("sequence"), F.lit(-1).cast("bigint").alias("step"))),
    ))
    return observed.select("campaign_id", "epoch", "recon", "consumer_id", F.explode(steps).alias("s")).select(
        "campaign_id", "epoch", "recon", "consumer_id", "s.*")


def new_consumer_state(annotated: DataFrame) -> DataFrame:
    """Consumers that the last reconciliation showed and no inventory holds yet, from annotated events."""
    last = annotated.groupBy("campaign_id").agg(F.max(F.struct("epoch", "recon")).alias("_l")).select(
        "campaign_id", "_l.epoch", "_l.recon")
    open_steps = _late_consumers(annotated).groupBy("campaign_id", "epoch", "recon", "consumer_id").agg(F.sum("step").alias("n"))
    return open_steps.filter("n > 0").join(last, ["campaign_id", "epoch", "recon"], "left_semi").select("campaign_id", "consumer_id")


def stream_digest(events: DataFrame, width: int = 1024, levels: int = 4) -> DataFrame:
    """One digest over the ordered event digests of a campaign, as a tree.

    Each level hashes at most ``width`` digests together, so no campaign becomes one row or one
    task. There are at least ``levels``, and as many more as the largest sequence needs, so every
    campaign ends as one digest.
    """
    largest = events.agg(F.max("sequence")).first()[0] or 0
    while largest >= width**levels:
        levels += 1
    level = events.select("campaign_id", F.col("sequence").cast("bigint").alias("n"), F.col("event_digest").alias("d"))
    for _ in range(levels):
        level = (
            level.groupBy("campaign_id", F.floor(F.col("n") / width).alias("n"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("at"), "d"))).alias("g"))
            .select("campaign_id", "n", F.sha2(F.concat_ws(",", F.transform("g", lambda x: x["d"])), 256).alias("d"))
        )
    return level.select("campaign_id", F.col("d").alias("stream_digest"))


def digest_verify(records: DataFrame, raw: str, field: str) -> DataFrame:
    """Whether the digest in each raw JSON text is that of its canonical form without the digest."""

    @pandas_udf("boolean")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib
        import json

        def check(text: str | None) -> bool:
            try:
                value = json.loads(text or "")
                recorded = value.pop(field, None)
                canonical = json.dumps(value, allow_nan=False, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
            except (ValueError, AttributeError, RecursionError):
                return False
            return recorded == "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()

        for texts in batches:
            yield texts.map(check).astype(bool)

    return records.withColumn("digest_valid", matches(F.col(raw)))


def materialised_audit(cache: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """Cached histories against the log.

    ``cache``: campaign_id, state, recorded_state. ``history``: one row per cached event
    (campaign_id, position, event_digest). The history must be a prefix of the log; a
    complete one must carry the replayed state.
    """
    replayed = campaign_state(events).select("campaign_id", F.col("state").alias("replayed_state"), "events")
    log = events.select("campaign_id", F.col("sequence").alias("position"), F.col("event_digest").alias("log_digest"))
    compared = history.join(log, ["campaign_id", "position"], "left").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("cached_events"), F.count_if(differs("event_digest", "log_digest")).alias("wrong")
    )
    zero = F.lit(0).cast("bigint")
    code = first_code(
        [
            (F.coalesce("wrong", zero) > 0, "NOT_A_REPLAY_PREFIX"),
            (
                (F.coalesce("cached_events", zero) == F.coalesce("events", zero)) & differs("state", "replayed_state"),
                "REPLAY_DIFFERS",
            ),
            (differs("state", "recorded_state"), "RECORDED_STATE_DIFFERS"),
        ]
    )
    return cache.join(compared, "campaign_id", "left").join(replayed, "campaign_id", "left").select(
        "campaign_id",
        F.coalesce("cached_events", zero).alias("cached_events"),
        F.coalesce("events", zero).alias("log_events"),
        code.alias("finding"),
        F.when(code.isNotNull(), F.lit("INTEGRITY_MATERIALIZED_STATE_MISMATCH")).alias("refusal_code"),
    )


def ledger_column_audit(ledger: DataFrame, raw: str = "event_json") -> DataFrame:
    """Ledger rows whose columns disagree with the event they store as JSON."""
    columns = ("sequence", "event_type", "idempotency_key", "event_digest")
    stored = F.from_json(raw, "sequence bigint, event_type string, idempotency_key string, event_digest string")
    wrong = F.concat_ws(",", *[F.when(differs(F.col(c), F.col(f"_j.{c}")), F.lit(c)) for c in columns])
    return ledger.withColumn("_j", stored).withColumn("wrong_columns", wrong).filter("wrong_columns <> ''").select(
        "campaign_id", "sequence", "wrong_columns"
    )


def identity_overlap(claims: DataFrame) -> DataFrame:
    """Native identities actively claimed by more than one campaign."""
    return (
        claims.filter("released_at IS NULL").select("native_identity", "campaign_id").distinct()
        .groupBy("native_identity").agg(F.count(F.lit(1)).alias("campaigns"))
        .filter("campaigns > 1")
        .withColumn("refusal_code", F.lit("SOURCE_CONSUMER_OVERLAP"))
    )


def publication_audit(publications: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First failure among each campaign's publication events.

    Rows: campaign_id, sequence, event_type, logical_key, urn, content_digest,
    lifecycle_digest (before for a publication, after for a verification).
    """
    recorded = kind() == "PUBLICATION_RECORDED"
    placed = sliced_before(
        publications, ["campaign_id"], ["sequence"], **slices_of(chunk_rows),
        last={"before": F.when(recorded, F.struct("logical_key", "urn", "content_digest", "lifecycle_digest"))},
    )
    known = F.col("before").isNotNull()
    code = first_code(
        [
            (recorded & known & differs("logical_key", "before.logical_key"), "INTEGRITY_DIGEST_MISMATCH"),
            (recorded & known & differs("urn", "before.urn"), "INTEGRITY_DIGEST_MISMATCH"),
            (~recorded & ~known, "INTEGRITY_EVENT_SEQUENCE_INVALID"),
            (
                ~recorded
                & (
                    differs("urn", "before.urn")
                    | differs("content_digest", "before.content_digest")
                    | differs("lifecycle_digest", "before.lifecycle_digest")
                ),
                "EVIDENCE_PUBLICATION_MISMATCH",
            ),
        ]
    )
    failing = placed.withColumn("refusal_code", code).filter("refusal_code IS NOT NULL")
    return first_failure(failing, ["campaign_id"], ["sequence"], ["sequence", "event_type", "refusal_code"])


def state_at_publication(events: DataFrame, publications: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per content digest: its last publication and the campaign state just before it."""
    none = F.lit(None).cast("string")
    steps = typed(events).select(
        "campaign_id", "sequence", F.lit(1).alias("tie"), state_after().alias("_s"), none.alias("content_digest"))
    # A publication stands before the event that carries its own sequence.
    marks = publications.select("campaign_id", "sequence", F.lit(0).alias("tie"), none.alias("_s"), "content_digest")
    placed = sliced_before(
        steps.unionByName(marks), ["campaign_id"], ["sequence", "tie"], **slices_of(chunk_rows),
        last={"state_before": F.col("_s")},
    )
    return (
        placed.filter("content_digest IS NOT NULL").groupBy("campaign_id", "content_digest")
        .agg(F.max(F.struct("sequence", "state_before")).alias("_p"))
        .select("campaign_id", "content_digest", "_p.sequence", "_p.state_before")
    )


# --- policy at every evaluation -----------------------------------------------------


def _disposition_counts(touches: DataFrame, evaluations: DataFrame, chunk_rows: int) -> DataFrame:
    """The evaluations with how many consumers stood in each disposition then: running sums of changes."""
    change = {
        d: F.sum((F.col("requested") == d).cast("bigint") - F.coalesce(F.col("prior") == d, F.lit(False)).cast("bigint"))
        for d in DISPOSITIONS
    }
    steps = touches.groupBy("campaign_id", "epoch", "sequence").agg(*[c.alias(d) for d, c in change.items()])
    marks = evaluations.withColumn("mark", F.lit(True))
    placed = sliced_before(
        marks.unionByName(steps, allowMissingColumns=True), ["campaign_id", "epoch"], ["sequence"], **slices_of(chunk_rows),
        total={f"n_{d}": F.col(d) for d in DISPOSITIONS},
    )
    return placed.filter("mark").select(*evaluations.columns, *[f"n_{d}" for d in DISPOSITIONS])


def _new_counts(annotated: DataFrame, evaluations: DataFrame, chunk_rows: int) -> DataFrame:
    steps = _late_consumers(annotated).groupBy("campaign_id", "epoch", "recon", "sequence").agg(F.sum("step").alias("step"))
    marks = evaluations.select("campaign_id", "epoch", "recon", "sequence", F.lit(True).alias("mark"))
    placed = sliced_before(
        marks.unionByName(steps, allowMissingColumns=True), ["campaign_id", "epoch", "recon"], ["sequence"], **slices_of(chunk_rows),
        total={"added": F.col("step")},
    )
    return placed.filter("mark").select("campaign_id", "sequence", "added")


def _expired_counts(touches: DataFrame, evaluations: DataFrame, chunk_rows: int) -> DataFrame:
    """Accepted receipts past their expiry at each evaluation, a later receipt replacing an earlier one."""
    cut = slices_of(chunk_rows)
    accepted = touches.filter("receipt IS NOT NULL").select(
        *_CONSUMER, "sequence", (-F.col("sequence")).alias("_back"), F.col("occurred_at").alias("at"),
        F.col("receipt.expires_at").try_cast("timestamp").alias("expires"))
    followed = sliced_before(accepted, _CONSUMER, ["_back"], **cut, last={"next": F.struct("at", "sequence")}).filter("expires IS NOT NULL")
    when = F.greatest("expires", "at")
    tie = F.when(F.col("expires") > F.col("at"), F.lit(-1)).otherwise(F.col("sequence")).cast("bigint")
    fires = followed.filter(F.col("next").isNull() | (F.col("next.at") > when))
    steps = F.array_compact(F.array(
        F.struct(when.alias("at"), tie.alias("tie"), F.lit(1).cast("bigint").alias("step")),
        F.when(F.col("next").isNotNull(), F.struct(
            F.col("next.at").alias("at"), F.col("next.sequence").cast("bigint").alias("tie"), F.lit(-1).cast("bigint").alias("step"))),
    ))
    moves = fires.select("campaign_id", "epoch", F.explode(steps).alias("s")).select("campaign_id", "epoch", "s.*")
    sequence = F.col("sequence").cast("bigint")
    marks = evaluations.select(
        "campaign_id", "epoch", F.col("occurred_at").alias("at"), sequence.alias("tie"), sequence.alias("sequence"))
    placed = sliced_before(
        marks.unionByName(moves, allowMissingColumns=True), ["campaign_id", "epoch"], ["at", "tie"], position=F.unix_micros("at"), bits=TIME_BITS,
        rows=chunk_rows, total={"expired": F.col("step")},
    )
    return placed.filter("sequence IS NOT NULL").select("campaign_id", "sequence", "expired")


def code_counts(codes: Column) -> Column:
    """A list of codes as sorted ``CODE:count`` text, so multisets compare as strings."""
    return F.concat_ws(",", F.transform(
        F.array_sort(F.array_distinct(codes)),
        lambda c: F.concat(c, F.lit(":"), F.size(F.filter(codes, lambda x: x == c)).cast("string")),
    ))


def policy_event_audit(events: DataFrame, policy: AnyPolicy = CampaignPolicy(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every recorded evaluation against the policy recomputed on the state just before it.

    The policy is that of the campaign's creating event unless one is given for all.

    Nothing is replayed per evaluation: consumers per disposition, late consumers and
    expired receipts are running sums over the changes, so the work grows with the log.
    """
    annotated = annotate(events, chunk_rows)
    touches = cut_lineage(consumer_touches(annotated, chunk_rows)[0])
    evaluations = annotated.filter(kind() == "POLICY_EVALUATED").select(
        "campaign_id", "epoch", "recon", "sequence", "occurred_at", "p", "envelope", "reconciled", "inputs", "policy")
    key = ["campaign_id", "sequence"]

    def n(*names: str) -> Column:
        return sum((F.col(f"n_{d}") for d in names), start=F.lit(0).cast("bigint"))

    required = F.filter("envelope.sources", lambda s: s["required"])
    size = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("bigint")
    facts = (
        _disposition_counts(touches, evaluations, chunk_rows)
        .join(_new_counts(annotated, evaluations, chunk_rows), key)
        .join(_expired_counts(touches, evaluations, chunk_rows), key)
        .select(
            *key, "p", "inputs", "policy", "added", "expired", *[f"n_{d}" for d in DISPOSITIONS],
            F.col("envelope.mode").alias("mode"),
            F.coalesce("reconciled", F.lit(False)).alias("reconciled"),
            F.lit(True).alias("inputs_match"),
            F.when(F.col("envelope").isNotNull(), size(required)).otherwise(F.lit(0)).cast("bigint").alias("required_sources"),
            F.when(F.col("envelope").isNotNull(), size(F.filter(required, lambda s: ~s["status"].eqNullSafe(F.lit("COMPLETE")))))
            .otherwise(F.lit(0)).cast("bigint").alias("incomplete_sources"),
            n(*DISPOSITIONS).alias("consumers"),
            n("WAIVED").alias("waived"),
            n("UNRESOLVED").alias("unresolved"),
            n(*OPEN_DISPOSITIONS).alias("unsafe"),
            F.lit(0).cast("bigint").alias("unknown"),
            F.lit(0).cast("bigint").alias("reviews"),
        )
    )
    one = F.lit(1)
    no_source = F.col("mode").isNull() | (F.col("required_sources") == 0)
    counts = {
        "EVIDENCE_EMPTY_RESULT_UNPROVEN": F.when(F.col("consumers") == 0, one),
        "EVIDENCE_MODE_NOT_LIVE": F.when(policy.flag("requires_live_evidence") & (F.col("mode") != "live"), one),
        "EVIDENCE_RECEIPT_EXPIRED": F.col("expired"),
        "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE": F.when(no_source, one).otherwise(F.col("incomplete_sources")),
        "IDENTITY_NOT_FOUND": F.col("unresolved"),
        **{f"POLICY_CONSUMER_{d}": F.col(f"n_{d}") for d in sorted(OPEN_DISPOSITIONS)},
        "POLICY_WAIVER_FORBIDDEN": F.when(~policy.flag("allow_waivers"), F.col("waived")),
        "RECONCILIATION_NEW_CONSUMER": F.col("added"),
        "RECONCILIATION_REQUIRED": F.when(policy.flag("require_reconciliation") & ~F.col("reconciled"), one),
    }
    expected_codes = F.concat_ws(",", *[F.when(c > 0, F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in counts.items()])
    decided = decide(facts, policy, keys=(*key, "p", "inputs", "expired", expected_codes.alias("expected_codes")))
    decision = F.when((F.col("expired") > 0) & (F.col("decision") != "UNSAFE"), F.lit("BLOCKED")).otherwise(F.col("decision"))
    recorded_inputs = F.array_sort(F.map_entries("p.input_digests"))
    code = first_code(
        [
            (differs(F.col("inputs"), recorded_inputs), "POLICY_INPUT_DRIFT"),
            (
                differs("recorded_decision", "expected_decision") | differs("recorded_codes", "expected_codes"),
                "POLICY_EVENT_DECISION_MISMATCH",
            ),
        ]
    )
    return (
        decided.withColumn("expected_decision", decision)
        .withColumn("recorded_decision", F.col("p.decision"))
        .withColumn("recorded_codes", code_counts(F.coalesce("p.blocker_codes", F.array().cast("array<string>"))))
        .select(*key, "recorded_decision", "expected_decision", "recorded_codes", "expected_codes", code.alias("refusal_code"))
    )

