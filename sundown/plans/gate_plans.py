"""Record audits over orders, and reconciliation and gate queries over customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.operators import gate as g
from sundown.operators import policy as p
from sundown.operators import records as r
from sundown.plans import policy_plans as pp
from sundown.plans.lineage_plans import last_orders
from sundown.plans.twin import twin, view
from sundown.sources.tables import Tables

NOW = "2000-01-01 00:00:00"
GATE_NOW = "2001-08-01 00:00:00"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def gate_now() -> Column:
    return F.to_timestamp(F.lit(GATE_NOW))


def o() -> Column:
    return F.col("o_orderkey")


def c() -> Column:
    return F.col("c_custkey")


def _text_time(moment: Column) -> Column:
    """The moment as text in one of three zone forms; for a few rows without zone or with an impossible month."""
    return (
        F.when(o() % 97 == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(o() % 89 == 0, F.lit("2000-13-01T00:00:00Z"))
        .when(o() % 3 == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(o() % 3 == 1, F.date_format(F.timestamp_add("HOUR", F.lit(2), moment), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.date_format(F.timestamp_add("MINUTE", F.lit(-330), moment), "yyyy-MM-dd'T'HH:mm:ss.SSS'-0530'"))
    )


def fault() -> Column:
    """The number that decides which faults a record has."""
    return F.col("fault")


def order_times(t: Tables) -> DataFrame:
    """Orders with the times their records carry."""
    at = F.col("o_orderdate").cast("timestamp")
    until = F.timestamp_add("DAY", (o() % 1500).cast("int"), at)
    return t.orders.select(
        "o_orderkey", "o_custkey", o().alias("fault"),
        _text_time(at).alias("begins"),
        F.when(o() % 13 != 0, _text_time(until)).alias("ends"),
        F.when(o() % 5 == 0, F.lit("2000-02-01T00:00:00Z")).when(o() % 5 == 1, F.lit("1999-12-31T23:00:00Z")).alias("trusted"),
    )


RECEIPT_CLASS, APPROVAL_CLASS = 3, 5


def gate_times(t: Tables, faulty_class: int) -> DataFrame:
    """Orders with records made in the quarter of an hour before the gate; only campaigns of one class of 8 have faults."""
    faulty = F.col("o_custkey") % 8 == faulty_class
    at = F.timestamp_add("SECOND", (o() % 900).cast("int") * -1, gate_now())
    until = F.timestamp_add("SECOND", F.when(faulty & (o() % 7 == 0), 0).otherwise(600), gate_now())
    text = lambda moment: F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.orders.select(
        "o_orderkey", "o_custkey", F.when(faulty, o()).otherwise(1).alias("fault"), text(at).alias("begins"), text(until).alias("ends"),
        F.lit(None).cast("string").alias("trusted"))


view("order_times", f"""
SELECT *, o_orderkey AS fault, o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 AS unreadable, TIMESTAMP '{NOW}' AS now,
       CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 1500 AS INT)) END AS until,
       CASE o_orderkey % 5 WHEN 0 THEN TIMESTAMP '2000-02-01' WHEN 1 THEN TIMESTAMP '1999-12-31 23:00:00' END AS trusted FROM orders
""")


def _gate_times_view(faulty_class: int) -> str:
    return f"""
SELECT o_orderkey, o_custkey, TIMESTAMP '{GATE_NOW}' - to_seconds(o_orderkey % 900) AS o_orderdate, false AS unreadable, TIMESTAMP '{GATE_NOW}' AS now,
       CASE WHEN o_custkey % 8 = {faulty_class} THEN o_orderkey ELSE 1 END AS fault, CAST(NULL AS TIMESTAMP) AS trusted,
       TIMESTAMP '{GATE_NOW}' + to_seconds(CASE WHEN o_custkey % 8 = {faulty_class} AND o_orderkey % 7 = 0 THEN 0 ELSE 600 END) AS until FROM orders
"""


view("gate_receipt_times", _gate_times_view(RECEIPT_CLASS))
view("gate_approval_times", _gate_times_view(APPROVAL_CLASS))


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def approvals(t: Tables, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A request per order and the approvals submitted for it: none, one, or a corrected second one."""
    times = order_times(t) if times is None else times
    requests = times.select(
        o().alias("request_id"), F.concat(F.lit("c"), "o_custkey").alias("campaign_id"), F.concat(F.lit("p"), o()).alias("plan_digest"),
        F.lit("v1").alias("source_version"), _strings("a", "b", "b").alias("targets"), _strings("read", "apply").alias("required_scope"),
        F.lit("auth").alias("authorization_digest"), F.col("trusted").cast("timestamp").alias("last_trusted_at"))
    targets = F.when(fault() % 31 == 0, _strings("a", "b")).otherwise(_strings("b", "a", "b"))
    scope = F.when(fault() % 37 == 0, _strings("read")).otherwise(_strings("apply", "read", "plan"))
    first = times.filter(fault() % 17 != 0).select(
        o().alias("request_id"), F.lit(1).alias("recorded"), (fault() % 19 != 0).alias("digest_valid"),
        F.when((fault() % 23 == 0) | (o() % 10 == 0), F.lit("other")).otherwise(F.concat(F.lit("c"), "o_custkey")).alias("campaign_id"),
        F.when(fault() % 29 == 0, F.lit("other")).otherwise(F.concat(F.lit("p"), o())).alias("plan_digest"),
        F.when(fault() % 41 == 0, "v0").otherwise("v1").alias("source_version"), targets.alias("targets"), scope.alias("scope"),
        F.when(fault() % 43 == 0, "changed").otherwise("auth").alias("authorization_digest"),
        F.col("begins").alias("authorized_at"), F.col("ends").alias("expires_at"), fault().alias("_fault"))
    second = first.filter(F.col("request_id") % 10 == 0).withColumn("recorded", F.lit(2)).withColumn(
        "campaign_id", F.when(F.col("_fault") % 23 == 0, F.lit("other")).otherwise(F.lit(None)))
    owner = t.orders.select(o().alias("request_id"), F.concat(F.lit("c"), "o_custkey").alias("_own"))
    second = second.join(owner, "request_id").withColumn("campaign_id", F.coalesce("campaign_id", "_own")).drop("_own")
    return requests, first.unionByName(second).drop("_fault")


def waivers(t: Tables) -> DataFrame:
    campaign = F.concat(F.lit("c"), "o_custkey")
    return order_times(t).select(
        o().alias("waiver_id"), (o() % 19 != 0).alias("digest_valid"), campaign.alias("campaign_id"), F.lit("k").alias("consumer_id"),
        _strings("close").alias("scope"), F.when(o() % 23 == 0, F.lit("x")).otherwise(campaign).alias("used_campaign_id"),
        F.when(o() % 29 == 0, F.lit("x")).otherwise(F.lit("k")).alias("used_consumer_id"),
        F.when(o() % 31 == 0, _strings("close", "delete")).otherwise(_strings("close")).alias("used_scope"),
        F.col("begins").alias("authorized_at"), F.col("ends").alias("expires_at"))


def receipts(t: Tables, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    campaign = F.concat(F.lit("c"), "o_custkey")
    times = order_times(t) if times is None else times
    given = times.select(
        o().alias("receipt_id"), (fault() % 19 != 0).alias("digest_valid"),
        F.when(fault() % 23 == 0, F.lit("other")).otherwise(campaign).alias("campaign_id"), F.concat(F.lit("o"), o()).alias("consumer_id"),
        F.when(fault() % 29 == 0, "fixture").otherwise("live").alias("mode"), F.when(fault() % 31 == 0, "p0").otherwise("p1").alias("plan_digest"),
        _strings("a", "b").alias("approved_targets"), _strings("b", "a").alias("proposed_targets"),
        F.when(fault() % 37 == 0, _strings("a", "a")).otherwise(_strings("a", "b")).alias("actual_targets"),
        F.when(fault() % 41 == 0, "v0").otherwise("v1").alias("source_version"),
        F.when(fault() % 43 == 0, "FAILED").when(fault() % 47 == 0, "SKIPPED").otherwise("PASSED").alias("result"),
        F.when(fault() % 53 == 0, "STALE").otherwise("VALIDATED").alias("terminal_disposition"),
        F.col("begins").alias("captured_at"), F.col("ends").alias("expires_at"))
    expected = t.orders.select(
        o().alias("receipt_id"), campaign.alias("campaign_id"), F.concat(F.lit("o"), o()).alias("consumer_id"), F.lit("p1").alias("plan_digest"),
        F.lit("v1").alias("source_version"), _strings("b", "a").alias("approved_targets"))
    return given, expected


_CLOCK_SQL = """WHEN unreadable THEN 'RUNTIME_CLOCK_INVALID'{last}
  WHEN o_orderdate > now + INTERVAL 30 SECOND THEN 'RUNTIME_CLOCK_FUTURE' WHEN now >= until THEN '{code}' END"""


def clock_records(t: Tables) -> DataFrame:
    return order_times(t).select(
        o().alias("record_id"), F.col("begins").alias("observed_at"), F.col("trusted").alias("last_trusted_at"),
        F.when(o() % 7 == 0, F.lit("2000-01-01T00:05:01Z")).when(o() % 7 == 1, F.lit("1999-12-31T23:55:00Z")).alias("source_clock_at"),
        F.col("ends").alias("expires_at"))


def scenarios(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A scenario per document, naming it by one of several paths; and the documents as files."""
    d = F.col("doc_id")
    path = (
        F.when(d % 11 == 0, F.concat(F.lit("../"), "source", F.lit("/"), d))
        .when(d % 13 == 0, F.concat(F.lit("/"), "source", F.lit("/"), d))
        .when(d % 7 == 0, F.concat(F.lit("x/../"), "source", F.lit("/./"), d))
        .when(d % 17 == 0, F.concat("source", F.lit("/gone-"), d))
        .otherwise(F.concat("source", F.lit("/"), d))
    )
    rows = t.documents.select(
        d.alias("scenario_id"), (d % 3 != 0).alias("evidence_required"), F.when(d % 5 == 0, "STALE").otherwise("COMPLETE").alias("evidence_status"),
        F.when(d % 19 == 0, 0).when(d % 23 == 0, 2).otherwise(1).alias("identity_match_count"), (d % 29 != 0).alias("replacement_compatible"),
        path.alias("source_path"),
        F.when(d % 31 == 0, F.lit("sha256:0")).otherwise(F.concat(F.lit("sha256:"), F.sha2("text", 256))).alias("expected_fingerprint"))
    files = t.documents.select(
        F.concat("source", F.lit("/"), d).alias("path"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("fingerprint"))
    return rows, files


ALLOWED = ("src0", "src1/", "src2", "x")


def specs(t: Tables) -> DataFrame:
    """A spec per customer: one in twenty names the same field twice, one in fifteen another table."""

    def parts(table: Column, field: str, schema: Column) -> Column:
        return F.struct(
            F.lit("pg").alias("platform"), F.lit("i").alias("instance"), F.lit("d").alias("database"), schema.alias("schema"),
            table.alias("table"), F.lit(field).alias("field"))

    home = F.concat(F.lit("s"), "c_nationkey")
    target = parts(F.col("c_mktsegment"), "old", home)
    other = parts(F.when(c() % 15 == 0, F.lit("elsewhere")).otherwise(F.col("c_mktsegment")), "new",
                  F.when(c() % 45 == 0, F.lit("moved")).otherwise(home))
    same = parts(F.when(c() % 15 == 0, F.lit("elsewhere")).otherwise(F.col("c_mktsegment")), "old",
                 F.when(c() % 45 == 0, F.lit("moved")).otherwise(home))
    return t.customer.select(c().alias("spec_id"), target.alias("target"), F.when(c() % 20 == 0, same).otherwise(other).alias("replacement"))


CONTRACT = (
    r.FieldRule("k", kind="bigint", low=5, high=90),
    r.FieldRule("kind", allowed=("click", "view", "signup", "purchase")),
    r.FieldRule("digest", pattern=r"^[0-9a-f]{8}$", required=False),
)


def raw_records(t: Tables) -> DataFrame:
    """The JSON properties of each event extended to a record, with planted violations."""
    e = F.col("event_id")
    k = F.regexp_extract("props", r"(\d+)", 1)
    number = F.when(e % 11 == 0, F.lit('"many"')).otherwise(k)
    body = F.concat(
        F.lit("{"),
        F.when(e % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"k":'), number, F.lit(","))),
        F.lit('"kind":"'), F.col("event_type"), F.lit('"'),
        F.when(e % 5 == 0, F.lit(',"digest":"ABC"')).when(e % 5 == 1, F.lit(',"digest":"0a1b2c3d"')).otherwise(F.lit("")),
        F.when(e % 13 == 0, F.lit(',"zeta":1,"alpha":2')).otherwise(F.lit("")),
        F.lit("}"))
    return t.events.select("event_id", F.when(e % 17 == 0, F.lit("{broken")).otherwise(body).alias("raw"))


view("raw_checks", """
SELECT event_id, event_id % 17 = 0 AS broken, event_id % 7 = 0 AS no_k, event_id % 11 = 0 AS bad_k,
       CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, event_type, event_id % 5 = 0 AS bad_digest, event_id % 13 = 0 AS extra FROM events
""")
view("raw_violations", """
SELECT event_id, list_filter([CASE WHEN broken THEN 'NOT_AN_OBJECT' END, CASE WHEN NOT broken AND no_k THEN 'MISSING:k' END,
  CASE WHEN NOT broken AND NOT no_k AND bad_k THEN 'TYPE:k' END, CASE WHEN NOT broken AND NOT no_k AND NOT bad_k AND (k < 5 OR k > 90) THEN 'RANGE:k' END,
  CASE WHEN NOT broken AND event_type NOT IN ('click', 'view', 'signup', 'purchase') THEN 'ENUM:kind' END,
  CASE WHEN NOT broken AND bad_digest THEN 'PATTERN:digest' END, CASE WHEN NOT broken AND extra THEN 'UNKNOWN:alpha,zeta' END],
  lambda x: x IS NOT NULL) AS v FROM raw_checks
""")


# --- reconciliation -----------------------------------------------------------------

def captured_scope(t: Tables, fresh: bool) -> DataFrame:
    """Two sources per campaign; the fresh capture differs in filters, hops or presence for some."""
    both = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.explode(_strings("catalog", "repository")).alias("source_id"))
    lists = F.array(F.col("c_mktsegment"), F.lit("prod"))
    rows = both.select(
        c().alias("campaign_id"), "source_id", (c() % 4 != 0).alias("required"), F.concat(F.lit("id-"), "c_nationkey").alias("identity"),
        F.lit("downstream").alias("direction"),
        (F.when((c() % 25 == 0) & (F.col("source_id") == "catalog"), 5).otherwise(3) if fresh else F.lit(3)).alias("max_hops"),
        (F.when(c() % 9 == 0, F.reverse(lists)).otherwise(lists) if fresh else lists).alias("filters"),
        F.lit("reader").alias("principal"), F.lit("read").alias("effective_scope"))
    return rows.filter((F.col("source_id") != "repository") | (F.col("campaign_id") % 14 != 0)) if fresh else rows


view("scope_differences", """
SELECT c_custkey AS campaign_id, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 25 = 0 THEN 1 ELSE 0 END
       + CASE WHEN c_custkey % 9 = 0 OR c_custkey % 14 = 0 THEN 1 ELSE 0 END AS n FROM customer
""")


def consumer_drift(t: Tables) -> DataFrame:
    """Source drift observed for orders whose key is a multiple of 6, some of them reported twice."""
    rows = pp.consumer_orders(t).filter(o() % 6 == 0).select(
        F.concat(F.lit("c"), "o_custkey").alias("campaign_id"), F.concat(F.lit("o"), o()).alias("consumer_id"), F.lit("repository").alias("source_id"))
    return rows.unionByName(rows.filter(F.length("consumer_id") % 2 == 0))


def refreshes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each customer's refresh waits for an order newer than mid 1998 placed within 200 days of it."""
    asked = F.to_timestamp(F.lit("1998-07-01 00:00:00"))
    wanted = t.customer.select(
        F.concat(F.lit("r"), c()).alias("refresh_id"), c().alias("urn"), asked.alias("requested_at"),
        F.timestamp_add("DAY", F.lit(200), asked).alias("deadline"))
    at = F.col("o_orderdate").cast("timestamp")
    seen = t.orders.select(F.col("o_custkey").alias("urn"), at.alias("source_updated_at"), F.timestamp_add("DAY", F.lit(2), at).alias("observed_at"))
    return wanted, seen


# --- gate ---------------------------------------------------------------------------

def plans(t: Tables) -> DataFrame:
    """A producer plan per campaign around the gate time: some missing, too long, early, expired, foreign or outdated."""
    prepared = F.timestamp_add("SECOND", ((c() % 60) * -20 + 40).cast("int"), gate_now())
    return t.customer.filter(c() % 53 != 0).select(
        F.concat(F.lit("c"), c()).alias("campaign_id"), F.concat(F.lit("p"), c()).alias("plan_digest"), (c() % 47 != 0).alias("issued"),
        (c() % 43 != 0).alias("trusted"), (c() % 41 != 0).alias("bound"),
        F.concat(F.when(c() % 29 == 0, F.lit("old")).otherwise(F.lit("m")), c()).alias("plan_manifest_digest"),
        F.when(c() % 61 != 0, prepared).alias("prepared_at"),
        F.timestamp_add("SECOND", F.when(c() % 51 == 0, 901).otherwise(900), prepared).alias("expires_at"))


view("gate_plan_rows", f"""
SELECT 'c' || c_custkey AS campaign_id, 'p' || c_custkey AS plan_digest, c_custkey, TIMESTAMP '{GATE_NOW}' AS now,
       CASE WHEN c_custkey % 61 <> 0 THEN TIMESTAMP '{GATE_NOW}' + to_seconds(c_custkey % 60 * -20 + 40) END AS prepared,
       TIMESTAMP '{GATE_NOW}' + to_seconds(c_custkey % 60 * -20 + 40) + to_seconds(CASE WHEN c_custkey % 51 = 0 THEN 901 ELSE 900 END) AS expires
FROM customer WHERE c_custkey % 53 <> 0
""")
view("plan_codes", """
SELECT *, CASE WHEN expires - prepared > INTERVAL 15 MINUTE THEN 'GATE_PLAN_INVALID' WHEN prepared IS NULL THEN 'RUNTIME_CLOCK_INVALID'
  WHEN prepared > now + INTERVAL 30 SECOND THEN 'RUNTIME_CLOCK_FUTURE' WHEN now >= expires THEN 'GATE_PLAN_EXPIRED' END AS code FROM gate_plan_rows
""")


def attempts(t: Tables) -> DataFrame:
    """Every event as a gate attempt; plans and manifests repeat across them, some are the present ones of their campaign."""
    e, user = F.col("event_id"), F.col("user_id")
    present = user % 4 == 1
    return t.events.select(
        e.alias("attempt_id"), F.concat(F.lit("c"), "user_id").alias("campaign_id"),
        F.when(present & (e % 11 == 0), F.concat(F.lit("p"), "user_id"))
        .otherwise(F.concat(F.lit("p"), F.col("user_id"), F.lit("-"), F.floor(F.col("value") / 25))).alias("plan_digest"),
        F.when(present & (e % 13 == 0), F.concat(F.lit("m"), "user_id")).otherwise(F.concat(F.lit("m-"), F.floor(F.col("value") / 10)))
        .alias("manifest_digest"),
        F.element_at(_strings("INTENT_RECORDED", "EXECUTED", "OUTCOME_UNKNOWN", "REFUSED"), (e % 4 + 1).cast("int")).alias("status"),
        F.col("ts").alias("recorded_at"),
        F.when(e % 4 == 3, F.element_at(_strings("GATE_STATE_DRIFT", "GATE_PLAN_EXPIRED", "GATE_SOURCE_DRIFT"), (e % 3 + 1).cast("int")))
        .alias("refusal_code"))


view("gate_attempts", """
SELECT event_id AS attempt_id, 'c' || user_id AS campaign_id,
       CASE WHEN user_id % 4 = 1 AND event_id % 11 = 0 THEN 'p' || user_id ELSE 'p' || user_id || '-' || CAST(floor(value / 25) AS BIGINT) END AS plan_digest,
       CASE WHEN user_id % 4 = 1 AND event_id % 13 = 0 THEN 'm' || user_id ELSE 'm-' || CAST(floor(value / 10) AS BIGINT) END AS manifest_digest,
       ['INTENT_RECORDED', 'EXECUTED', 'OUTCOME_UNKNOWN', 'REFUSED'][event_id % 4 + 1] AS status, ts AS recorded_at,
       CASE WHEN event_id % 4 = 3 THEN ['GATE_STATE_DRIFT', 'GATE_PLAN_EXPIRED', 'GATE_SOURCE_DRIFT'][event_id % 3 + 1] END AS refusal_code
FROM events
""")


def snapshots(t: Tables) -> DataFrame:
    """Two sources of every campaign, read again with each of its orders in the hours around the gate; few of the readings differ."""
    role = F.when(o() % 2 == 0, "source").otherwise("binding")
    at = F.timestamp_add("SECOND", (o() * 37 % 20_000).cast("int") - 19_700, gate_now())
    return t.orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("campaign_id"), F.concat(role, F.lit("-tree")).alias("source_id"), role.alias("role"),
        at.alias("observed_at"), o().alias("snapshot_id"),
        F.concat(F.lit("f"), F.col("o_custkey"), F.when(o() % 29 == 0, F.concat(F.lit("-"), o())).otherwise(F.lit(""))).alias("fingerprint"))


view("gate_snapshots", f"""
SELECT 'c' || o_custkey AS campaign_id, CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'binding' END AS role,
       TIMESTAMP '{GATE_NOW}' + to_seconds(o_orderkey * 37 % 20000 - 19700) AS observed_at, o_orderkey AS snapshot_id,
       'f' || o_custkey || CASE WHEN o_orderkey % 29 = 0 THEN '-' || o_orderkey ELSE '' END AS fingerprint FROM orders
""")
view("bound_snapshots", """
SELECT campaign_id, 'p' || substr(campaign_id, 2) AS plan_digest, role || '-tree' AS source_id, role, bound.fingerprint AS bound_fingerprint,
       present.fingerprint AS fingerprint,
       CASE WHEN bound.fingerprint IS DISTINCT FROM present.fingerprint
            THEN CASE role WHEN 'binding' THEN 'GATE_STATE_DRIFT' ELSE 'GATE_SOURCE_DRIFT' END END AS refusal_code
FROM (SELECT s.campaign_id, role,
             max({'at': observed_at, 'id': snapshot_id, 'fingerprint': s.fingerprint}) FILTER (WHERE observed_at <= p.prepared) AS bound,
             max({'at': observed_at, 'id': snapshot_id, 'fingerprint': s.fingerprint}) AS present
      FROM gate_snapshots s JOIN gate_plan_rows p USING (campaign_id) WHERE observed_at <= p.now GROUP BY 1, 2)
""")


def gate_sources(t: Tables) -> DataFrame:
    """Two sources per campaign as reread at the gate."""
    rows = t.customer.join(last_orders(t).withColumnRenamed("campaign_id", "c_custkey"), "c_custkey", "left")
    catalog = F.struct(
        F.lit("catalog").alias("source_id"), (c() % 5 != 0).alias("required"), F.when(c() % 21 == 0, "PARTIAL").otherwise("COMPLETE").alias("status"),
        F.when(c() % 33 == 0, F.timestamp_add("SECOND", F.lit(31), gate_now())).otherwise(gate_now()).alias("observed_at"),
        F.col("source_updated_at"), F.lit(31_536_000).alias("maximum_age_seconds"))
    repository = F.struct(
        F.lit("repository").alias("source_id"), F.lit(True).alias("required"), F.lit("COMPLETE").alias("status"), gate_now().alias("observed_at"),
        F.timestamp_add("SECOND", F.when(c() % 35 == 0, 31).otherwise(30), gate_now()).alias("source_updated_at"),
        F.lit(31_536_000).alias("maximum_age_seconds"))
    return rows.select(c().alias("campaign_id"), F.explode(F.array(catalog, repository)).alias("s")).select("campaign_id", "s.*")


view("gate_source_codes", f"""
SELECT campaign_id, CASE WHEN cat IS NOT NULL THEN 'catalog' ELSE 'repository' END AS source_id, coalesce(cat, repo) AS refusal_code FROM (
  SELECT c_custkey AS campaign_id, CASE WHEN c_custkey % 35 = 0 THEN 'RUNTIME_CLOCK_FUTURE' END AS repo, CASE WHEN c_custkey % 5 <> 0 THEN
    CASE WHEN c_custkey % 21 = 0 THEN 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE' WHEN c_custkey % 33 = 0 THEN 'RUNTIME_CLOCK_FUTURE'
         WHEN updated IS NULL THEN 'RUNTIME_CLOCK_INVALID'
         WHEN TIMESTAMP '{GATE_NOW}' - updated > INTERVAL 31536000 SECOND THEN 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE' END END AS cat
  FROM customer LEFT JOIN last_orders ON campaign_id = c_custkey) WHERE cat IS NOT NULL OR repo IS NOT NULL
""")


def gate_campaigns(t: Tables) -> DataFrame:
    """Campaign heads with the policy's decision; the state follows the decision except for a few."""
    decided = pp.decisions(t).select("campaign_id", "decision")
    key = F.regexp_extract("campaign_id", r"(\d+)", 1).cast("bigint")
    ready = F.col("decision") == "READY_TO_RETIRE"
    return decided.select(
        "campaign_id", "decision", F.when(ready & (key % 59 != 0), "READY").otherwise("BLOCKED").alias("state"),
        F.concat(F.lit("m"), key).alias("manifest_digest"), (key % 19 != 0).alias("publication_verified"))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("campaign_id", F.concat(F.lit("c"), "campaign_id"))


def gate_findings(t: Tables, heads: DataFrame) -> list[tuple[str, DataFrame]]:
    """The audits behind the gate, all at the gate's own time."""
    drift = p.input_drift(pp._inputs(t, False), pp._inputs(t, True)).select("campaign_id", F.lit("POLICY_INPUT_DRIFT").alias("refusal_code"))
    ids = t.customer.select(c().alias("campaign_id"))
    scope = g.scope_equivalence(ids, captured_scope(t, False), captured_scope(t, True)).withColumn(
        "refusal_code", F.when(F.col("refusal_code").isNotNull(), F.lit("GATE_STATE_DRIFT")))
    moved = p.membership_diff(pp.inventory(t), pp.current(t)).filter("change <> 'unchanged'").select(
        "campaign_id", F.lit("GATE_STATE_DRIFT").alias("refusal_code"))
    adapters = t.orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("campaign_id"), F.when(o() % 101 == 0, "retired-tool").otherwise("git-dbt").alias("adapter"))
    bound = g.bound_snapshots(plans(t), snapshots(t), gate_now())
    return [
        ("inputs", drift), ("receipt types", g.receipt_type_audit(adapters, ("dbt",))),
        ("receipts", r.receipt_audit(*receipts(t, gate_times(t, RECEIPT_CLASS)), gate_now())), ("approvals", r.approval_audit(*approvals(t, gate_times(t, APPROVAL_CLASS)), gate_now())),
        ("bindings", bound.filter("role = 'binding'")), ("scope", keyed(scope)), ("membership", moved),
        ("freshness", keyed(g.gate_freshness(gate_sources(t), gate_now()))), ("source", bound.filter("role = 'source'")),
        ("consumed", g.consumed_plans(heads, plans(t), attempts(t))),
    ]


def ready_campaigns(t: Tables) -> DataFrame:
    """Every customer as a campaign that its policy has cleared."""
    return t.customer.select(
        F.concat(F.lit("c"), c()).alias("campaign_id"), F.lit("READY_TO_RETIRE").alias("decision"),
        F.when(c() % 59 != 0, "READY").otherwise("BLOCKED").alias("state"), F.concat(F.lit("m"), c()).alias("manifest_digest"),
        (c() % 19 != 0).alias("publication_verified"))


def readiness(t: Tables, heads: DataFrame) -> DataFrame:
    return g.gate_readiness(heads, plans(t), gate_findings(t, heads), gate_now())


_Q = lambda build: (lambda spark, folder: build(Tables(spark, folder)))

QUERIES = {
    "g1_approval_audit": _Q(lambda t: r.approval_audit(*approvals(t), now())),
    "g2_waiver_audit": _Q(lambda t: r.waiver_audit(waivers(t), now())),
    "g3_receipt_audit": _Q(lambda t: r.receipt_audit(*receipts(t), now())),
    "g4_clock_audit": _Q(lambda t: r.clock_audit(clock_records(t), now())),
    "g5_scenario_precheck": _Q(lambda t: r.scenario_precheck(*scenarios(t), ALLOWED)),
    "g6_spec_audit": _Q(lambda t: r.spec_audit(specs(t))),
    "g7_contract_audit": _Q(lambda t: r.contract_audit(raw_records(t), "raw", CONTRACT)),
    "h2_scope_equivalence": _Q(lambda t: g.scope_equivalence(
        t.customer.select(c().alias("campaign_id")), captured_scope(t, False), captured_scope(t, True))),
    "h3_invalidate_consumers": _Q(lambda t: g.invalidate_consumers(pp.consumers(t), consumer_drift(t))),
    "h3_invalidate_sources": _Q(lambda t: g.invalidate_sources(
        pp.sources(t).withColumn("limitations", _strings("SOURCE_DRIFT_WATCHED")), consumer_drift(t), "RECEIPT_INVALIDATED").select(
        "campaign_id", "source_id", "required", "status", F.concat_ws(",", "limitations").alias("limitations"))),
    "h4_refresh_status": _Q(lambda t: g.refresh_status(*refreshes(t)).withColumn(
        "observed_at", F.date_format("observed_at", "yyyy-MM-dd"))),
    "h5_gate_readiness": _Q(lambda t: readiness(t, gate_campaigns(t))),
    "h5_gate_live_state": _Q(lambda t: readiness(t, ready_campaigns(t))),
    "h5_bound_snapshots": _Q(lambda t: g.bound_snapshots(plans(t), snapshots(t), gate_now())),
    "h6_plan_window": _Q(lambda t: g.plan_window(plans(t), gate_now())),
    "h7_ledger_audit": _Q(lambda t: g.ledger_audit(attempts(t))),
    "h8_gate_freshness": _Q(lambda t: g.gate_freshness(gate_sources(t), gate_now())),
}

def _approval_view(times: str) -> str:
    return f"""
SELECT o_orderkey AS request_id, 'c' || o_custkey AS campaign_id, CASE WHEN fault % 17 = 0 THEN 'AUTH_APPROVAL_MISSING'
  WHEN fault % 19 = 0 THEN 'INTEGRITY_DIGEST_MISMATCH' WHEN fault % 23 = 0 THEN 'AUTH_APPROVAL_WRONG_CAMPAIGN'
  WHEN fault % 29 = 0 THEN 'AUTH_APPROVAL_WRONG_PLAN' WHEN fault % 41 = 0 THEN 'AUTH_APPROVAL_WRONG_SOURCE'
  WHEN fault % 31 = 0 OR fault % 37 = 0 OR fault % 43 = 0 THEN 'AUTH_APPROVAL_WRONG_SCOPE'
  {_CLOCK_SQL.format(last=" WHEN now < trusted THEN 'RUNTIME_CLOCK_ROLLBACK'", code="AUTH_APPROVAL_EXPIRED")} AS refusal_code FROM {times}
"""


def _receipt_view(times: str) -> str:
    return f"""
SELECT o_orderkey AS receipt_id, CASE WHEN fault % 23 = 0 THEN 'other' ELSE 'c' || o_custkey END AS campaign_id,
  CASE WHEN fault % 19 = 0 THEN 'INTEGRITY_DIGEST_MISMATCH'
  WHEN fault % 23 = 0 THEN 'IDENTITY_NOT_FOUND' WHEN fault % 29 = 0 THEN 'EVIDENCE_RECEIPT_MODE_NOT_LIVE'
  WHEN fault % 31 = 0 THEN 'AUTH_APPROVAL_WRONG_PLAN' WHEN fault % 37 = 0 THEN 'SCOPE_RECEIPT_TARGET_MISMATCH'
  WHEN fault % 41 = 0 THEN 'SOURCE_RECEIPT_VERSION_MISMATCH' WHEN fault % 43 = 0 THEN 'VALIDATION_RECEIPT_FAILED'
  WHEN fault % 47 = 0 THEN 'VALIDATION_RECEIPT_INCONCLUSIVE' WHEN fault % 53 = 0 THEN 'VALIDATION_RECEIPT_FAILED'
  {_CLOCK_SQL.format(last="", code="EVIDENCE_RECEIPT_EXPIRED")} AS refusal_code FROM {times}
"""


view("approval_codes", _approval_view("order_times"))
view("receipt_codes", _receipt_view("order_times"))
view("gate_approval_codes", _approval_view("gate_approval_times"))
view("gate_receipt_codes", _receipt_view("gate_receipt_times"))
view("ledger_codes", """
SELECT attempt_id, campaign_id, plan_digest, status,
       CASE WHEN row_number() OVER (PARTITION BY plan_digest ORDER BY recorded_at, attempt_id) > 1
              OR row_number() OVER (PARTITION BY campaign_id, manifest_digest ORDER BY recorded_at, attempt_id) > 1
            THEN 'GATE_PLAN_REPLAYED' END AS refusal_code FROM gate_attempts WHERE status <> 'REFUSED'
""")
view("gate_steps", """
SELECT campaign_id, 6 AS n, 'inputs' AS step, 'POLICY_INPUT_DRIFT' AS code FROM (SELECT 'c' || c_custkey AS campaign_id FROM customer
  WHERE c_custkey % 37 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0)
UNION ALL SELECT DISTINCT 'c' || o_custkey, 7, 'receipt types', 'POLICY_INPUT_DRIFT' FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT campaign_id, 8, 'receipts', min(refusal_code) FROM gate_receipt_codes GROUP BY 1 HAVING min(refusal_code) IS NOT NULL
UNION ALL SELECT campaign_id, 9, 'approvals', min(refusal_code) FROM gate_approval_codes GROUP BY 1 HAVING min(refusal_code) IS NOT NULL
UNION ALL SELECT campaign_id, 10, 'bindings', refusal_code FROM bound_snapshots WHERE role = 'binding' AND refusal_code IS NOT NULL
UNION ALL SELECT 'c' || campaign_id, 11, 'scope', 'GATE_STATE_DRIFT' FROM scope_differences WHERE n > 0
UNION ALL SELECT DISTINCT campaign_id, 12, 'membership', 'GATE_STATE_DRIFT' FROM order_consumers WHERE in_inventory <> in_current
UNION ALL SELECT 'c' || campaign_id, 13, 'freshness', refusal_code FROM gate_source_codes
UNION ALL SELECT campaign_id, 16, 'source', refusal_code FROM bound_snapshots WHERE role = 'source' AND refusal_code IS NOT NULL
UNION ALL SELECT DISTINCT a.campaign_id, 17, 'consumed', 'GATE_PLAN_REPLAYED' FROM gate_attempts a LEFT JOIN gate_plan_rows p USING (plan_digest)
  WHERE status <> 'REFUSED' AND (p.plan_digest IS NOT NULL OR manifest_digest = 'm' || substr(a.campaign_id, 2))
""")

_GATE_SQL = """
SELECT campaign_id, least(own, f.f).step AS failed_step, least(own, f.f).code AS refusal_code FROM (
  SELECT d.campaign_id, CASE WHEN decision <> 'READY_TO_RETIRE' OR k % 59 = 0 THEN {{'n': 1, 'step': 'ready', 'code': 'GATE_DECISION_NOT_READY'}}
    WHEN p.campaign_id IS NULL OR k % 47 = 0 THEN {{'n': 2, 'step': 'plan', 'code': 'GATE_PLAN_MISSING'}}
    WHEN k % 43 = 0 THEN {{'n': 3, 'step': 'provenance', 'code': 'GATE_PROVENANCE_UNTRUSTED'}}
    WHEN p.code IS NOT NULL THEN {{'n': 4, 'step': 'window', 'code': p.code}}
    WHEN k % 41 = 0 THEN {{'n': 5, 'step': 'binding', 'code': 'GATE_PROVENANCE_UNTRUSTED'}}
    WHEN k % 19 = 0 THEN {{'n': 14, 'step': 'publication', 'code': 'GATE_PUBLICATION_UNVERIFIED'}}
    WHEN k % 29 = 0 THEN {{'n': 15, 'step': 'manifest', 'code': 'GATE_STATE_DRIFT'}} END AS own
  FROM (SELECT *, CAST(substr(campaign_id, 2) AS BIGINT) AS k FROM {heads}) d LEFT JOIN plan_codes p USING (campaign_id))
LEFT JOIN (SELECT campaign_id, min({{'n': n, 'step': step, 'code': code}}) AS f FROM gate_steps GROUP BY 1) f USING (campaign_id)"""

ORACLES = {
    "g1_approval_audit": twin("SELECT * FROM approval_codes"),
    "g2_waiver_audit": twin(f"""
SELECT o_orderkey AS waiver_id, CASE WHEN o_orderkey % 19 = 0 THEN 'INTEGRITY_DIGEST_MISMATCH'
  WHEN o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN 'AUTH_WAIVER_INVALID'
  {_CLOCK_SQL.format(last="", code="AUTH_WAIVER_EXPIRED")} AS refusal_code FROM order_times"""),
    "g3_receipt_audit": twin("SELECT * FROM receipt_codes"),
    "g4_clock_audit": twin("""
SELECT o_orderkey AS record_id, CASE WHEN unreadable THEN 'RUNTIME_CLOCK_INVALID' WHEN now < trusted THEN 'RUNTIME_CLOCK_ROLLBACK'
  WHEN o_orderdate > now + INTERVAL 30 SECOND THEN 'RUNTIME_CLOCK_FUTURE' WHEN o_orderkey % 7 = 0 THEN 'RUNTIME_CLOCK_SKEW'
  WHEN now >= until THEN 'EVIDENCE_RECEIPT_EXPIRED' END AS refusal_code FROM order_times"""),
    "g5_scenario_precheck": """
SELECT doc_id AS scenario_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE'
  WHEN doc_id % 19 = 0 THEN 'IDENTITY_NOT_FOUND' WHEN doc_id % 23 = 0 THEN 'IDENTITY_AMBIGUOUS'
  WHEN doc_id % 29 = 0 THEN 'SPEC_REPLACEMENT_INCOMPATIBLE' WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'SCOPE_PATH_OUTSIDE_ROOT'
  WHEN doc_id % 7 <> 0 AND doc_id % 17 = 0 THEN 'SOURCE_NOT_FOUND'
  WHEN doc_id % 7 = 0 OR source NOT IN ('src0', 'src1', 'src2') THEN 'SCOPE_TARGET_NOT_ALLOWED'
  WHEN doc_id % 31 = 0 THEN 'SOURCE_FINGERPRINT_MISMATCH' END AS refusal_code FROM documents""",
    "g6_spec_audit": """
SELECT c_custkey AS spec_id, CASE WHEN c_custkey % 15 = 0 THEN 'SPEC_UNSUPPORTED_REPLACEMENT' WHEN c_custkey % 20 = 0 THEN 'SPEC_IDENTICAL_FIELDS' END AS refusal_code,
       CASE WHEN c_custkey % 45 = 0 THEN 'schema,table' WHEN c_custkey % 15 = 0 THEN 'table' ELSE '' END AS changed_parts FROM customer""",
    "g7_contract_audit": twin("SELECT event_id, CAST(len(v) AS BIGINT) AS violations, v[1] AS first_violation FROM raw_violations"),
    "h2_scope_equivalence": twin("""
SELECT campaign_id, CAST(n AS BIGINT) AS different_sources, CASE WHEN n > 0 THEN 'RECONCILIATION_SCOPE_MISMATCH' END AS refusal_code FROM scope_differences"""),
    "h3_invalidate_consumers": twin("""
SELECT campaign_id, consumer_id, CASE WHEN CAST(substr(consumer_id, 2) AS BIGINT) % 6 = 0 AND disposition = 'VALIDATED' THEN 'STALE' ELSE disposition END
       AS disposition FROM order_consumers"""),
    "h3_invalidate_sources": twin("""
SELECT s.campaign_id, source_id, required, CASE WHEN d.k IS NOT NULL AND source_id = 'repository' THEN 'STALE' ELSE status END AS status,
       CASE WHEN d.k IS NOT NULL AND source_id = 'repository' THEN 'RECEIPT_INVALIDATED,SOURCE_DRIFT_WATCHED' ELSE 'SOURCE_DRIFT_WATCHED' END AS limitations
FROM campaign_sources s LEFT JOIN (SELECT DISTINCT campaign_id AS k FROM order_consumers WHERE CAST(substr(consumer_id, 2) AS BIGINT) % 6 = 0) d ON d.k = s.campaign_id"""),
    "h4_refresh_status": """
SELECT 'r' || c_custkey AS refresh_id, c_custkey AS urn, strftime(min(o_orderdate) + INTERVAL 2 DAY, '%Y-%m-%d') AS observed_at,
       CASE WHEN count(o_orderkey) = 0 THEN 'RECONCILIATION_REFRESH_TIMEOUT' END AS refusal_code
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-07-01'
  AND o_orderdate + INTERVAL 2 DAY <= TIMESTAMP '1998-07-01' + INTERVAL 200 DAY GROUP BY c_custkey""",
    "h5_gate_readiness": twin(_GATE_SQL.format(heads="decisions_default")),
    "h5_gate_live_state": twin(_GATE_SQL.format(heads="(SELECT 'c' || c_custkey AS campaign_id, 'READY_TO_RETIRE' AS decision FROM customer)")),
    "h5_bound_snapshots": twin("SELECT * FROM bound_snapshots"),
    "h6_plan_window": twin("SELECT plan_digest, code AS refusal_code FROM plan_codes"),
    "h7_ledger_audit": twin("SELECT * FROM ledger_codes"),
    "h8_gate_freshness": twin("SELECT * FROM gate_source_codes"),
}
