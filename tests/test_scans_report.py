import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sundown.functions.text import public_text
from sundown.operators import report as r
from sundown.operators import scans as s
from sundown.sources import files as fs
from sundown.sources.tables import Tables, write_result

TEXTS = {
    "models/alias.sql": "select legacy_status as status from t",
    "macros/macro.sql": "{% macro m() %}{{ legacy_status }}{% endmacro %}",
    "models/generated.sql.j2": "select {{ legacy_status }} from t",
    "models/star.sql": "Select\n * from t",
    "models/other.sql": "select not_legacy_status, legacy_status2 from t",
    "models/twice.sql": "legacy_status, legacy_status",
    "target/models/built.sql": "select legacy_status, * from t",
}


@pytest.fixture
def files(make):
    return make("repository_id string, path string, text string", *[("r", p, t) for p, t in TEXTS.items()])


def test_reference_scan(files, got):
    assert got(s.reference_scan(files, "legacy_status")) == [
        ("macros/macro.sql", "macro_or_generated", False), ("models/alias.sql", "aliased_direct", False),
        ("models/generated.sql.j2", "direct", False), ("models/star.sql", None, True), ("models/twice.sql", "direct", False)]


def test_rename_plan(files, got):
    import hashlib

    plan = {row["path"]: row for row in s.rename_plan(files, "legacy_status", "order$status", ["models/"]).collect()}
    assert plan["macros/macro.sql"]["refusal_code"] == "SCOPE_TARGET_NOT_ALLOWED"
    assert {p: plan[p]["refusal_code"] for p in ("models/twice.sql", "models/other.sql")} == {
        "models/twice.sql": "IDENTITY_AMBIGUOUS", "models/other.sql": "IDENTITY_AMBIGUOUS"}
    renamed = "select order$status as status from t"
    assert plan["models/alias.sql"]["after_digest"] == "sha256:" + hashlib.sha256(renamed.encode()).hexdigest()


def test_counterfactual(files, make):
    scan = s.scope_counterfactual(files, "legacy_status")
    assert scan.select("inspected_files", "matched_files", "complete").first().asDict() == {"inspected_files": 5, "matched_files": 3, "complete": True}
    row = s.counterfactual_summary(scan, make("id int", *[(i,) for i in range(7)])).first()
    assert (row["minimum_additional"], row["graph_expands_inventory"]) == (4, True)
    broken = s.counterfactual_summary(scan.withColumn("complete", F.lit(False)), make("id int", (1,))).first()
    assert (broken["minimum_additional"], broken["graph_expands_inventory"]) == (None, False)


@pytest.mark.parametrize("text, kept", [
    (" fine text ", "fine text"), ("", None), ("   ", None), (None, None), ("see /home/x", None), ("C:\\\\temp", None), ("at HTTP://x", None), ("urn:li:x", None),
    ("mail a@b.org", None), ("Select a from b", None), ("select only", "select only"), ("token = x", None), ("tokens = x", "tokens = x"),
])
def test_public_text(make, text, kept):
    row = make("t string", (text,)).select(public_text(F.col("t"), "withheld").alias("r")).first()["r"]
    assert row == (kept or "withheld")


def test_redaction_and_forbidden(make, got):
    import hashlib

    df = make("text string, user_token string, password string, query_text string, deep array<struct<email:string,note:string,sql:string>>, tags map<string,string>",
              ("to A.B@x.org, c@d.io", "k", "p", 'say "1"', [("a@b.io", "c@d.io", "x")], {"Secret": "s", "n": "e@f.io"}), (None,) * 6)
    first, empty = s.redact_observations(df).collect()
    assert (first["text"], first["user_token"], first["password"]) == ("to [redacted-email], [redacted-email]", "k", "[redacted]")
    assert first["query_text"].asDict() == {"redacted": True, "digest": "sha256:" + hashlib.sha256(json.dumps('say "1"').encode()).hexdigest()}
    assert (first["deep"][0]["email"], first["deep"][0]["note"], first["deep"][0]["sql"]["redacted"]) == ("[redacted]", "[redacted-email]", True)
    assert first["tags"] == {"Secret": "[redacted]", "n": "[redacted-email]"} and empty["text"] is None and empty["password"] is None
    docs = make("doc int, text string", (1, "/home/me/x"), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, "PASSWORD: 'abcdefghijkl'"), (4, "password: short"), (5, "/home/"))
    assert got(s.forbidden_scan(docs)) == [(1, "home path"), (2, "private key"), (3, "credential value")]


def test_file_audit(spark, make, got, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.bin").write_bytes(b"")
    digests = fs.read_file_digests(spark, str(tmp_path))
    abc = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert dict((p, (n, h)) for p, n, h in got(digests))["a.bin"] == (3, abc)
    rev, url = "a" * 40, "https://h"
    kind = "asset_id string, path string, format string, size_bytes bigint, sha256 string, license_id string, revision string, source_url string, members array<string>"

    def entry(asset, path="a.bin", size=3, sha=abc, licence="CC0-1.0", revision=rev, members=(), link=None):
        return (asset, path, "zip" if members else "csv", size, sha, licence, revision, link or f"{url}/{revision}/{path}", list(members))

    registry = make(kind, entry("ok"), entry("gone", "z"), entry("size", size=4), entry("sum", sha="0"), entry("licence", licence="X"), entry("pin", revision="main"),
                    entry("url", link="https://h/x"), entry("members", members=["m"]), entry("twice"), entry("twice"))
    audited = s.file_audit(registry, digests.withColumn("members", F.array().cast("array<string>")), url)
    assert got(audited.distinct(), "asset_id", "refusal_code") == [
        ("gone", "DATASET_CACHE_MISSING"), ("licence", "DATASET_LICENSE_UNAPPROVED"), ("members", "DATASET_ARCHIVE_UNEXPECTED_MEMBER"), ("ok", None),
        ("pin", "DATASET_SOURCE_UNPINNED"), ("size", "DATASET_SIZE_MISMATCH"), ("sum", "DATASET_CHECKSUM_MISMATCH"), ("twice", "DATASET_REGISTRY_INVALID"),
        ("url", "DATASET_SOURCE_UNPINNED")]


def test_sources(spark, make, got, tmp_path):
    side = {"platform": "p", "instance": "i", "database": "d", "schema": "s", "table": "t", "field": "f"}
    (tmp_path / "specs").mkdir()
    (tmp_path / "specs" / "a.json").write_text(json.dumps({"spec_id": "1", "target": side, "replacement": side, "unknown": 1}))
    specs = fs.read_specs(spark, str(tmp_path / "specs"))
    assert got(fs.declared_identity(specs)) == [("1", "p", "i", "d", "s", "t", "PROD")]
    assert fs.spec_digest(specs).first()["specification_digest"].startswith("sha256:")
    (tmp_path / "log").mkdir()
    event = {"campaign_id": "c", "sequence": 1, "event_type": "CAMPAIGN_CREATED", "occurred_at": "2024-01-01T02:00:00+02:00",
             "payload": {"consumers": [{"id": "a", "disposition": "OPAQUE"}], "evidence_envelope": {"mode": "live", "sources": []}}}
    (tmp_path / "log" / "a.json").write_text(json.dumps(event))
    row = fs.read_events(spark, str(tmp_path / "log")).first()
    assert json.loads(row["payload"])["consumers"] == event["payload"]["consumers"] and row["occurred_at"].hour in (0, 2, 1)
    manifest = {"nodes": {"m.a": {"resource_type": "model", "config": {"meta": {"urn": "u"}}}, "t.b": {"resource_type": "test"}}}
    nodes = fs.explode_manifest(make("campaign_id int, raw string", (1, json.dumps(manifest))), "raw", "$.config.meta.urn")
    assert got(nodes) == [(1, "m.a", "model", "u"), (1, "t.b", "test", None)]
    df = make("a int, b string", (1, "x"), (2, None))
    fs.write_csv_table(df, str(tmp_path / "csv"))
    assert got(fs.read_csv_table(spark, str(tmp_path / "csv"), "a int, b string")) == [(1, "x"), (2, None)]
    write_result(df, str(tmp_path / "out.parquet"))
    assert got(Tables(spark, str(tmp_path)).out) == [(1, "x"), (2, None)]
    (tmp_path / "repo" / "models").mkdir(parents=True)
    (tmp_path / "repo" / "models" / "a.sql").write_text("select 1\nfrom t")
    assert got(fs.read_text_files(spark, str(tmp_path / "repo"), "r")) == [("r", "models/a.sql", "select 1\nfrom t")]


def test_coverage_rollup_recovery(make, got):
    campaigns = make("campaign_id int, mode string", (1, "live"), (2, "live"), (3, "fixture"), (4, "live"))
    sources = make("campaign_id int, required boolean, status string", (1, True, "COMPLETE"), (1, False, "STALE"), (2, True, "COMPLETE"), (2, True, None), (3, True, "COMPLETE"), (4, False, "COMPLETE"))
    assert got(r.source_coverage(campaigns, sources), "campaign_id", "coverage", "gaps") == [(1, "BOUNDED_COMPLETE", 0), (2, "INCOMPLETE", 1), (3, "NON_LIVE", 0), (4, "UNKNOWN", 0)]
    decisions = make("campaign_id int, decision string, blockers bigint, reviews bigint", (1, "READY_TO_RETIRE", 0, 0), (2, "UNSAFE", 2, 1), (3, "READY_TO_RETIRE", 0, 0))
    consumers = make("campaign_id int, disposition string, receipt_digest string", (1, "VALIDATED", "r"), (2, "OPAQUE", None), (2, "REMOVED", None))
    rolled = {row["campaign_id"]: row for row in r.campaign_rollup(decisions, consumers, make("campaign_id int", (3,))).collect()}
    assert (rolled[2]["open"], rolled[2]["conditions"], rolled[1]["next_action"], rolled[3]["next_action"]) == (1, 3, r.PUBLISH_FIRST, r.NEXT_ACTION["READY_TO_RETIRE"])
    explained = r.explain_blockers(make("code string", ("IDENTITY_NOT_FOUND",), ("CONTRACT_X",), ("GATE",)))
    assert dict(got(explained, "code", "evidence_source")) == {
        "IDENTITY_NOT_FOUND": "native identity mapping", "CONTRACT_X": r.DEFAULT_RECOVERY[0], "GATE": r.DEFAULT_RECOVERY[0]}


def test_metrics(spark, make, got):
    from test_events import CREATED, LOG, log_rows

    envelope = {"mode": "live", "sources": [{"id": "catalog", "required": True, "status": "STALE"}]}
    events = (CREATED, ("INVENTORY_RECORDED", {"consumers": [{"id": "a", "disposition": "OPAQUE"}], "evidence_envelope": envelope}))
    log = spark.createDataFrame(log_rows("c", events), LOG)
    attempts = make("status string, refusal_code string", *[("REFUSED", "GATE_STATE_DRIFT")] * 3)
    claims = make("released_at string", (None,), ("t",))
    now = F.max("occurred_at")
    last = log.agg(now.alias("t")).select((F.col("t") + F.expr("INTERVAL 89400 SECONDS")).alias("t")).first()["t"]
    rows = r.operational_metrics(log, attempts, claims, F.lit(last), 86_400)
    values = {(m, label): v for m, label, v in got(rows)}
    assert values[("stuck_campaigns", "")] == 1 and values[("stale_campaigns", "")] == 1 and values[("repeated_refusal", "GATE_STATE_DRIFT")] == 3
    assert values[("active_claims", "")] == 1 and values[("campaign_state", "INVENTORIED")] == 1
    assert r.health(rows).first().asDict() == {"healthy": False, "alerts": 3}
    assert got(r.stuck_campaigns(log, F.lit(last), 86_400), "age_seconds") == [(89400,)]
    with pytest.raises(ValueError):
        r.operational_metrics(log, attempts, claims, F.lit(last), 0)


def test_public_export(make, got):
    consumers = make("campaign_id int, consumer_id string, disposition string, receipt_digest string", (1, "z", "VALIDATED", "r"), (1, "a", "STALE", "r"), (2, "m", "VALIDATED", None))
    assert got(r.public_consumers(consumers), "campaign_id", "label", "receipt_state") == [
        (1, "consumer-001", r.RECEIPT_LABELS["STALE"]), (1, "consumer-002", r.RECEIPT_LABELS["VALIDATED"]), (2, "consumer-001", r.RECEIPT_LABELS["MISSING"])]


def test_manifest_nodes_with_files_and_dependencies(make, got):
    manifest = {"nodes": {
        "model.p.a": {"resource_type": "model", "original_file_path": "models/a.sql", "compiled_code": "select old as x", "depends_on": {"nodes": ["seed.p.s", "model.p.b"]}},
        "model.p.b": {"resource_type": "model", "original_file_path": "models/b.sql", "compiled_code": "select older", "depends_on": {"nodes": []}},
        "seed.p.s": {"resource_type": "seed", "original_file_path": "seeds/s.csv"}, "snapshot.p.x": {"resource_type": "snapshot"}, "odd": 3, "none": None}}
    manifests = make("repository_id string, raw string", ("r", json.dumps(manifest)), ("empty", "{}"), ("broken", "{"), ("listed", '{"nodes": []}'))
    files = make("repository_id string, path string, text string", ("r", "models/a.sql", "select {{ f }}"), ("r", "seeds/s.csv", "id,old\n"), ("q", "models/b.sql", "old"))
    found = s.manifest_scan(manifests, files, "old").withColumn("depends_on", F.concat_ws(",", "depends_on"))
    fingerprint = "sha256:" + hashlib.sha256(b"id,old\n").hexdigest()
    assert got(found, "repository_id", "unique_id", "depends_on", "compiled_contains_target", "fingerprint", "named_dependencies", "refusal_code") == [
        ("broken", None, "", None, None, None, "SOURCE_DBT_UNAVAILABLE"), ("empty", None, "", None, None, None, "SOURCE_DBT_UNAVAILABLE"),
        ("listed", None, "", None, None, None, "SOURCE_DBT_UNAVAILABLE"),
        ("r", "model.p.a", "model.p.b,seed.p.s", True, None, 1, None), ("r", "model.p.b", "", False, None, 0, None), ("r", "seed.p.s", "", False, fingerprint, 0, None)]
    assert got(s.dbt_dependencies(s.dbt_nodes(manifests)), "upstream", "downstream") == [("model.p.b", "model.p.a"), ("seed.p.s", "model.p.a")]


def test_archives_are_read_by_their_directory(spark, make, tmp_path, got):
    for name, members in {"good": ["a", "d/b"], "twice": ["a", "a", "d/b"], "less": ["a"], "climbs": ["a", "../b"], "folder": ["a", "d/"]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            for member in members:
                archive.writestr(zipfile.ZipInfo(member), b"x" * 100_000)
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    (tmp_path / "plain.csv").write_bytes(b"a,b")
    archives = fs.read_archives(spark, str(tmp_path))
    assert dict(got(archives, "path", "members")) == {
        "good.zip": ["a", "d/b"], "twice.zip": ["a", "a", "d/b"], "less.zip": ["a"], "climbs.zip": ["a", "../b"], "folder.zip": ["a", "d/"], "broken.zip": None}
    files = archives.unionByName(fs.read_file_digests(spark, str(tmp_path), "*.csv"), allowMissingColumns=True)
    held = {r["path"]: (r["length"], r["sha256"]) for r in files.collect()}
    revision = "0" * 40
    listed = {"climbs.zip": ["a", "../b"], "folder.zip": ["a", "d/"], "plain.csv": []}
    entries = [(f"{p}{'!' if bad else ''}", p, kind, *held[p], "CC0-1.0", revision, f"u/{revision}/{p}", members) for p in held for bad, kind, members in [
        (False, "zip" if p.endswith("zip") else "csv", listed.get(p, ["d/b", "a"])), (True, "zip" if p.endswith("zip") else "csv", ["a"] if p == "plain.csv" else [])]]
    registry = make("asset_id string, path string, format string, size_bytes bigint, sha256 string, license_id string, revision string, source_url string, members array<string>", *entries)
    code = dict(got(s.file_audit(registry, files, "u"), "asset_id", "refusal_code"))
    assert {k for k, v in code.items() if v == "DATASET_REGISTRY_INVALID"} == {f"{p}!" for p in held}
    assert {k for k, v in code.items() if v is None} == {"good.zip", "plain.csv"}
    assert {k for k, v in code.items() if v == "DATASET_ARCHIVE_UNEXPECTED_MEMBER"} == {"twice.zip", "less.zip", "climbs.zip", "folder.zip", "broken.zip"}


def test_stores_by_their_scheme():
    assert fs.storage_uri("s3a://b/k/x y.zip") == "s3://b/k/x y.zip" and fs.storage_uri("s3n://b/k") == "s3://b/k"
    assert fs.storage_uri("file:///tmp/x") == fs.storage_uri("file:/tmp/x") == "/tmp/x" and fs.storage_uri("hdfs://n:1/x") == "hdfs://n:1/x"
    store, name = fs.opened("mock:///folder/file")
    assert store.type_name == "mock" and name == "folder/file"


def test_small_files_share_tasks(spark, tmp_path, got):
    for i in range(300):
        with zipfile.ZipFile(tmp_path / f"d{i}.zip", "w") as archive:
            archive.writestr("a", str(i))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a partition for every file
    try:
        found = fs.read_archives(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["path"]: r["sha256"] for r in rows} == {
        f"d{i}.zip": hashlib.sha256((tmp_path / f"d{i}.zip").read_bytes()).hexdigest() for i in range(300)}
    assert all(r["members"] == ["a"] for r in rows)
