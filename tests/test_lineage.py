import random

import pytest
from pyspark.sql import functions as F

from sundown.functions.identity import consumer_id, parse_urn
from sundown.operators import evidence as e
from sundown.operators import lineage as g

URN = "urn:li:dataset:(urn:li:dataPlatform:{},{},{})"


@pytest.mark.parametrize("urn, parts", [
    (URN.format("pg", "i.d.s.t", "PROD"), ("pg", "i", "d", "s", "t", "PROD")),
    (URN.format("pg", "i.d.s.t", "PROD,X"), ("pg", "i", "d", "s", "t", "PROD,X")),
    (URN.format("pg", "d.s.t", "PROD"), None),
    (URN.format("pg", "i..s.t", "PROD"), None),
    (URN.format("pg", "i.d.s.t.", "PROD"), None),
    ("urn:li:chart:(x,y)", None),
    (URN.format("pg", "i.d.s.t", "PROD")[:-1], None),
])
def test_parse_urn(make, urn, parts):
    parsed = make("u string", (urn,)).select(parse_urn("u").alias("p")).first()["p"]
    assert (tuple(parsed) if parsed else None) == parts


def test_resolve_identity(make, got):
    spec = "spec_id string, platform string, instance string, database string, schema string, table string, environment string"
    base = ("pg", "i", "d", "s", "t", "PROD")
    specs = make(spec, ("same", *base), ("upper", "pg", "i", "d", "s", "T", "PROD"), ("other", "pg", "j", "d", "s", "t", "PROD"))
    catalog = make("urn string", (URN.format("pg", "i.d.s.t", "PROD"),), (URN.format("pg", "i.d.s.t", "PROD"),), ("broken",))
    assert got(g.resolve_identity(specs, catalog), "spec_id", "matches", "refusal_code") == [
        ("other", 0, "IDENTITY_NOT_FOUND"), ("same", 1, None), ("upper", 0, "IDENTITY_NOT_FOUND")]

    def loose(urn):  # a parser that two names share
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(g.IDENTITY_PARTS, base)])

    two = make("urn string", ("a",), ("b",))
    assert got(g.resolve_identity(specs.filter("spec_id = 'same'"), two, loose), "refusal_code", "urn") == [("IDENTITY_AMBIGUOUS", None)]


def test_resolve_field_keeps_duplicates(make, got):
    fields = make("urn string, field_path string, native_type string", ("u", "a", "T"), ("u", "b", "T"), ("u", "b", "T"))
    specs = make("spec_id string, urn string, field_path string", ("1", "u", "a"), ("2", "u", "b"), ("3", "u", "c"))
    assert got(g.resolve_field(specs, fields), "spec_id", "refusal_code") == [
        ("1", None), ("2", "IDENTITY_FIELD_AMBIGUOUS"), ("3", "IDENTITY_FIELD_NOT_FOUND")]


def test_type_levels(make, got):
    df = make("n int, target_type string, replacement_type string, model_target_type string, model_replacement_type string, "
              "receipt_target_type string, receipt_replacement_type string",
              (1, "TEXT", "text", "Text", "TEXT", "text", "text"), (2, "TEXT", None, "TEXT", "TEXT", "TEXT", "TEXT"),
              (3, "TEXT", "TEXT", "", "", "INT", "INT"))
    codes = {level: [r[0] is None for r in df.orderBy("n").select(g.type_compatibility(level)).collect()] for level in ("inventory", "strict", "drift")}
    assert codes == {"inventory": [False, True, True], "strict": [True, False, False], "drift": [True, False, False]}


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("f", "g"), ("b", "b"), ("x", "y")]


def test_closure(make, got):
    edges, start = make("upstream string, downstream string", *EDGES, *EDGES[:2]), make("start string", ("a",), ("x",), ("q",))
    three = g.downstream_closure(edges, start, 3)
    assert got(three, "start", "node", "degree", "bucket") == [
        ("a", "b", 1, "1"), ("a", "c", 2, "2"), ("a", "d", 1, "1"), ("a", "e", 3, "3+"), ("a", "f", 4, "3+"), ("a", "g", 5, "3+"),
        ("x", "y", 1, "1")]
    assert g.downstream_closure(edges, start, 2).filter("degree > 2").count() == 0
    assert g.downstream_closure(edges, make("start string", ("q",)), 3).count() == 0


def test_marked_closure_equals_two_walks(make, got):
    rng = random.Random(11)
    names = [*"abcdefghijklmnop", None]
    schema = "upstream string, downstream string, precision string"
    for strict, hops in ((False, 4), (True, 2), (True, 4), (False, 1)):
        rows = [(rng.choice(names), rng.choice(names), rng.choice(["field", "table", None])) for _ in range(36)]
        # d is reached the short way first, and by field edges only later; beyond it lie a missing node and one more.
        rows += [("a", "d", "table"), ("a", "q", "field"), ("q", "d", "field"), ("d", None, "field"), ("d", "z", "field")]
        edges, start = make(schema, *rows), make("start string", ("a",), ("b",), ("a",), (None,))
        by_field = F.col("precision") == "field"
        every, field = g.downstream_closure(edges, start, hops, strict), g.downstream_closure(edges.filter(by_field), start, hops, strict)
        once = g.downstream_closure(edges, start, hops, strict, marked=by_field)
        assert got(once, "start", "node", "degree", "bucket") == got(every, "start", "node", "degree", "bucket")
        assert got(g.classify_consumers(once, None, "f")) == got(g.classify_consumers(every, field, "f"))


def test_a_hop_shuffles_no_edges(spark, make, monkeypatch):
    plans, cut = [], g.cut_lineage
    monkeypatch.setattr(g, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g.downstream_closure(make("upstream string, downstream string", *EDGES), make("start string", ("a",)), 3).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 3 and not any("hashpartitioning(upstream" in p for p in plans)


def test_classify_pick_and_recall(make, got):
    edges = make("upstream string, downstream string, precision string, up_field string, down_field string",
                 ("t", "m", "field", "f", "f"), ("t", "b", "table", None, None), ("m", "s", "field", "f", "f"))
    start = make("start string", ("t",))
    every, field = g.downstream_closure(edges, start, 3), g.downstream_closure(edges.filter("precision = 'field'"), start, 3)
    found = g.classify_consumers(every, field, "f")
    assert got(found, "urn", "basis", "disposition") == [
        ("b", "canonical_lineage_edge", "OPAQUE"), ("m", "column_lineage_edge", "OPAQUE"), ("s", "column_lineage_edge", "OPAQUE")]
    assert found.filter(F.col("consumer_id") != consumer_id("urn")).count() == 0
    assert found.first()["consumer_id"].startswith("dh-") and len(found.first()["consumer_id"]) == 23
    picks = make("campaign_id int, urn string, entity_type string", (1, "a", "DATASET"), (1, "z", "CHART"), (1, "y", "DASHBOARD"), (2, "b", None))
    assert got(g.consequential_pick(picks), "campaign_id", "urn") == [(1, "y"), (2, "b")]
    recall = {r["kind"]: r for r in g.graph_recall(edges, edges.filter("downstream <> 'b'")).collect()}
    assert (recall["edge"]["recall"], recall["node"]["missing"], recall["field"]["recall"]) == (round(2 / 3, 8), 1, 1.0)


def test_manifest_and_context(make, got):
    campaigns = make("campaign_id int", (1,), (2,), (3,))
    nodes = make("campaign_id int, unique_id string, resource_type string, declared_urn string",
                 (1, "m1", "model", "u"), (1, "t1", "test", "u"), (2, "m2", "model", "u"), (2, "m3", "model", "u"), (3, "m4", "model", "w"))
    known = make("campaign_id int, urn string", (1, "u"), (2, "u"), (2, "u"), (3, "u"))
    assert got(g.map_manifest_nodes(campaigns, nodes, known), "campaign_id", "unique_id", "refusal_code") == [
        (1, "m1", None), (2, None, "IDENTITY_AMBIGUOUS"), (3, None, "IDENTITY_NOT_FOUND")]
    rolled = g.context_rollup(make("entity string", ("a",), ("b",)), make("entity string, owner string", ("a", "o"), ("a", "o"), ("a", "p")),
                              make("entity string, total int, returned int", ("a", 5, 2)))
    assert got(rolled, "entity", "owners", "queries_total", "closure_authority") == [("a", 2, 5, False), ("b", 0, 0, False)]


PAGE = "campaign_id int, bucket string, offset bigint, total bigint, returned bigint, is_partial boolean, cached boolean, failed boolean"


@pytest.mark.parametrize("pages, urns, status, limits", [
    ([("1", 0, 3, 2, False, False, False), ("1", 2, 3, 1, False, False, False)], "abc", "COMPLETE", []),
    ([("1", 0, 2, 2, None, None, False)], "ab", "COMPLETE", ["CACHE_NOT_EXPOSED", "PARTIAL_NOT_EXPOSED"]),
    ([("1", 0, 2, 2, False, True, False)], "ab", "PARTIAL", ["CACHE_USED"]),
    ([("1", 0, 3, 2, False, False, False), ("1", 2, 4, 1, False, False, False)], "abc", "PARTIAL", ["TOTAL_CHANGED"]),
    ([("1", 0, 2, 2, True, False, False)], "ab", "PARTIAL", ["MARKED_PARTIAL"]),
    ([("1", 0, 3, 2, False, False, False), ("1", 2, 3, 0, False, False, False)], "ab", "PARTIAL",
     ["EMPTY_PAGE_BEFORE_TOTAL", "TOTAL_NOT_REACHED"]),
    ([("1", 0, 2, 2, False, False, False), ("2", 0, 1, 1, False, False, False)], "aba", "PARTIAL", ["CONSUMER_REPEATED", "TOTAL_NOT_REACHED"]),
    ([("1", 0, 2, 2, False, False, False), ("2", 0, None, 0, None, None, True)], "ab", "PARTIAL", ["PAGE_FAILED"]),
    ([], "", "PARTIAL", ["PAGE_FAILED"]),
    ([("1", 0, 0, 0, False, False, False)], "", "COMPLETE", []),
    ([("1", 0, 2, 2, False, False, False)], ["a", None], "PARTIAL", ["TOTAL_NOT_REACHED"]),
])
def test_page_audit(make, pages, urns, status, limits):
    rows = make(PAGE, *[(1, *p) for p in pages])
    results = make("campaign_id int, urn string", *[(1, u) for u in urns])
    row = e.page_audit(make("campaign_id int", (1,)), rows, results).first()
    assert (row["status"], row["limitations"]) == (status, limits)


def test_freshness_and_merge(make, got):
    sources = make("status string, source_updated_at string, maximum_age_seconds int, limitations array<string>",
                   ("PARTIAL", None, 10, ["z"]), ("PARTIAL", "2024-01-01 00:00:00", 10, []), ("COMPLETE", "2024-01-01 00:00:01", 10, []))
    sources = sources.withColumn("source_updated_at", F.col("source_updated_at").cast("timestamp"))
    fresh = e.source_freshness(sources, F.to_timestamp(F.lit("2024-01-01 00:00:11")))
    assert [(r["status"], r["limitations"]) for r in fresh.collect()] == [
        ("PARTIAL", ["UPDATE_TIME_NOT_EXPOSED", "z"]), ("STALE", ["UPDATE_TIME_TOO_OLD"]), ("COMPLETE", [])]
    kind = "campaign_id int, source_id string, status string, required boolean, captured_at string"
    merged = e.merge_sources(make(kind, (1, "a", "X", True, "1"), (1, "b", "X", True, "1")), make(kind, (1, "b", "COMPLETE", True, "2"), (1, "c", "COMPLETE", True, "2")))
    assert got(merged, "source_id", "status") == [("a", "X"), ("b", "COMPLETE"), ("c", "COMPLETE")]
    assert got(e.envelope_header(merged)) == [(1, "2", 3, 1)]


def test_items_are_made_without_interpreted_filters(make, got):
    edges = make(
        "upstream string, downstream string, precision string, up_field string, down_field string, observed boolean",
        ("a", "b", "field", "x", "y", False), ("a", "b", "table", None, None, True), (None, "c", None, None, None, False))
    items = g.graph_items(edges)
    assert "filter(array(" not in items._jdf.queryExecution().optimizedPlan().toString().lower()
    assert got(g.tagged_differences(edges)) == [
        ("edge", "a>b", "changed"), ("edge", "c", "missing"), ("field", "a#x>b#y", "missing"),
        ("node", None, "missing"), ("node", "a", "same"), ("node", "b", "same"), ("node", "c", "missing")]


def test_inventory_is_not_made_distinct_for_its_semi_join(make, got):
    campaigns, nodes = make("campaign_id int", (1,), (2,)), make(
        "campaign_id int, unique_id string, resource_type string, declared_urn string", (1, "m", "model", "u"), (2, "n", "model", None))
    inventory = make("campaign_id int, urn string", (1, "u"), (1, "u"), (2, None))
    mapped = g.map_manifest_nodes(campaigns, nodes, inventory)
    assert got(mapped, "campaign_id", "matches") == [(1, 1), (2, 0)]
    assert mapped._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # per campaign only


def test_pairs_are_dealt_by_their_number(spark, make, tmp_path, got, monkeypatch):
    from sundown.plans import lineage_plans
    from sundown.sources.tables import Tables

    make("l_suppkey bigint, l_partkey bigint", *[(i % 5, i % 7) for i in range(70)]).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(lineage_plans, "TASK_ROWS", 10)
    pairs = lineage_plans._pairs(Tables(spark, str(tmp_path)), "l_suppkey", "l_partkey")
    assert pairs.count() == 35 and pairs.rdd.getNumPartitions() == 8
