import pytest
from pyspark.sql import functions as F

from sundown.operators import quality as q
from sundown.operators import sampling as s

SEED = 20260802


@pytest.fixture
def retail(make):
    """A small relationship-closed set of tables."""
    return {
        "orders": make("order_id string, customer_id string, promo_id string, order_date string, status string, amount double",
                       ("o1", "c1", "p1", "2024-01-01", "new", 5.0), ("o2", "c2", None, "2024-01-02", "old", 7.0)),
        "customers": make("customer_id string", ("c1",), ("c2",), ("c3",)),
        "items": make("item_id string, order_id string, product_id string", ("i1", "o1", "x1"), ("i2", "o2", "x2")),
        "products": make("product_id string, supplier_id string", ("x1", "s1"), ("x2", "s1"), ("x3", "s2"), ("x4", "s2")),
        "suppliers": make("supplier_id string", ("s1",), ("s2",)),
        "promotions": make("promo_id string", ("p1",), ("p2",)),
        "inventory": make("inventory_id string, product_id string, warehouse_id string",
                          ("n1", "x1", "w1"), ("n2", "x3", "w2"), ("n3", "x4", "w3")),
        "warehouses": make("warehouse_id string", ("w1",), ("w2",), ("w3",), ("w4",)),
        "shipments": make("shipment_id string, order_id string, warehouse_id string", ("h1", "o1", "w4")),
        "returns": make("return_id string, order_id string, product_id string", ("r1", "o1", "x3")),
    }


RULES = (
    s.Keep("customers", "customer_id", (("orders", "customer_id"),)),
    s.Keep("promotions", "promo_id", (("orders", "promo_id"),)),
    s.Keep("items", "order_id", (("orders", "order_id"),)),
    s.Keep("returns", "order_id", (("orders", "order_id"),)),
    s.Keep("shipments", "order_id", (("orders", "order_id"),)),
    s.Keep("products", "product_id", (("items", "product_id"), ("returns", "product_id"))),
    s.Keep("suppliers", "supplier_id", (("products", "supplier_id"),)),
    s.Keep("inventory", "product_id", (("products", "product_id"),)),
    s.Keep("warehouses", "warehouse_id", (("inventory", "warehouse_id"), ("shipments", "warehouse_id"))),
)


def test_closed_slice(retail, make, got):
    kept = s.closed_slice(retail, "orders", make("order_id string", ("o1",)), "order_id", RULES)
    ids = {name: [r[0] for r in got(df.select(df.columns[0] if name != "products" else "product_id"))] for name, df in kept.items()}
    assert ids["customers"] == ["c1"] and ids["promotions"] == ["p1"]
    assert ids["products"] == ["x1", "x3"], "products of items and of returns"
    assert ids["suppliers"] == ["s1", "s2"] and ids["warehouses"] == ["w1", "w2", "w4"]


@pytest.mark.parametrize("limit", [1, 7, 50, 10_001, None])
def test_stable_sample(spark, got, limit):
    import hashlib

    n = 12_000 if limit == 10_001 else 60
    df = spark.range(n).select(F.col("id").cast("string").alias("k"))
    expected = sorted((str(i) for i in range(n)), key=lambda v: (hashlib.sha256(f"{SEED}:{v}".encode()).hexdigest(), v))[:limit]
    assert sorted(r["k"] for r in s.stable_sample(df.union(df), "k", SEED, limit).collect()) == sorted(expected)


def test_sample_share_of_empty_and_tiny(make):
    empty, one = make("k string"), make("k string", ("a",))
    assert s.stable_sample(empty, "k", 1, s.one_percent()).count() == 0
    assert s.stable_sample(one, "k", 1, s.one_percent()).count() == 1


def test_faults(spark, got):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), F.element_at(
        F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("v")).withColumn("old", F.col("v"))
    every = s.fault_variants(df, "k", "v", SEED)
    manifest = {r["variant_id"]: r for r in s.fault_manifest(every, "v", "consumer").collect()}
    assert {v: (r["affected_count"], r["affected_rate"]) for v, r in manifest.items()} == {
        "null-inflated": (3, 0.01), "semantic-drift": (3, 0.01), "unmapped-value": (3, 0.01)}
    moved = {(r["old"], r["v"]) for r in every.filter("variant_id = 'semantic-drift' AND affected").collect()}
    assert moved <= {("a", "b"), ("b", "c"), ("c", "a")}
    found = q.fault_detection(every, "k", "old", "v", ("a", "b", "c"))
    assert found.filter("NOT detected").count() == 0
    assert found.filter("NOT must_fail AND failing_rows > 0").count() == 0


def test_drift_with_one_status_changes_nothing(make, got):
    df = make("k string, v string", ("1", "a"), ("2", "a"))
    assert got(s.inject_semantic_drift(df, "k", "v", 1), "v") == [("a",), ("a",)]


def test_primary_key_audit(make, got):
    df = make("a string, b int", ("x", 1), ("x", 1), (None, 1), (None, 2), ("", 3))
    assert got(q.primary_key_audit(df, ["a"], "t")) == [("t", 5, 3, 2, 5)]
    assert got(q.primary_key_audit(df, ["a", "b"], "t")) == [("t", 5, 3, 1, 4)]
    assert got(q.primary_key_audit(make("a string"), ["a"], "t")) == [("t", 0, 0, 0, 0)]


def test_foreign_key_audit(make, got):
    child = make("k string", ("a",), ("a",), ("z",), (None,))
    parent, with_null = make("k string", ("a",)), make("k string", ("a",), (None,))

    def count(parent_df, nullable):
        return q.foreign_key_audit({"c": child, "p": parent_df}, [q.ForeignKey("c", ("k",), "p", ("k",), nullable)]).first()["violations"]

    assert (count(parent, False), count(parent, True), count(with_null, False)) == (2, 1, 1)


def test_parity_counts_and_bounds(make, got):
    df = make("l string, r string, n double, d date", ("a", "a", 1.0, None), ("a", None, -2.0, None), (None, None, 3.0, None))
    assert got(q.pair_parity(df, "l", "r")) == [(1, 2)]
    assert got(q.category_counts(df, "r")) == [("None", 2), ("a", 1)]
    assert got(q.value_bounds(df, "n", "d")) == [(-2.0, 3.0, None, None)]
    assert got(q.value_bounds(df.filter("false"), "n", "d")) == [(None, None, None, None)]
    assert got(q.numeric_bound_audit({"t": df}, [q.NumericBound("t", "n")])) == [("t", "n", 1)]


def test_temporal_audit(make):
    orders = make("o string, od string", ("1", "2024-01-05"), ("2", "2024-01-01"))
    ship = make("o string, s string, d string", ("1", "2024-01-04", "2024-01-03"), ("2", "2024-01-02", None), ("2", None, "2024-01-01"))
    rules = [q.TemporalRule("ship", "s", "od", "orders", "o", "o"), q.TemporalRule("ship", "d", "s")]
    result = {r["rule"]: r["violations"] for r in q.temporal_audit({"orders": orders, "ship": ship}, rules).collect()}
    assert result == {"s<orders.od": 1, "d<s": 1}


def test_report_and_gate(retail):
    contract = q.QualityContract(
        primary_keys={"orders": ("order_id",), "items": ("item_id",)},
        foreign_keys=(q.ForeignKey("orders", ("promo_id",), "promotions", ("promo_id",), True),
                      q.ForeignKey("items", ("order_id",), "orders", ("order_id",))),
        pair=("orders", "status", "status"), bounds=(q.NumericBound("orders", "amount"),))
    gate = q.quality_gate(q.quality_report(retail, contract)).first()
    assert (gate["total_violations"], gate["refusal_code"]) == (0, None)
    broken = {**retail, "orders": retail["orders"].union(retail["orders"].limit(1))}
    assert q.quality_gate(q.quality_report(broken, contract)).first()["refusal_code"] == "VALIDATION_RECEIPT_FAILED"


def test_orphan_probe_counts_a_row_once(make, got):
    child = make("a string, b string", ("x", "y"), ("x", "1"), ("1", "1"), (None, "1"))
    parent = make("k string", ("1",))
    assert got(q.orphan_probe({"c": child, "p": parent}, {"c": (("a", "p", "k"), ("b", "p", "k"))})) == [("c", 3)]


def test_branches(make, got):
    raw = make("amount string, name string, age string, a string, d string",
               ("-10", None, "130", "2024-01-03", "2024-01-01"), ("12abc", "n", "x", "2024-01-01", "bad"))
    billing = make("amount double, name string, stay int", (-10.0, None, -2))
    tables = {"raw": raw, "billing": billing}
    counts = q.branch_fault_counts(tables, [
        q.Branch("raw", "amount", "name", "age", "a", "d"), q.Branch("billing", "amount", "name", stay_days="stay")])
    assert got(counts) == [("billing", 1, 1, 1, None, 1, 0), ("raw", 2, 1, 1, 1, 1, 1)]
    picked = q.branch_selectivity(counts, tables, ("amount", "age"), "null_name")
    assert got(picked) == [("billing", "amount", 1, True), ("raw", "age,amount", 1, True)]


def test_layers_and_volume(make):
    raw, staging = make("t string", ("2024-01-10 12:00:00",)), make("t string", ("2024-01-01",))
    row = q.layer_freshness({"raw": (raw, "t"), "staging": (staging, "t")}, "raw", "staging", 3).first()
    assert (row["gap_days"], row["gap_discrepancy"]) == (9, True)
    assert q.volume_probe(make("n int", (0,), (4,)), "n").first().asDict() == {"total_volume": 4, "empty_days": 1}


def test_table_diff_sees_both_sides(make, got):
    actual, expected = make("v int", (1,), (2,), (2,)), make("v int", (2,), (3,))
    assert got(q.table_diff(actual, expected)) == [(1, "actual", 1), (2, "actual", 1), (3, "expected", 1)]
    assert got(q.table_diff(actual, expected, "parity")) == [(3,)], "the one-sided chain misses the extra rows"


def test_table_diff_deals_rows_before_it_sums_them(make, got):
    actual, expected = make("k int, v double", (1, 0.0), (None, None), (2, 1.5), (2, 1.5)), make("k int, v double", (1, -0.0), (None, None), (2, 1.5))
    diff = q.table_diff(actual, expected)
    assert got(diff) == [(2, 1.5, "actual", 1)], "zeros of both signs and nulls are equal"
    plan = diff._jdf.queryExecution().sparkPlan().toString()
    first = plan[plan.rindex("HashAggregate"):]  # the innermost sums
    assert "REPARTITION_BY_COL" in first


def test_twins(make, got):
    a, b = make("x int, y string", (1, "a"), (2, None)), make("x int, y string", (2, None), (1, "a"))
    assert got(q.twins_equal({"t": a}, {"t": b})) == [("t", 2, 2, True)]
    assert got(q.twins_equal({"t": a}, {"t": b.limit(1)}), "equal") == [(False,)]
    assert got(q.twins_equal({"t": a}, {"u": b}), "equal") == [(False,), (False,)]
