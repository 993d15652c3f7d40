"""Sampling, fault and quality queries over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundown.operators import quality as q
from sundown.operators import sampling as s
from sundown.plans.twin import twin, view
from sundown.session import cut_lineage
from sundown.sources.tables import Tables
from sundown.vocabulary import FAULTS

SEED = 20260802
ACCEPTED = ("F", "O", "P")
CONSUMER = "orders_status_summary"


# --- derived views ------------------------------------------------------------------

def orders_base(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_totalprice").alias("total_amount"),
    )


view("orders_base", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
       o_orderstatus AS order_status, o_totalprice AS total_amount FROM orders
""")


def orders_pair(t: Tables) -> DataFrame:
    return s.with_legacy(orders_base(t), "legacy_status", "order_status")


view("orders_pair", "SELECT *, order_status AS legacy_status FROM orders_base")


def orders_broken(t: Tables) -> DataFrame:
    """Orders whose customer is unknown for multiples of 97 and null for multiples of 101."""
    return t.orders.withColumn(
        "o_custkey",
        F.when(F.col("o_custkey") % 97 == 0, F.col("o_custkey") + F.lit(1_000_000_000))
        .when(F.col("o_custkey") % 101 == 0, F.lit(None))
        .otherwise(F.col("o_custkey")),
    )


view("orders_broken", """
SELECT * REPLACE (CASE WHEN o_custkey % 97 = 0 THEN o_custkey + 1000000000
                       WHEN o_custkey % 101 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders
""")


def branches(t: Tables) -> dict[str, DataFrame]:
    key = F.col("c_custkey")
    admitted = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))
    discharged = F.date_add(admitted, (key % 7 - 2).cast("int"))
    raw = t.customer.select(
        F.col("c_acctbal").alias("amount"),
        F.when(key % 97 != 0, F.col("c_name")).alias("name"),
        F.when(key % 211 == 0, F.lit("n/a")).otherwise((key % 140).cast("string")).alias("age"),
        admitted.cast("string").alias("admitted"),
        discharged.cast("string").alias("discharged"),
        F.datediff(discharged, admitted).alias("stay_days"),
    )
    return {
        "raw": raw.drop("stay_days"),
        "billing": raw.select("amount", "name", "stay_days"),
        "demographics": raw.select("name", "age"),
    }


view("branch_raw", """
SELECT c_acctbal AS amount, CASE WHEN c_custkey % 97 <> 0 THEN c_name END AS name,
       CASE WHEN c_custkey % 211 = 0 THEN 'n/a' ELSE CAST(c_custkey % 140 AS VARCHAR) END AS age,
       c_custkey % 7 - 2 AS stay_days
FROM customer
""")

BRANCHES = (
    q.Branch("raw", amount="amount", person="name", age="age", admitted="admitted", discharged="discharged"),
    q.Branch("billing", amount="amount", person="name", stay_days="stay_days"),
    q.Branch("demographics", person="name", age="age"),
)


def layers(t: Tables) -> dict[str, tuple[DataFrame, str]]:
    """Raw events, a staging layer that stopped after the 21st, and its daily mart."""
    raw = t.events.select(F.to_date("ts").alias("event_date"))
    staging = raw.filter(F.dayofmonth("event_date") <= 21)
    return {"raw": (raw, "event_date"), "staging": (staging, "event_date"), "mart": (daily_mart(t), "event_date")}


def daily_mart(t: Tables) -> DataFrame:
    day = F.to_date("ts").alias("event_date")
    return t.events.groupBy(day).agg(F.count_if(F.dayofmonth("ts") <= 21).alias("event_count"))


view("daily_mart", """
SELECT CAST(ts AS DATE) AS event_date, count(*) FILTER (WHERE day(ts) <= 21) AS event_count FROM events GROUP BY 1
""")

FOREIGN_KEYS = (
    q.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    q.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    q.ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    q.ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    q.ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    q.ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    q.ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    q.ForeignKey("labels", ("doc_id",), "documents", ("doc_id",)),
    q.ForeignKey("orders_broken", ("o_custkey",), "customer", ("c_custkey",)),
)
NULLABLE_KEY = q.ForeignKey("orders_broken", ("o_custkey",), "customer", ("c_custkey",), nullable=True)


def key_tables(t: Tables) -> dict[str, DataFrame]:
    names = ("orders", "lineitem", "customer", "supplier", "part", "nation", "region", "labels", "documents")
    return {**{n: getattr(t, n) for n in names}, "orders_broken": orders_broken(t)}


def _fk_sql(child: str, column: str, parent: str, parent_column: str, nullable: bool = False) -> str:
    skip = f"c.{column} IS NOT NULL AND " if nullable else ""
    return (
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table, count(*) AS violations "
        f"FROM {child} c WHERE {skip}NOT EXISTS (SELECT 1 FROM {parent} p "
        f"WHERE p.{parent_column} IS NOT DISTINCT FROM c.{column})"
    )


FOREIGN_KEY_SQL = "\nUNION ALL\n".join(
    _fk_sql(k.child, k.child_columns[0], k.parent, k.parent_columns[0]) for k in FOREIGN_KEYS
)

CONTRACT = q.QualityContract(
    primary_keys={
        "orders": ("o_orderkey",),
        "lineitem": ("l_orderkey", "l_linenumber"),
        "customer": ("c_custkey",),
        "supplier": ("s_suppkey",),
    },
    foreign_keys=FOREIGN_KEYS,
    pair=("drifted", "legacy_status", "order_status"),
    temporal=(q.TemporalRule("lineitem", "l_shipdate", "o_orderdate", "orders", "l_orderkey", "o_orderkey"),),
    bounds=(
        q.NumericBound("drifted", "total_amount"),
        q.NumericBound("customer", "c_acctbal"),
        q.NumericBound("supplier", "s_acctbal"),
    ),
)


def quality_tables(t: Tables) -> dict[str, DataFrame]:
    drifted = s.inject_nulls(orders_pair(t), "order_id", "order_status", SEED)
    return {**key_tables(t), "drifted": drifted}


# The same one-percent selection, written as a plain ranking.
for _variant, (_salt, _) in FAULTS.items():
    view(f"hit_{_salt}", f"""
SELECT order_id FROM (
  SELECT order_id, row_number() OVER (ORDER BY sha256('{SEED + _salt}:' || CAST(order_id AS VARCHAR)),
         CAST(order_id AS VARCHAR)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT order_id FROM orders_pair)
) WHERE rn <= greatest(1, n // 100)
""")
view("next_value", """
SELECT order_status AS status, coalesce(lead(order_status) OVER (ORDER BY order_status),
       min(order_status) OVER ()) AS successor FROM (SELECT DISTINCT order_status FROM orders_pair)
""")
view("variant_rows", """
SELECT 'null-inflated' AS variant_id, p.order_id, p.customer_id, p.order_date, p.total_amount, p.legacy_status,
       CASE WHEN h.order_id IS NULL THEN p.order_status END AS order_status, h.order_id IS NOT NULL AS affected
FROM orders_pair p LEFT JOIN hit_101 h USING (order_id)
UNION ALL
SELECT 'semantic-drift', p.order_id, p.customer_id, p.order_date, p.total_amount, p.legacy_status,
       CASE WHEN h.order_id IS NULL THEN p.order_status ELSE n.successor END, h.order_id IS NOT NULL
FROM orders_pair p LEFT JOIN hit_202 h USING (order_id) LEFT JOIN next_value n ON n.status = p.order_status
UNION ALL
SELECT 'unmapped-value', p.order_id, p.customer_id, p.order_date, p.total_amount, p.legacy_status,
       CASE WHEN h.order_id IS NULL THEN p.order_status ELSE '__unmapped__' END, h.order_id IS NOT NULL
FROM orders_pair p LEFT JOIN hit_303 h USING (order_id)
""")

_VARIANT_COLUMNS = ("variant_id", "order_id", "customer_id", "total_amount", "legacy_status", "order_status", "affected")


def _variant(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = s.inject_fault(orders_pair(Tables(spark, folder)), "order_id", "order_status", name, SEED)
        return rows.select(*_VARIANT_COLUMNS)

    return run


def variants(t: Tables) -> DataFrame:
    return s.fault_variants(orders_pair(t), "order_id", "order_status", SEED)


SLICE_ROOTS = 2_500
SLICE_RULES = (
    s.Keep("customer", "c_custkey", (("orders", "o_custkey"),)),
    s.Keep("lineitem", "l_orderkey", (("orders", "o_orderkey"),)),
    s.Keep("part", "p_partkey", (("lineitem", "l_partkey"),)),
    s.Keep("supplier", "s_suppkey", (("lineitem", "l_suppkey"),)),
    s.Keep("nation", "n_nationkey", (("customer", "c_nationkey"), ("supplier", "s_nationkey"))),
    s.Keep("region", "r_regionkey", (("nation", "n_regionkey"),)),
)
SLICE_KEYS = {
    "orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey", "part": "p_partkey",
    "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey",
}


def closed_slice(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    roots = s.stable_sample(t.orders, "o_orderkey", SEED, SLICE_ROOTS)
    kept = s.closed_slice({n: getattr(t, n) for n in SLICE_KEYS}, "orders", roots, "o_orderkey", SLICE_RULES)
    result: DataFrame | None = None
    for table, key in SLICE_KEYS.items():
        part = kept[table].agg(
            F.count(F.lit(1)).alias("kept_rows"),
            F.coalesce(F.sum(F.col(key).cast("bigint")), F.lit(0)).cast("bigint").alias("key_sum"),
        ).select(F.lit(table).alias("table_name"), "kept_rows", "key_sum")
        result = part if result is None else result.unionByName(part)
    return result


view("slice_orders", f"""
SELECT * FROM orders WHERE o_orderkey IN (SELECT k FROM (SELECT DISTINCT o_orderkey AS k FROM orders)
  ORDER BY sha256('{SEED}:' || CAST(k AS VARCHAR)), CAST(k AS VARCHAR) LIMIT {SLICE_ROOTS})
""")
view("slice_customer", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM slice_orders)")
view("slice_lineitem", "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM slice_orders)")
view("slice_part", "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM slice_lineitem)")
view("slice_supplier", "SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM slice_lineitem)")
view("slice_nation", """
SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM slice_customer)
   OR n_nationkey IN (SELECT s_nationkey FROM slice_supplier)
""")
view("slice_region", "SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM slice_nation)")


def _q(build):
    """Bind an operator that works on the opened tables."""
    return lambda spark, folder: build(Tables(spark, folder))


def _consumer_output(t: Tables) -> DataFrame:
    """What the consumer produces from the drifted table: statuses changed, every tenth-percent order twice."""
    rows = s.inject_semantic_drift(orders_pair(t), "order_id", "order_status", SEED)
    out = rows.select("order_id", F.col("order_status").alias("normalized_status"), "total_amount", "affected")
    copies = F.when(F.col("order_id") % 1000 == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.withColumn("_copy", F.explode(copies)).select("order_id", "normalized_status", "total_amount")


def _expected_output(t: Tables) -> DataFrame:
    return orders_pair(t).select("order_id", F.col("legacy_status").alias("normalized_status"), "total_amount")


view("consumer_output", """
SELECT order_id, order_status AS normalized_status, total_amount FROM variant_rows WHERE variant_id = 'semantic-drift'
UNION ALL
SELECT order_id, order_status, total_amount FROM variant_rows WHERE variant_id = 'semantic-drift' AND order_id % 1000 = 7
""")
view("expected_output", "SELECT order_id, legacy_status AS normalized_status, total_amount FROM orders_pair")

FINGERPRINT_COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}
# Fractions and times print differently in the two engines, so both compare whole millionths.
_FRACTIONS = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value")
_TIMES = ("o_orderdate", "l_shipdate", "ts")


def _printed(column: str) -> Column:
    """A column as a type that prints alike in every engine."""
    if column in _FRACTIONS:
        return F.floor(F.col(column) * 1_000_000)
    if column in _TIMES:
        return F.unix_micros(F.col(column).cast("timestamp"))
    if column == "embedding":
        return F.array_join(F.transform(column, lambda x: F.floor(x.cast("double") * 1_000_000).cast("string")), ",")
    return F.col(column)


def _printed_sql(column: str) -> str:
    if column in _FRACTIONS:
        return f"CAST(floor({column} * 1000000) AS BIGINT)"
    if column in _TIMES:
        return f"epoch_us({column})"
    if column == "embedding":
        return "array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',')"
    return column


def text_tables(t: Tables) -> dict[str, DataFrame]:
    """Every table with all its columns, as values that print alike in every engine."""
    return {n: getattr(t, n).select(*[_printed(c).alias(c) for c in columns]) for n, columns in FINGERPRINT_COLUMNS.items()}


def _fingerprint_sql(table: str, source: str | None = None) -> str:
    def part(column: str) -> str:
        value = f"CAST({_printed_sql(column)} AS VARCHAR)"
        return f"coalesce(CAST(length({value}) AS VARCHAR) || ':' || {value}, '~')"

    text = " || ".join(part(c) for c in sorted(FINGERPRINT_COLUMNS[table]))
    return (
        f"SELECT '{table}' AS table_name, count(*) AS row_count, coalesce(bit_xor(h), 0) AS hash_xor, "
        f"CAST(coalesce(sum(h), 0) AS VARCHAR) AS hash_sum "
        f"FROM (SELECT CAST(('0x' || substr(sha256({text}), 1, 15)) AS BIGINT) AS h FROM {source or table})"
    )


def twins(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    left = text_tables(t)
    altered = left["labels"].withColumn("quality", F.when(F.col("doc_id") % 50 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return q.twins_equal(left, {**left, "labels": altered})


view("labels_altered", """
SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN 1 - quality ELSE quality END AS quality) FROM labels
""")

QUERIES = {
    "a1_stable_sample": _q(lambda t: s.stable_sample(t.orders, "o_orderkey", SEED, 250)),
    "a1_stable_order": _q(lambda t: s.stable_sample(t.orders, "o_custkey", SEED)),
    "a1_stable_share": _q(lambda t: s.stable_sample(t.lineitem, "l_orderkey", SEED, s.one_percent())),
    "a2_closed_slice": closed_slice,
    "a3_with_legacy": _q(lambda t: orders_pair(t).select("order_id", "order_status", "legacy_status")),
    "a4_inject_nulls": _variant("null-inflated"),
    "a5_inject_semantic_drift": _variant("semantic-drift"),
    "a6_inject_unmapped": _variant("unmapped-value"),
    "a7_fault_manifest": _q(lambda t: s.fault_manifest(variants(t), "order_status", CONSUMER)),
    "a7_fault_rows": _q(lambda t: s.fault_rows(variants(t), "order_id")),
    "b1_primary_key_audit": _q(
        lambda t: q.primary_key_audit(t.orders, ("o_orderkey",), "orders")
        .unionByName(q.primary_key_audit(t.lineitem, ("l_orderkey", "l_linenumber"), "lineitem"))
        .unionByName(q.primary_key_audit(orders_broken(t), ("o_custkey",), "orders_broken"))
    ),
    "b2_foreign_key_audit": _q(lambda t: q.foreign_key_audit(key_tables(t), FOREIGN_KEYS)),
    "b2_nullable_foreign_key": _q(lambda t: q.foreign_key_orphans(key_tables(t), NULLABLE_KEY).select(
        F.col("_k0").alias("orphan_key"), F.col("rows").alias("row_count"))),
    "b3_pair_parity": _q(lambda t: q.pair_parity(
        s.inject_nulls(orders_pair(t), "order_id", "order_status", SEED), "legacy_status", "order_status")),
    "b4_category_counts": _q(lambda t: q.category_counts(
        s.inject_nulls(orders_pair(t), "order_id", "order_status", SEED), "order_status")),
    "b5_value_bounds": _q(lambda t: q.value_bounds(orders_pair(t), "total_amount", "order_date").select(
        "amount_min", "amount_max", F.col("date_min").cast("string").alias("date_min"),
        F.col("date_max").cast("string").alias("date_max"))),
    "b6_temporal_audit": _q(lambda t: q.temporal_audit(key_tables(t), CONTRACT.temporal)),
    "b7_numeric_bound_audit": _q(lambda t: q.numeric_bound_audit(
        key_tables(t), (q.NumericBound("orders", "o_totalprice"), q.NumericBound("customer", "c_acctbal"),
                        q.NumericBound("supplier", "s_acctbal")))),
    "b8_quality_report": _q(lambda t: q.quality_report(quality_tables(t), CONTRACT)),
    "b9_quality_gate": _q(lambda t: q.quality_gate(q.quality_report(quality_tables(t), CONTRACT))),
    "b10_orphan_probe": _q(lambda t: q.orphan_probe(key_tables(t), {
        "orders_broken": (("o_custkey", "customer", "c_custkey"),),
        "lineitem": (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"),
                     ("l_suppkey", "supplier", "s_suppkey")),
        "customer": (("c_nationkey", "nation", "n_nationkey"),),
        "labels": (("doc_id", "documents", "doc_id"),),
    })),
    "b11_row_counts": _q(lambda t: q.row_counts({n: getattr(t, n) for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")})),
    "b12_branch_fault_counts": _q(lambda t: q.branch_fault_counts(branches(t), BRANCHES).unpivot(
        ["branch"], ["row_count", *q.BRANCH_FAULTS], "measure", "row_total").filter("row_total IS NOT NULL")),
    "b13_branch_selectivity": _q(lambda t: q.branch_selectivity(
        q.branch_fault_counts(branches(t), BRANCHES), branches(t), ("amount", "age", "name"), "null_name")),
    "b14_layer_freshness": _q(lambda t: q.layer_freshness(layers(t), "raw", "staging", 3).select(
        *[F.col(c).cast("string").alias(c) if c.endswith("_date") else F.col(c) for c in (
            "raw_max_date", "staging_max_date", "mart_max_date", "raw_rows", "staging_rows", "mart_rows",
            "gap_days", "documented_gap_days", "gap_discrepancy")])),
    "b15_volume_probe": _q(lambda t: q.volume_probe(daily_mart(t), "event_count")),
    "b16_column_tests": _q(lambda t: q.column_tests(cut_lineage(variants(t)), q.ColumnTests(
        not_null=("order_id", "order_status", "total_amount"), unique=("order_id",),
        accepted={"order_status": ACCEPTED}), by=("variant_id",))),
    "b17_table_diff": _q(lambda t: q.table_diff(_consumer_output(t), _expected_output(t))),
    "b17_table_diff_parity": _q(lambda t: q.table_diff(_consumer_output(t), _expected_output(t), "parity")),
    "b18_fault_detection": _q(lambda t: q.fault_detection(
        variants(t), "order_id", "legacy_status", "order_status", ACCEPTED)),
    "b19_twins_equal": twins,
    "b20_table_fingerprints": _q(lambda t: q.table_fingerprints(text_tables(t))),
}

_REPORT_SQL = f"""
SELECT 'primary_key' AS check_name, 'orders' AS table_name, 'o_orderkey' AS column_name,
       count(*) - count(DISTINCT o_orderkey) AS violations FROM orders
UNION ALL SELECT 'primary_key', 'lineitem', 'l_orderkey,l_linenumber',
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'primary_key', 'customer', 'c_custkey', count(*) - count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'primary_key', 'supplier', 's_suppkey', count(*) - count(DISTINCT s_suppkey) FROM supplier
UNION ALL SELECT 'foreign_key', table_name, column_name, violations FROM ({FOREIGN_KEY_SQL})
UNION ALL SELECT 'temporal', 'lineitem', 'l_shipdate<orders.o_orderdate', count(*)
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'pair_mismatch', 'drifted', 'order_status', count(*) FROM variant_rows
       WHERE variant_id = 'null-inflated' AND legacy_status IS DISTINCT FROM order_status
UNION ALL SELECT 'replacement_null', 'drifted', 'order_status', count(*) FROM variant_rows
       WHERE variant_id = 'null-inflated' AND order_status IS NULL
UNION ALL SELECT 'numeric_bound', 'drifted', 'total_amount', count(*) FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'numeric_bound', 'customer', 'c_acctbal', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'numeric_bound', 'supplier', 's_acctbal', count(*) FROM supplier WHERE s_acctbal < 0
"""

_VARIANT_SQL = "SELECT " + ", ".join(_VARIANT_COLUMNS) + " FROM variant_rows WHERE variant_id = '{}'"

ORACLES = {
    "a1_stable_sample": f"""
SELECT o_orderkey, sha256('{SEED}:' || CAST(o_orderkey AS VARCHAR)) AS order_hash
FROM (SELECT DISTINCT o_orderkey FROM orders) ORDER BY 2, CAST(o_orderkey AS VARCHAR) LIMIT 250""",
    "a1_stable_order": f"""
SELECT o_custkey, sha256('{SEED}:' || CAST(o_custkey AS VARCHAR)) AS order_hash
FROM (SELECT DISTINCT o_custkey FROM orders)""",
    "a1_stable_share": f"""
SELECT l_orderkey, order_hash FROM (
  SELECT *, row_number() OVER (ORDER BY order_hash, CAST(l_orderkey AS VARCHAR)) AS rn, count(*) OVER () AS n FROM (
    SELECT DISTINCT l_orderkey, sha256('{SEED}:' || CAST(l_orderkey AS VARCHAR)) AS order_hash FROM lineitem))
WHERE rn <= greatest(1, n // 100)""",
    "a2_closed_slice": twin(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS kept_rows, CAST(coalesce(sum({k}), 0) AS BIGINT) AS key_sum FROM slice_{t}"
        for t, k in SLICE_KEYS.items())),
    "a3_with_legacy": twin("SELECT order_id, order_status, legacy_status FROM orders_pair"),
    "a4_inject_nulls": twin(_VARIANT_SQL.format("null-inflated")),
    "a5_inject_semantic_drift": twin(_VARIANT_SQL.format("semantic-drift")),
    "a6_inject_unmapped": twin(_VARIANT_SQL.format("unmapped-value")),
    "a7_fault_manifest": twin(f"""
SELECT variant_id, count(*) FILTER (WHERE affected) AS affected_count,
       round(count(*) FILTER (WHERE affected) / count(*), 8) AS affected_rate, 'order_status' AS field,
       CASE variant_id WHEN 'null-inflated' THEN 'set-to-null' WHEN 'semantic-drift'
            THEN 'replace-with-different-valid-status' ELSE 'set-to-unmapped-category' END AS mutation,
       '{CONSUMER}' AS impact
FROM variant_rows GROUP BY variant_id"""),
    "a7_fault_rows": twin("SELECT variant_id, order_id AS row_id FROM variant_rows WHERE affected"),
    "b1_primary_key_audit": twin("""
SELECT table_name, row_count, null_keys, duplicate_keys, null_keys + duplicate_keys AS violations FROM (
  SELECT 'orders' AS table_name, count(*) AS row_count, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_keys,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders)) AS duplicate_keys FROM orders
  UNION ALL
  SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL),
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem
  UNION ALL
  SELECT 'orders_broken', count(*), count(*) FILTER (WHERE o_custkey IS NULL),
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders_broken)) FROM orders_broken)"""),
    "b2_foreign_key_audit": twin(FOREIGN_KEY_SQL),
    "b2_nullable_foreign_key": twin("""
SELECT o_custkey AS orphan_key, count(*) AS row_count FROM orders_broken
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"""),
    "b3_pair_parity": twin("""
SELECT count(*) FILTER (WHERE legacy_status IS DISTINCT FROM order_status) AS mismatches,
       count(*) FILTER (WHERE order_status IS NULL) AS replacement_nulls
FROM variant_rows WHERE variant_id = 'null-inflated'"""),
    "b4_category_counts": twin("""
SELECT coalesce(order_status, 'None') AS value, count(*) AS row_count FROM variant_rows
WHERE variant_id = 'null-inflated' GROUP BY 1"""),
    "b5_value_bounds": """
SELECT min(o_totalprice) AS amount_min, max(o_totalprice) AS amount_max,
       CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS date_min, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS date_max
FROM orders""",
    "b6_temporal_audit": """
SELECT 'lineitem' AS table_name, 'l_shipdate<orders.o_orderdate' AS rule, count(*) AS violations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
    "b7_numeric_bound_audit": """
SELECT 'orders' AS table_name, 'o_totalprice' AS column_name, count(*) AS violations FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'customer', 'c_acctbal', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'supplier', 's_acctbal', count(*) FROM supplier WHERE s_acctbal < 0""",
    "b8_quality_report": twin(_REPORT_SQL),
    "b9_quality_gate": twin(f"""
SELECT CAST(sum(violations) AS BIGINT) AS total_violations,
       CASE WHEN sum(violations) <> 0 THEN 'VALIDATION_RECEIPT_FAILED' END AS refusal_code FROM ({_REPORT_SQL})"""),
    "b10_orphan_probe": twin("""
SELECT 'orders_broken' AS table_name, count(*) AS orphans FROM orders_broken LEFT JOIN customer ON o_custkey = c_custkey
WHERE c_custkey IS NULL
UNION ALL SELECT 'lineitem', count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
  WHERE o_orderkey IS NULL OR p_partkey IS NULL OR s_suppkey IS NULL
UNION ALL SELECT 'customer', count(*) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IS NULL
UNION ALL SELECT 'labels', count(*) FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL"""),
    "b11_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")),
    "b12_branch_fault_counts": twin("""
SELECT 'raw' AS branch, 'row_count' AS measure, count(*) AS row_total FROM branch_raw
UNION ALL SELECT 'raw', 'negative_amount', count(*) FROM branch_raw WHERE amount < 0
UNION ALL SELECT 'raw', 'null_name', count(*) FROM branch_raw WHERE name IS NULL
UNION ALL SELECT 'raw', 'invalid_age', count(*) FROM branch_raw WHERE TRY_CAST(age AS INT) NOT BETWEEN 0 AND 120
UNION ALL SELECT 'raw', 'date_swap', count(*) FROM branch_raw WHERE stay_days < 0
UNION ALL SELECT 'raw', 'unparseable', count(*) FROM branch_raw WHERE age = 'n/a'
UNION ALL SELECT 'billing', 'row_count', count(*) FROM branch_raw
UNION ALL SELECT 'billing', 'negative_amount', count(*) FROM branch_raw WHERE amount < 0
UNION ALL SELECT 'billing', 'null_name', count(*) FROM branch_raw WHERE name IS NULL
UNION ALL SELECT 'billing', 'date_swap', count(*) FROM branch_raw WHERE stay_days < 0
UNION ALL SELECT 'billing', 'unparseable', 0
UNION ALL SELECT 'demographics', 'row_count', count(*) FROM branch_raw
UNION ALL SELECT 'demographics', 'null_name', count(*) FROM branch_raw WHERE name IS NULL
UNION ALL SELECT 'demographics', 'invalid_age', count(*) FROM branch_raw WHERE TRY_CAST(age AS INT) NOT BETWEEN 0 AND 120
UNION ALL SELECT 'demographics', 'unparseable', count(*) FROM branch_raw WHERE age = 'n/a'"""),
    "b13_branch_selectivity": twin("""
SELECT branch, columns_present, (SELECT count(*) FROM branch_raw WHERE name IS NULL) AS fault_count, true AS propagates_to_all
FROM (VALUES ('raw', 'age,amount,name'), ('billing', 'amount,name'), ('demographics', 'age,name')) v(branch, columns_present)"""),
    "b14_layer_freshness": twin("""
SELECT CAST(r.d AS VARCHAR) AS raw_max_date, CAST(s.d AS VARCHAR) AS staging_max_date, CAST(m.d AS VARCHAR) AS mart_max_date,
       r.n AS raw_rows, s.n AS staging_rows, m.n AS mart_rows, CAST(r.d - s.d AS INT) AS gap_days,
       3 AS documented_gap_days, r.d - s.d <> 3 AS gap_discrepancy
FROM (SELECT max(CAST(ts AS DATE)) AS d, count(*) AS n FROM events) r,
     (SELECT max(CAST(ts AS DATE)) AS d, count(*) AS n FROM events WHERE day(ts) <= 21) s,
     (SELECT max(event_date) AS d, count(*) AS n FROM daily_mart) m"""),
    "b15_volume_probe": twin("""
SELECT CAST(sum(event_count) AS BIGINT) AS total_volume, count(*) FILTER (WHERE event_count = 0) AS empty_days FROM daily_mart"""),
    "b16_column_tests": twin("""
SELECT variant_id, 'not_null' AS test, 'order_id' AS column_name, count(*) FILTER (WHERE order_id IS NULL) AS failing_rows
FROM variant_rows GROUP BY 1
UNION ALL SELECT variant_id, 'not_null', 'order_status', count(*) FILTER (WHERE order_status IS NULL) FROM variant_rows GROUP BY 1
UNION ALL SELECT variant_id, 'not_null', 'total_amount', count(*) FILTER (WHERE total_amount IS NULL) FROM variant_rows GROUP BY 1
UNION ALL SELECT variant_id, 'accepted_values', 'order_status',
  count(*) FILTER (WHERE order_status NOT IN ('F', 'O', 'P')) FROM variant_rows GROUP BY 1
UNION ALL SELECT variant_id, 'unique', 'order_id', count(*) FILTER (WHERE n > 1)
  FROM (SELECT variant_id, order_id, count(*) AS n FROM variant_rows GROUP BY 1, 2) GROUP BY 1"""),
    "b17_table_diff": twin("""
SELECT order_id, normalized_status, total_amount, 'actual' AS side, count(*) AS copies
FROM (SELECT * FROM consumer_output EXCEPT ALL SELECT * FROM expected_output) GROUP BY ALL
UNION ALL
SELECT order_id, normalized_status, total_amount, 'expected', count(*)
FROM (SELECT * FROM expected_output EXCEPT ALL SELECT * FROM consumer_output) GROUP BY ALL"""),
    "b17_table_diff_parity": twin("""
SELECT * FROM consumer_output EXCEPT SELECT * FROM expected_output
UNION ALL SELECT * FROM expected_output EXCEPT SELECT * FROM consumer_output"""),
    "b18_fault_detection": twin("""
SELECT variant_id, test, failing_rows, must_fail, NOT must_fail OR failing_rows > 0 AS detected FROM (
  SELECT variant_id, test, failing_rows, (variant_id || '/' || test) IN ('null-inflated/not_null', 'null-inflated/parity',
    'semantic-drift/parity', 'unmapped-value/accepted_values', 'unmapped-value/parity') AS must_fail FROM (
    SELECT variant_id, 'not_null' AS test, count(*) FILTER (WHERE order_status IS NULL) AS failing_rows FROM variant_rows GROUP BY 1
    UNION ALL SELECT variant_id, 'accepted_values', count(*) FILTER (WHERE order_status NOT IN ('F', 'O', 'P')) FROM variant_rows GROUP BY 1
    UNION ALL SELECT variant_id, 'parity', count(*) FILTER (WHERE order_status IS DISTINCT FROM legacy_status) FROM variant_rows GROUP BY 1
    UNION ALL SELECT variant_id, 'unique', count(*) - count(DISTINCT order_id) FROM variant_rows GROUP BY 1))"""),
    "b19_twins_equal": twin(f"""
SELECT l.table_name, l.row_count AS left_rows, r.row_count AS right_rows,
       l.hash_xor = r.hash_xor AND l.hash_sum = r.hash_sum AS equal
FROM ({" UNION ALL ".join(_fingerprint_sql(t) for t in FINGERPRINT_COLUMNS)}) l
JOIN ({" UNION ALL ".join(_fingerprint_sql(t, "labels_altered" if t == "labels" else None) for t in FINGERPRINT_COLUMNS)}) r
USING (table_name)"""),
    "b20_table_fingerprints": twin(" UNION ALL ".join(_fingerprint_sql(t) for t in FINGERPRINT_COLUMNS)),
}
