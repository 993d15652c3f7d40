"""Identity, lineage and evidence queries over a graph drawn from the warehouse keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.identity import IDENTITY_PARTS, consumer_id, parse_urn
from sundown.functions.ordered import row_numbers
from sundown.operators import evidence as e
from sundown.operators import lineage as g
from sundown.plans.twin import twin, view
from sundown.session import cut_lineage
from sundown.sources.tables import Tables

HOPS = 4
TASK_ROWS = 524_288
PAGE = 3
NOW = "2001-08-01 00:00:00"
YEAR = 31_536_000


# --- catalog ------------------------------------------------------------------------

def _table_name(column: str = "p_name"):
    return F.replace(F.col(column), F.lit(" "), F.lit("_"))


def catalog(t: Tables) -> DataFrame:
    """Dataset names from parts; names repeat, and every thirteenth is malformed."""
    qualified = F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("i.d.s."), _table_name(), F.lit(".x"))).otherwise(
        F.concat(F.lit("i.d.s."), _table_name()))
    return t.part.select(
        F.col("p_partkey").cast("string").alias("spec_id"),
        F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), "p_type", F.lit(","), qualified, F.lit(",PROD)")).alias("urn"),
        F.col("p_brand").alias("field_path"),
        F.when(F.col("p_size") % 5 == 0, "INTEGER").otherwise("TEXT").alias("native_type"),
        F.col("p_partkey"), F.col("p_type"), F.col("p_name"), F.col("p_size"),
    )


view("catalog", """
SELECT CAST(p_partkey AS VARCHAR) AS spec_id, 'urn:li:dataset:(urn:li:dataPlatform:' || p_type || ',i.d.s.' || replace(p_name, ' ', '_')
       || CASE WHEN p_partkey % 13 = 0 THEN '.x' ELSE '' END || ',PROD)' AS urn, p_brand AS field_path,
       CASE WHEN p_size % 5 = 0 THEN 'INTEGER' ELSE 'TEXT' END AS native_type, p_partkey, p_type, p_name, p_size
FROM part
""")


def identity_specs(t: Tables) -> DataFrame:
    """One spec per part: some ask in another case, some for another instance."""
    key = F.col("p_partkey")
    return t.part.select(
        key.cast("string").alias("spec_id"),
        F.col("p_type").alias("platform"),
        F.when(key % 31 == 0, "other").otherwise("i").alias("instance"),
        F.lit("d").alias("database"),
        F.lit("s").alias("schema"),
        F.when(key % 29 == 0, F.upper(_table_name())).otherwise(_table_name()).alias("table"),
        F.lit("PROD").alias("environment"),
    )


def field_specs(t: Tables) -> DataFrame:
    return catalog(t).select(
        "spec_id", "urn", F.when(F.col("p_partkey") % 31 == 0, "absent").otherwise(F.col("field_path")).alias("field_path"))


def typed_pairs(t: Tables) -> DataFrame:
    """Types of the two fields in the catalog, in the model and in the receipt."""
    key, kind = F.col("p_partkey"), F.when(F.col("p_size") % 5 == 0, "INTEGER").otherwise("TEXT")
    return t.part.select(
        key.cast("string").alias("spec_id"),
        kind.alias("target_type"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lower(kind)).when(key % 13 == 0, "DATE").otherwise(kind)
        .alias("replacement_type"),
        F.lower(kind).alias("model_target_type"),
        F.when(key % 17 == 0, "").otherwise(F.lower(kind)).alias("model_replacement_type"),
        F.when(key % 19 == 0, "DATE").otherwise(kind).alias("receipt_target_type"),
        F.when(key % 19 == 0, "DATE").otherwise(kind).alias("receipt_replacement_type"),
    )


view("typed_pairs", """
SELECT CAST(p_partkey AS VARCHAR) AS spec_id, kind AS t, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN lower(kind)
       WHEN p_partkey % 13 = 0 THEN 'DATE' ELSE kind END AS r, lower(kind) AS mt,
       CASE WHEN p_partkey % 17 = 0 THEN '' ELSE lower(kind) END AS mr,
       CASE WHEN p_partkey % 19 = 0 THEN 'DATE' ELSE kind END AS c
FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'INTEGER' ELSE 'TEXT' END AS kind FROM part)
""")


# --- lineage graph ------------------------------------------------------------------

def _node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _pairs(t: Tables, *columns: str) -> DataFrame:
    """Distinct rows of lineitem columns, dealt to tasks of about ``TASK_ROWS``: what follows makes many long rows of a short one."""
    tasks = 1 + t.lineitem.count() // TASK_ROWS
    return t.lineitem.select(*columns).repartition(tasks, *columns).distinct()


def edges(t: Tables) -> DataFrame:
    """Region, nation, customer, order, part; and nation, supplier, part as the shorter way."""

    def step(df: DataFrame, up, down, precise) -> DataFrame:
        return df.select(
            up.alias("upstream"), down.alias("downstream"),
            F.when(precise, "field").otherwise("table").alias("precision"),
            F.when(precise, "key").alias("up_field"), F.when(precise, "ref").alias("down_field"))

    yes = F.lit(True)
    parts = (
        step(t.nation, _node("region", "n_regionkey"), _node("nation", "n_nationkey"), yes),
        step(t.customer, _node("nation", "c_nationkey"), _node("customer", "c_custkey"), F.col("c_custkey") % 4 != 0),
        step(t.orders, _node("customer", "o_custkey"), _node("order", "o_orderkey"), F.col("o_orderkey") % 3 != 0),
        step(_pairs(t, "l_orderkey", "l_partkey"), _node("order", "l_orderkey"), _node("part", "l_partkey"),
             F.col("l_partkey") % 5 != 0),
        step(t.supplier, _node("nation", "s_nationkey"), _node("supplier", "s_suppkey"), yes),
        step(_pairs(t, "l_suppkey", "l_partkey"), _node("supplier", "l_suppkey"), _node("part", "l_partkey"),
             F.col("l_partkey") % 2 == 0),
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


view("edges", """
SELECT upstream, downstream, CASE WHEN precise THEN 'field' ELSE 'table' END AS precision, CASE WHEN precise THEN 'key' END AS up_field,
       CASE WHEN precise THEN 'ref' END AS down_field FROM (
  SELECT 'region:' || n_regionkey AS upstream, 'nation:' || n_nationkey AS downstream, true AS precise FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey % 4 <> 0 FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey % 3 <> 0 FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, l_partkey % 5 <> 0 FROM lineitem
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, true FROM supplier
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, l_partkey % 2 = 0 FROM lineitem)
""")


def starts(t: Tables) -> DataFrame:
    return t.region.select(_node("region", "r_regionkey").alias("start"))


def _walk(name: str, condition: str = "true") -> str:
    return f"""
SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS node, 0 AS degree FROM region
UNION SELECT w.start, e.downstream, w.degree + 1 FROM {name} w JOIN edges e ON e.upstream = w.node AND {condition}
WHERE w.degree < {HOPS}
"""


view("walk_all", _walk("walk_all"))
view("walk_field", _walk("walk_field", "e.precision = 'field'"))
view("closure", """
SELECT start, node, degree, CASE WHEN degree >= 3 THEN '3+' ELSE CAST(degree AS VARCHAR) END AS bucket
FROM (SELECT start, node, min(degree) AS degree FROM walk_all GROUP BY 1, 2) WHERE degree > 0
""")


def closure(t: Tables) -> DataFrame:
    return g.downstream_closure(edges(t), starts(t), HOPS)


def classified(t: Tables) -> DataFrame:
    closed = g.downstream_closure(edges(t), starts(t), HOPS, marked=F.col("precision") == "field")
    return g.classify_consumers(closed, None, "key")


view("classified", """
SELECT c.start AS campaign_id, 'dh-' || substr(sha256(c.node), 1, 20) AS consumer_id, c.node AS urn, c.degree,
       'urn:li:schemaField:(' || c.start || ',key)' AS depends_on,
       CASE WHEN f.node IS NOT NULL THEN 'column_lineage_edge' ELSE 'canonical_lineage_edge' END AS basis,
       CASE WHEN f.node IS NOT NULL THEN '' ELSE 'table-only lineage; field dependency remains unproven' END AS limitation,
       'OPAQUE' AS disposition
FROM closure c LEFT JOIN (SELECT DISTINCT start, node FROM walk_field WHERE degree > 0) f USING (start, node)
""")


def typed_consumers(t: Tables) -> DataFrame:
    """Orders of each customer as consumers of three entity types."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("DATASET", "DASHBOARD", "DATASET", "CHART", "DATASET")]),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select(F.col("o_custkey").alias("campaign_id"), _node("order", "o_orderkey").alias("urn"), kind.alias("entity_type"))


def manifest_nodes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as campaigns; their parts as manifest nodes, one in 97 under its catalog name, the others under an old one."""
    named = catalog(t).select("p_partkey", "urn")
    supplied = _pairs(t, "l_suppkey", "l_partkey")
    nodes = supplied.join(named, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("campaign_id"),
        F.concat(F.lit("model.x.p"), "l_partkey").alias("unique_id"),
        F.when(F.col("l_partkey") % 3 == 0, "model").otherwise("test").alias("resource_type"),
        F.when((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 97 == 0, F.col("urn")).otherwise(F.concat("urn", F.lit("-old"))).alias("declared_urn"),
    )
    inventory = supplied.join(named, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("campaign_id"), "urn")
    return t.supplier.select(F.col("s_suppkey").alias("campaign_id")), nodes, inventory


def tagged_edges(t: Tables) -> DataFrame:
    """The graph and a partial observation of it, from one pass: some edges lost, some precision lost, some edges invented."""
    number = F.regexp_extract("downstream", r"(\d+)$", 1).cast("bigint")

    def entry(observed: bool, downstream: Column, precision: Column) -> Column:
        return F.struct(
            "upstream", downstream.alias("downstream"), precision.alias("precision"), "up_field", "down_field", F.lit(observed).alias("observed"))

    same, level = F.col("downstream"), F.col("precision")
    rows = F.array(
        entry(False, same, level),
        F.when(F.col("_n") % 19 != 0, entry(True, same, F.when(F.col("_n") % 23 == 0, "table").otherwise(level))),
        F.when(F.col("_n") % 41 == 0, entry(True, F.concat(F.lit("ghost:"), "_n"), level)),
    )
    return edges(t).withColumn("_n", number).select(F.explode(rows).alias("e")).filter("e IS NOT NULL").select("e.*")


view("observed_edges", """
SELECT upstream, downstream, CASE WHEN n % 23 = 0 THEN 'table' ELSE precision END AS precision, up_field, down_field
FROM (SELECT *, CAST(regexp_extract(downstream, '(\\d+)$', 1) AS BIGINT) AS n FROM edges) WHERE n % 19 <> 0
UNION ALL
SELECT upstream, 'ghost:' || n, precision, up_field, down_field
FROM (SELECT *, CAST(regexp_extract(downstream, '(\\d+)$', 1) AS BIGINT) AS n FROM edges) WHERE n % 41 = 0
""")


def _items_view(source: str) -> str:
    return f"""
SELECT 'node' AS kind, upstream AS item, '' AS detail FROM {source} UNION SELECT 'node', downstream, '' FROM {source}
UNION SELECT 'edge', upstream || '>' || downstream, min(precision) FROM {source} GROUP BY 2
UNION SELECT 'field', upstream || '#' || up_field || '>' || downstream || '#' || down_field, '' FROM {source} WHERE precision = 'field'
"""


view("expected_items", _items_view("edges"))
view("observed_items", _items_view("observed_edges"))
view("graph_states", """
SELECT coalesce(x.kind, o.kind) AS kind, coalesce(x.item, o.item) AS item,
       CASE WHEN o.kind IS NULL THEN 'missing' WHEN x.kind IS NULL THEN 'extra' WHEN x.detail <> o.detail THEN 'changed' ELSE 'same' END AS state
FROM expected_items x FULL JOIN observed_items o ON x.kind = o.kind AND x.item = o.item
""")


# --- paged inventory ----------------------------------------------------------------

def page_results(t: Tables) -> DataFrame:
    """Orders of each customer listed in three buckets, numbered in order of their key."""
    listed = t.orders.select(
        F.col("o_custkey").alias("campaign_id"),
        F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("3+")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("bucket"),
        "o_orderkey",
    )
    numbered = row_numbers(listed, ["campaign_id", "bucket"], F.floor(F.col("o_orderkey") / 65_536), ["o_orderkey"])
    fault = (F.col("campaign_id") + F.length("bucket")) % 7
    offset = (F.floor((F.col("position") - 1) / PAGE) * PAGE).cast("bigint")
    urn = (
        F.when((fault == 1) & (F.col("position") % 4 == 0), F.lit(None))
        .when((fault == 2) & (F.col("position") == 2), F.lit("urn:repeated"))
        .when((fault == 2) & (F.col("position") == 1), F.lit("urn:repeated"))
        .otherwise(_node("order", "o_orderkey"))
    )
    return numbered.select("campaign_id", "bucket", offset.alias("offset"), urn.alias("urn"))


def pages(t: Tables) -> DataFrame:
    """The pages those results came in, with one fault per (campaign, bucket) in most cases."""
    listed = page_results(t).groupBy("campaign_id", "bucket", "offset").agg(F.count(F.lit(1)).alias("returned"))
    totals = page_results(t).groupBy("campaign_id", "bucket").agg(F.count(F.lit(1)).alias("size"))
    fault = (F.col("campaign_id") + F.length("bucket")) % 7
    return listed.join(totals, ["campaign_id", "bucket"]).select(
        "campaign_id", "bucket", "offset",
        F.when((fault == 3) & (F.col("offset") > 0), F.col("size") + 1).otherwise(F.col("size")).alias("total"),
        "returned",
        F.when(fault == 6, F.lit(None)).otherwise(fault == 4).alias("is_partial"),
        F.when(fault == 6, F.lit(None)).otherwise(fault == 5).alias("cached"),
        ((F.col("campaign_id") % 13 == 0) & (F.col("offset") == PAGE)).alias("failed"),
    )


view("page_results", f"""
SELECT campaign_id, bucket, CAST((rn - 1) // {PAGE} * {PAGE} AS BIGINT) AS "offset", (campaign_id + length(bucket)) % 7 AS fault,
       CASE WHEN (campaign_id + length(bucket)) % 7 = 1 AND rn % 4 = 0 THEN NULL
            WHEN (campaign_id + length(bucket)) % 7 = 2 AND rn <= 2 THEN 'urn:repeated' ELSE 'order:' || o_orderkey END AS urn
FROM (SELECT o_custkey AS campaign_id, ['1', '2', '3+'][o_orderkey % 3 + 1] AS bucket, o_orderkey,
             row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS rn FROM orders)
""")
view("pages_landed", f"""
SELECT campaign_id, bucket, "offset", fault, count(*) AS returned,
       CASE WHEN fault = 3 AND "offset" > 0 THEN size + 1 ELSE size END AS total,
       campaign_id % 13 = 0 AND "offset" = {PAGE} AS failed
FROM page_results JOIN (SELECT campaign_id, bucket, count(*) AS size FROM page_results GROUP BY 1, 2) USING (campaign_id, bucket)
GROUP BY campaign_id, bucket, "offset", fault, size
""")
view("bucket_firsts", """
SELECT campaign_id, bucket, fault, coalesce(arg_min(total, "offset") FILTER (WHERE NOT failed), 0) AS first_total,
       count(DISTINCT total) FILTER (WHERE NOT failed) > 1 AS changed, bool_or(failed) AS failed, count(*) FILTER (WHERE NOT failed) AS pages
FROM pages_landed GROUP BY 1, 2, 3
""")
view("page_audit", """
SELECT c.c_custkey AS campaign_id, coalesce(b.pages, 0) AS pages, coalesce(b.reported, 0) AS reported_total, coalesce(u.n, 0) AS returned_total,
  [x.name for x in [
    {'hit': coalesce(b.cache_hidden, false), 'name': 'CACHE_NOT_EXPOSED'}, {'hit': coalesce(b.cache_used, false), 'name': 'CACHE_USED'},
    {'hit': coalesce(u.again, false), 'name': 'CONSUMER_REPEATED'}, {'hit': coalesce(b.partial, false), 'name': 'MARKED_PARTIAL'},
    {'hit': coalesce(b.failed, true), 'name': 'PAGE_FAILED'}, {'hit': coalesce(b.cache_hidden, false), 'name': 'PARTIAL_NOT_EXPOSED'},
    {'hit': coalesce(b.changed, false), 'name': 'TOTAL_CHANGED'}, {'hit': coalesce(u.n, 0) <> coalesce(b.reported, 0), 'name': 'TOTAL_NOT_REACHED'}
  ] if x.hit] AS names
FROM customer c
LEFT JOIN (SELECT campaign_id, CAST(sum(first_total) AS BIGINT) AS reported, CAST(sum(pages) AS BIGINT) AS pages, bool_or(changed) AS changed,
                  bool_or(failed) AS failed, bool_or(fault = 6 AND pages > 0) AS cache_hidden, bool_or(fault = 5 AND pages > 0) AS cache_used,
                  bool_or(fault = 4 AND pages > 0) AS partial FROM bucket_firsts GROUP BY 1) b ON b.campaign_id = c.c_custkey
LEFT JOIN (SELECT campaign_id, count(DISTINCT urn) AS n, count(urn) > count(DISTINCT urn) AS again FROM page_results GROUP BY 1) u
  ON u.campaign_id = c.c_custkey
""")
view("page_audit_text", """
SELECT campaign_id, pages, reported_total, returned_total, array_to_string(names, ',') AS limitations,
       CASE WHEN len(list_filter(names, lambda n: n NOT IN ('CACHE_NOT_EXPOSED', 'PARTIAL_NOT_EXPOSED'))) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status
FROM page_audit
""")


def campaign_ids(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("campaign_id"))


def audit(t: Tables) -> DataFrame:
    return e.page_audit(campaign_ids(t), pages(t), page_results(t))


def _joined(column: str = "limitations"):
    return F.concat_ws(",", column).alias(column)


# --- sources ------------------------------------------------------------------------

def last_orders(t: Tables) -> DataFrame:
    """Update time of each campaign: its newest order date, hidden for multiples of 11."""
    return t.orders.groupBy(F.col("o_custkey").alias("campaign_id")).agg(F.max("o_orderdate").cast("timestamp").alias("_at")).select(
        "campaign_id", F.when(F.col("campaign_id") % 11 != 0, F.col("_at")).alias("source_updated_at"))


view("last_orders", """
SELECT o_custkey AS campaign_id, CASE WHEN o_custkey % 11 <> 0 THEN max(o_orderdate) END AS updated FROM orders GROUP BY 1
""")


def source_meta(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    meta = t.customer.select(
        key.alias("campaign_id"),
        F.lit("catalog").alias("source_id"),
        (key % 5 != 0).alias("required"),
        F.concat(F.lit("catalog-"), "c_nationkey").alias("identity"),
        F.lit(HOPS).alias("max_hops"),
        F.array(F.col("c_mktsegment")).alias("filters"),
        F.lit(YEAR).alias("maximum_age_seconds"),
        F.concat(F.lit("reader-"), "c_nationkey").alias("principal"),
    )
    return meta.join(last_orders(t), "campaign_id", "left")


def envelope(t: Tables) -> DataFrame:
    return e.build_envelope(audit(t), source_meta(t), F.to_timestamp(F.lit(NOW)))


view("envelope_rows", f"""
SELECT a.campaign_id, 'catalog' AS source_id, a.campaign_id % 5 <> 0 AS required, 'catalog-' || c.c_nationkey AS identity,
       a.pages, a.reported_total, a.returned_total, c.c_mktsegment AS filters, 'reader-' || c.c_nationkey AS principal,
       CASE WHEN TIMESTAMP '{NOW}' - o.updated > INTERVAL {YEAR} SECOND THEN 'STALE' ELSE a.status END AS status,
       array_to_string(list_sort(string_split(a.limitations, ',')
         || CASE WHEN o.updated IS NULL THEN ['UPDATE_TIME_NOT_EXPOSED'] ELSE [] END
         || CASE WHEN TIMESTAMP '{NOW}' - o.updated > INTERVAL {YEAR} SECOND THEN ['UPDATE_TIME_TOO_OLD'] ELSE [] END), ',') AS limitations
FROM page_audit_text a JOIN customer c ON c.c_custkey = a.campaign_id LEFT JOIN last_orders o ON o.campaign_id = a.campaign_id
""")


def captured_sources(t: Tables, second: bool) -> DataFrame:
    """First capture: catalog and repository of every campaign; second: a newer repository for every third, and new wikis."""
    key = F.col("c_custkey")
    if second:
        rows = t.customer.select(
            key.alias("campaign_id"),
            F.explode(F.array_compact(F.array(F.when(key % 3 == 0, F.lit("repository")), F.when(key % 10 == 0, F.lit("wiki"))))).alias("source_id"),
            F.lit(True).alias("required"), F.lit("COMPLETE").alias("status"), F.lit("2001-08-01").alias("captured_at"))
    else:
        rows = t.customer.select(
            key.alias("campaign_id"), F.explode(F.array(F.lit("catalog"), F.lit("repository"))).alias("source_id"),
            (key % 4 != 0).alias("required"),
            F.when(F.col("c_nationkey") % 5 == 2, "PARTIAL").otherwise("COMPLETE").alias("status"),
            F.lit("2001-07-01").alias("captured_at"))
    return rows


view("captured_first", """
SELECT c_custkey AS campaign_id, s AS source_id, c_custkey % 4 <> 0 AS required,
       CASE WHEN c_nationkey % 5 = 2 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, '2001-07-01' AS captured_at
FROM customer, (VALUES ('catalog'), ('repository')) v(s)
""")
view("captured_second", """
SELECT c_custkey AS campaign_id, 'repository' AS source_id, true AS required, 'COMPLETE' AS status, '2001-08-01' AS captured_at
FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'wiki', true, 'COMPLETE', '2001-08-01' FROM customer WHERE c_custkey % 10 = 0
""")
view("merged_sources", """
SELECT * FROM captured_second UNION ALL SELECT f.* FROM captured_first f
WHERE NOT EXISTS (SELECT 1 FROM captured_second s WHERE s.campaign_id = f.campaign_id AND s.source_id = f.source_id)
""")


def merged(t: Tables) -> DataFrame:
    return e.merge_sources(captured_sources(t, False), captured_sources(t, True))


_Q = lambda build: (lambda spark, folder: build(Tables(spark, folder)))

QUERIES = {
    "c1_parse_urn": _Q(lambda t: catalog(t).select("spec_id", parse_urn("urn").alias("p")).select(
        "spec_id", *[F.coalesce(F.col(f"p.{n}"), F.lit("")).alias(n) for n in IDENTITY_PARTS])),
    "c2_resolve_identity": _Q(lambda t: g.resolve_identity(identity_specs(t), catalog(t))),
    "c3_resolve_field": _Q(lambda t: g.resolve_field(field_specs(t), catalog(t).select("urn", "field_path", "native_type"))),
    "c4_type_compatibility": _Q(lambda t: typed_pairs(t).select(
        "spec_id", *[g.type_compatibility(level).alias(level) for level in ("inventory", "strict", "drift")])),
    "c5_downstream_closure": _Q(closure),
    "c6_classify_consumers": _Q(classified),
    "c7_page_audit": _Q(lambda t: audit(t).withColumn("limitations", F.concat_ws(",", "limitations"))),
    "c8_source_freshness": _Q(lambda t: e.source_freshness(
        source_meta(t).select("campaign_id", F.lit("PARTIAL").alias("status"), "source_updated_at", "maximum_age_seconds",
                              F.array(F.lit("CACHE_USED")).alias("limitations")), F.to_timestamp(F.lit(NOW))).select(
        "campaign_id", "status", _joined())),
    "c9_build_envelope": _Q(lambda t: envelope(t).select(
        "campaign_id", "source_id", "required", "status", "identity", "scope.pages", "scope.reported_total", "scope.returned_total",
        F.concat_ws(",", "scope.filters").alias("filters"), "principal", _joined())),
    "c10_merge_sources": _Q(merged),
    "c10_envelope_header": _Q(lambda t: e.envelope_header(merged(t))),
    "c11_consumer_id": _Q(lambda t: t.lineitem.select(_node("part", "l_partkey").alias("urn")).distinct().select(
        "urn", consumer_id("urn").alias("consumer_id"))),
    "c12_consequential_pick": _Q(lambda t: g.consequential_pick(typed_consumers(t))),
    "c15_map_manifest_nodes": _Q(lambda t: g.map_manifest_nodes(*manifest_nodes(t))),
    "c17_context_rollup": _Q(lambda t: g.context_rollup(
        t.part.select(F.col("p_partkey").alias("entity")),
        t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("owner")),
        t.lineitem.groupBy(F.col("l_partkey").alias("entity"), "l_orderkey").agg(F.count(F.lit(1)).alias("total"))
        .select("entity", "total", F.lit(1).alias("returned")))),
    "c18_graph_recall": _Q(lambda t: g.recall(g.tagged_differences(tagged_edges(t)))),
    "c18_graph_differences": _Q(lambda t: g.tagged_differences(tagged_edges(t)).filter("state <> 'same'")),
}

_PARTS_SQL = """
SELECT spec_id, urn, split_part(split_part(urn, 'dataPlatform:', 2), ',', 1) AS platform, p_partkey % 13 = 0 AS bad,
       replace(p_name, ' ', '_') AS tbl, p_partkey, p_type FROM catalog
"""

ORACLES = {
    "c1_parse_urn": twin("""
SELECT spec_id, CASE WHEN bad THEN '' ELSE platform END AS platform, CASE WHEN bad THEN '' ELSE 'i' END AS instance,
       CASE WHEN bad THEN '' ELSE 'd' END AS database, CASE WHEN bad THEN '' ELSE 's' END AS schema,
       CASE WHEN bad THEN '' ELSE tbl END AS "table", CASE WHEN bad THEN '' ELSE 'PROD' END AS environment FROM urn_parts""",
                         urn_parts=_PARTS_SQL),
    "c2_resolve_identity": twin("""
SELECT s.spec_id, count(DISTINCT k.urn) AS matches, CASE WHEN count(DISTINCT k.urn) = 1 THEN min(k.urn) END AS urn,
       CASE count(DISTINCT k.urn) WHEN 0 THEN 'IDENTITY_NOT_FOUND' WHEN 1 THEN NULL ELSE 'IDENTITY_AMBIGUOUS' END AS refusal_code
FROM urn_parts s LEFT JOIN urn_parts k ON NOT k.bad AND k.platform = s.p_type AND s.p_partkey % 31 <> 0
  AND k.tbl = CASE WHEN s.p_partkey % 29 = 0 THEN upper(s.tbl) ELSE s.tbl END
GROUP BY s.spec_id""", urn_parts=_PARTS_SQL),
    "c3_resolve_field": twin("""
SELECT s.spec_id, count(f.urn) AS matches, CASE WHEN count(f.urn) = 1 THEN min(f.native_type) END AS native_type,
       CASE count(f.urn) WHEN 0 THEN 'IDENTITY_FIELD_NOT_FOUND' WHEN 1 THEN NULL ELSE 'IDENTITY_FIELD_AMBIGUOUS' END AS refusal_code
FROM catalog s LEFT JOIN catalog f ON f.urn = s.urn AND f.field_path = CASE WHEN s.p_partkey % 31 = 0 THEN 'absent' ELSE s.field_path END
GROUP BY s.spec_id"""),
    "c4_type_compatibility": twin("""
SELECT spec_id, CASE WHEN r IS NOT NULL AND r <> '' AND t <> r THEN 'SPEC_REPLACEMENT_INCOMPATIBLE' END AS inventory,
       CASE WHEN coalesce(lower(t) = lower(r) AND mt = mr AND mr <> '' AND lower(t) = lower(mt), false) THEN NULL
            ELSE 'SPEC_REPLACEMENT_INCOMPATIBLE' END AS strict,
       CASE WHEN coalesce(lower(t) = lower(r) AND lower(t) = lower(c), false) THEN NULL ELSE 'SPEC_REPLACEMENT_INCOMPATIBLE' END AS drift
FROM typed_pairs"""),
    "c5_downstream_closure": twin("SELECT * FROM closure"),
    "c6_classify_consumers": twin("SELECT * FROM classified"),
    "c7_page_audit": twin("SELECT * FROM page_audit_text"),
    "c8_source_freshness": twin(f"""
SELECT c_custkey AS campaign_id, CASE WHEN TIMESTAMP '{NOW}' - updated > INTERVAL {YEAR} SECOND THEN 'STALE' ELSE 'PARTIAL' END AS status,
       'CACHE_USED' || CASE WHEN updated IS NULL THEN ',UPDATE_TIME_NOT_EXPOSED'
         WHEN TIMESTAMP '{NOW}' - updated > INTERVAL {YEAR} SECOND THEN ',UPDATE_TIME_TOO_OLD' ELSE '' END AS limitations
FROM customer LEFT JOIN last_orders ON campaign_id = c_custkey"""),
    "c9_build_envelope": twin("""
SELECT campaign_id, source_id, required, status, identity, pages, reported_total, returned_total, filters, principal,
       ltrim(limitations, ',') AS limitations FROM envelope_rows"""),
    "c10_merge_sources": twin("SELECT * FROM merged_sources"),
    "c10_envelope_header": twin("""
SELECT campaign_id, max(captured_at) AS captured_at, count(*) AS sources,
       count(*) FILTER (WHERE required AND status <> 'COMPLETE') AS incomplete_sources FROM merged_sources GROUP BY 1"""),
    "c11_consumer_id": """
SELECT urn, 'dh-' || substr(sha256(urn), 1, 20) AS consumer_id FROM (SELECT DISTINCT 'part:' || l_partkey AS urn FROM lineitem)""",
    "c12_consequential_pick": """
SELECT campaign_id, urn, entity_type FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY CASE WHEN entity_type = 'DATASET' THEN 1 ELSE 0 END, urn) AS rn FROM (
    SELECT o_custkey AS campaign_id, 'order:' || o_orderkey AS urn,
           ['DATASET', 'DASHBOARD', 'DATASET', 'CHART', 'DATASET'][o_orderkey % 5 + 1] AS entity_type FROM orders))
WHERE rn = 1""",
    "c15_map_manifest_nodes": twin("""
SELECT s_suppkey AS campaign_id, count(n.urn) AS matches, CASE WHEN count(n.urn) = 1 THEN min('model.x.p' || n.l_partkey) END AS unique_id,
       CASE WHEN count(n.urn) = 1 THEN min(n.urn) END AS urn,
       CASE count(n.urn) WHEN 0 THEN 'IDENTITY_NOT_FOUND' WHEN 1 THEN NULL ELSE 'IDENTITY_AMBIGUOUS' END AS refusal_code
FROM supplier LEFT JOIN (SELECT * FROM declared d WHERE l_partkey % 3 = 0 AND EXISTS (
  SELECT 1 FROM declared i WHERE i.l_suppkey = d.l_suppkey AND i.urn = d.urn AND (d.l_suppkey * 7 + d.l_partkey) % 97 = 0)) n
  ON n.l_suppkey = s_suppkey
GROUP BY s_suppkey""", declared="""
SELECT DISTINCT l_suppkey, l_partkey, urn FROM lineitem JOIN catalog ON p_partkey = l_partkey"""),
    "c17_context_rollup": """
SELECT p_partkey AS entity, count(DISTINCT l_suppkey) AS owners, count(l_orderkey) AS queries_total, count(DISTINCT l_orderkey) AS queries_returned,
       'routing_only' AS owner_authority, false AS closure_authority FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""",
    "c18_graph_recall": twin("""
SELECT kind, count(*) FILTER (WHERE state <> 'extra') AS expected, count(*) FILTER (WHERE state <> 'missing') AS observed,
       count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'extra') AS extra,
       count(*) FILTER (WHERE state = 'changed') AS changed,
       round(count(*) FILTER (WHERE state IN ('same', 'changed')) / count(*) FILTER (WHERE state <> 'extra'), 8) AS recall
FROM graph_states GROUP BY kind"""),
    "c18_graph_differences": twin("SELECT * FROM graph_states WHERE state <> 'same'"),
}
