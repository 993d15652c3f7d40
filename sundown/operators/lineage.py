"""Identity, lineage closure, consumer classification and graph recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.identity import IDENTITY_PARTS, consumer_id, parse_urn
from sundown.session import cut_bucketed, cut_lineage


def _count_rule(count: Column, none: str, many: str) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(none)).when(count > 1, F.lit(many))


def resolve_identity(specs: DataFrame, catalog: DataFrame, parse=parse_urn) -> DataFrame:
    """Match each spec's six declared parts against the catalog's distinct URNs, case by case."""
    known = (
        catalog.select("urn").distinct().select("urn", parse("urn").alias("_p")).filter("_p IS NOT NULL")
        .groupBy(*[F.col(f"_p.{n}").alias(n) for n in IDENTITY_PARTS])
        .agg(F.count(F.lit(1)).alias("matches"), F.min("urn").alias("urn"))
    )
    return specs.join(known, list(IDENTITY_PARTS), "left").select(
        "spec_id",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("urn")).alias("urn"),
        _count_rule(F.col("matches"), "IDENTITY_NOT_FOUND", "IDENTITY_AMBIGUOUS").alias("refusal_code"),
    )


def resolve_field(specs: DataFrame, fields: DataFrame) -> DataFrame:
    """Match each spec's field in its dataset's schema; two equal schema rows are ambiguous."""
    known = fields.groupBy("urn", "field_path").agg(
        F.count(F.lit(1)).alias("matches"), F.min("native_type").alias("native_type")
    )
    return specs.join(known, ["urn", "field_path"], "left").select(
        "spec_id",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("native_type")).alias("native_type"),
        _count_rule(F.col("matches"), "IDENTITY_FIELD_NOT_FOUND", "IDENTITY_FIELD_AMBIGUOUS").alias("refusal_code"),
    )


def _one_type(*names: str) -> Column:
    """The single case-folded type of all the columns, or null."""
    types = F.array_distinct(F.array(*[F.lower(F.coalesce(F.col(n), F.lit(""))) for n in names]))
    return F.when((F.size(types) == 1) & (types[0] != ""), types[0])


def type_compatibility(level: str) -> Column:
    """Refusal code at one of three levels, or null.

    ``inventory`` refuses only two known and different types; ``strict`` wants the
    catalog pair and the model pair to be one known type; ``drift`` wants the current
    pair to be the type of the receipt's pair.
    """
    target, replacement = F.col("target_type"), F.col("replacement_type")
    if level == "inventory":
        compatible = (
            F.coalesce(target, F.lit("")).isin("") | F.coalesce(replacement, F.lit("")).isin("") | (target == replacement)
        )
    elif level == "strict":
        compatible = _one_type("target_type", "replacement_type") == _one_type("model_target_type", "model_replacement_type")
    elif level == "drift":
        compatible = _one_type("target_type", "replacement_type") == _one_type(
            "receipt_target_type", "receipt_replacement_type"
        )
    else:
        raise ValueError(level)
    return F.when(~F.coalesce(compatible, F.lit(False)), F.lit("SPEC_REPLACEMENT_INCOMPATIBLE"))


def degree_bucket(degree: Column) -> Column:
    return F.when(degree >= 3, F.lit("3+")).otherwise(degree.cast("string"))


def downstream_closure(
    edges: DataFrame, starts: DataFrame, max_hops: int, strict: bool = False, marked: Column | None = None
) -> DataFrame:
    """Every node reachable from each start with its least number of hops, the start left out.

    One join per hop over all starts together. Each hop's new nodes are written to the
    checkpoint folder, so a lost executor repeats one hop, the plan stays short, and a
    small frontier is known to be small. The edges are shuffled once, into buckets by their upper
    end, however many hops follow. One grouping holds a hop's steps against what is reached.
    ``marked`` (over ``edges``) adds a column of that name: is there a way of marked edges alone,
    as a walk over those would find? A node first reached otherwise is walked once more, along
    marked edges only, when such a way turns up; so one walk answers both.
    From 3 hops up the last bucket is open and the walk goes to its end, whatever
    ``max_hops`` is; only ``strict`` stops it there, and then farther nodes are missing.
    """
    steps = cut_bucketed(edges.filter("upstream IS NOT NULL").select(
        "upstream", "downstream", (F.lit(True) if marked is None else F.coalesce(marked, F.lit(False))).alias("_marked")
    ), "upstream")
    frontier = starts.select(
        "start", F.col("start").alias("node"), F.lit(0).alias("degree"), F.lit(True).alias("marked"), F.lit(False).alias("_again")
    ).distinct()
    reached = frontier
    found: DataFrame | None = None
    hop = 0
    endless = max_hops >= 3 and not strict
    while endless or hop < max_hops:
        hop += 1
        walked = (
            frontier.join(steps, frontier["node"] == steps["upstream"])
            .filter(~F.col("_again") | (F.col("_marked") & F.col("downstream").isNotNull()))
            .select("start", F.col("downstream").alias("node"), (F.col("marked") & F.col("_marked")).alias("marked"), F.lit(False).alias("_seen"))
        )
        # A missing node equals none that was reached.
        known = reached.filter("node IS NOT NULL").select("start", "node", "marked", F.lit(True).alias("_seen"))
        following = (
            walked.unionByName(known)
            .groupBy("start", "node")
            .agg(F.max(F.when(~F.col("_seen"), F.col("marked"))).alias("marked"), F.max(F.when(F.col("_seen"), F.col("marked"))).alias("_before"))
            .filter("marked IS NOT NULL AND (_before IS NULL OR (marked AND NOT _before))")
            .select("start", "node", F.lit(hop).alias("degree"), "marked", F.col("_before").isNotNull().alias("_again"))
        )
        last = not endless and hop == max_hops
        frontier = following if last else cut_lineage(following)
        if not last and frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
        reached = reached.unionByName(frontier)
    if found is None:
        found = frontier.filter(F.lit(False))
    if marked is None:
        return found.select("start", "node", "degree", degree_bucket(F.col("degree")).alias("bucket"))
    lost = F.when(F.col("node").isNull(), F.col("degree"))  # such rows have no identity to be merged by
    once = found.groupBy("start", "node", lost.alias("_lost")).agg(F.min("degree").alias("degree"), F.max("marked").alias("marked"))
    return once.select(
        "start", "node", "degree", degree_bucket(F.col("degree")).alias("bucket"), (F.col("marked") & F.col("node").isNotNull()).alias("marked")
    )


def classify_consumers(closure: DataFrame, field_closure: DataFrame | None, start_field: str) -> DataFrame:
    """Consumers with the basis of their dependency; every one starts as OPAQUE.

    Without ``field_closure`` the closure's own ``marked`` tells what a field depends on.
    """
    if field_closure is None:
        based = closure.withColumn("_field", F.when(F.col("marked"), True))
    else:
        by_field = field_closure.select("start", "node").distinct().withColumn("_field", F.lit(True))
        based = closure.join(by_field, ["start", "node"], "left")
    precise = F.col("_field").isNotNull()
    return based.select(
        F.col("start").alias("campaign_id"),
        consumer_id("node").alias("consumer_id"),
        F.col("node").alias("urn"),
        "degree",
        F.concat(F.lit("urn:li:schemaField:("), "start", F.lit(f",{start_field})")).alias("depends_on"),
        F.when(precise, "column_lineage_edge").otherwise("canonical_lineage_edge").alias("basis"),
        F.when(precise, "").otherwise("table-only lineage; field dependency remains unproven").alias("limitation"),
        F.lit("OPAQUE").alias("disposition"),
    )


def consequential_pick(consumers: DataFrame) -> DataFrame:
    """One consumer per campaign: dashboards and charts first, then the smallest URN."""
    later = ~F.coalesce(F.col("entity_type").isin("DASHBOARD", "CHART"), F.lit(False))
    return consumers.groupBy("campaign_id").agg(
        F.min(F.struct(later.alias("later"), F.col("urn"), F.col("entity_type"))).alias("_p")
    ).select("campaign_id", "_p.urn", "_p.entity_type")


def map_manifest_nodes(campaigns: DataFrame, nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """The one model node per campaign whose declared URN is in the inventory."""
    known = inventory.select("campaign_id", F.col("urn").alias("declared_urn"))
    matched = (
        nodes.filter(F.col("resource_type") == "model")
        .join(known, ["campaign_id", "declared_urn"], "left_semi")
        .groupBy("campaign_id")
        .agg(F.count(F.lit(1)).alias("matches"), F.min("unique_id").alias("unique_id"), F.min("declared_urn").alias("urn"))
    )
    one = F.col("matches") == 1
    return campaigns.select("campaign_id").join(matched, "campaign_id", "left").select(
        "campaign_id",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(one, F.col("unique_id")).alias("unique_id"),
        F.when(one, F.col("urn")).alias("urn"),
        _count_rule(F.col("matches"), "IDENTITY_NOT_FOUND", "IDENTITY_AMBIGUOUS").alias("refusal_code"),
    )


def context_rollup(entities: DataFrame, owners: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct owners and query-history size per entity; neither ever closes a consumer."""
    per_owner = owners.select("entity", "owner").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("owners"))
    per_query = queries.groupBy("entity").agg(
        F.sum("total").cast("bigint").alias("queries_total"), F.sum("returned").cast("bigint").alias("queries_returned")
    )
    zero = F.lit(0).cast("bigint")
    return entities.select("entity").join(per_owner, "entity", "left").join(per_query, "entity", "left").select(
        "entity",
        F.coalesce("owners", zero).alias("owners"),
        F.coalesce("queries_total", zero).alias("queries_total"),
        F.coalesce("queries_returned", zero).alias("queries_returned"),
        F.lit("routing_only").alias("owner_authority"),
        F.lit(False).alias("closure_authority"),
    )


def graph_items(edges: DataFrame) -> DataFrame:
    """Nodes, edges and field mappings of tagged edges as ``(kind, item, precise, observed)`` rows, repeats included."""
    entry = lambda kind, item, precise: F.struct(
        F.lit(kind).alias("kind"), item.alias("item"), precise.alias("precise"), F.col("observed").alias("observed"))
    yes = F.lit(True)
    by_field = F.col("precision") == "field"
    mapped = F.concat_ws(">", F.concat_ws("#", "upstream", "up_field"), F.concat_ws("#", "downstream", "down_field"))
    items = F.array(
        entry("node", F.col("upstream"), yes),
        entry("node", F.col("downstream"), yes),
        entry("edge", F.concat_ws(">", "upstream", "downstream"), by_field),
        F.when(by_field, entry("field", mapped, yes)),
    )
    return edges.select(F.explode(items).alias("i")).filter("i IS NOT NULL").select("i.*")


def tagged_differences(edges: DataFrame) -> DataFrame:
    """Every item of two graphs with its state: missing, extra, changed in precision, or the same.

    ``edges`` holds the edges of both, those of the observed one with ``observed``. Each item is
    reduced to two flags, seen and seen precisely, per side, combined before the shuffle: the
    edges are read once, and neither graph is made distinct or joined.
    """
    sides = graph_items(edges).groupBy("kind", "item").agg(
        F.max(F.when(~F.col("observed"), F.col("precise"))).alias("_e"), F.max(F.when(F.col("observed"), F.col("precise"))).alias("_o"))
    state = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(
        F.col("_e") != F.col("_o"), "changed").otherwise("same")
    return sides.select("kind", "item", state.alias("state"))


def graph_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """:func:`tagged_differences` of two graphs that come as tables of their own."""
    return tagged_differences(expected.withColumn("observed", F.lit(False)).unionByName(observed.withColumn("observed", F.lit(True))))


def recall(differences: DataFrame) -> DataFrame:
    """Per kind of item: how much of the expected graph was observed."""
    state = F.col("state")
    return differences.groupBy("kind").agg(
        F.count_if(state != "extra").alias("expected"),
        F.count_if(state != "missing").alias("observed"),
        F.count_if(state == "missing").alias("missing"),
        F.count_if(state == "extra").alias("extra"),
        F.count_if(state == "changed").alias("changed"),
        F.round(F.count_if(state.isin("same", "changed")) / F.count_if(state != "extra"), 8).alias("recall"),
    )


def graph_recall(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return recall(graph_differences(expected, observed))
