"""Scans over whole file texts: references, renames, redaction, forbidden content, file integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundown.functions.checks import differs, first_code
from sundown.functions.hashing import digest
from sundown.functions.text import (
    REDACTED,
    SELECT_STAR,
    alias_pattern,
    forbidden_labels,
    public_text,
    redact_emails,
    token_pattern,
)
from sundown.vocabulary import (
    REFERENCE_SKIPPED_FOLDERS,
    SCAN_SUFFIXES,
    SCOPE_SKIPPED_FOLDERS,
)


def in_scanned_folder(path: Column, skipped: Sequence[str]) -> Column:
    """Whether none of the folders above the file is one the scan skips."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(f) for f in skipped]))


def scope_counterfactual(
    files: DataFrame, token: str, file_bound: int | None = None, byte_bound: int | None = None
) -> DataFrame:
    """Per repository: inspected files, files naming the token, and whether the scan stayed in its bounds.

    Every file is searched, whatever its size. There is no bound unless the caller sets one;
    passing it marks the repository incomplete.
    """
    too_long = F.lit(False) if byte_bound is None else F.octet_length("text") > byte_bound
    too_many = F.lit(False) if file_bound is None else F.col("inspected_files") > file_bound
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (
        files.filter(suffix.isin(*SCAN_SUFFIXES) & in_scanned_folder(F.col("path"), SCOPE_SKIPPED_FOLDERS))
        .groupBy("repository_id")
        .agg(
            F.count(F.lit(1)).alias("inspected_files"),
            F.count_if(F.col("text").rlike(token_pattern(token))).alias("matched_files"),
            F.count_if(too_long).alias("oversized_files"),
        )
        .withColumn("complete", ~too_many & (F.col("oversized_files") == 0))
    )


def scope_detail(
    files: DataFrame, repositories: DataFrame, token: str, file_bound: int | None = None, byte_bound: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The scan of every configured repository, and the files that name the token.

    ``repositories``: repository_id, required. The first frame has one row for each, with whether it
    is required, what was inspected, and its sorted limitations; a repository without files was
    inspected in vain. The second has a row per matched path, as there may be any number of them.
    """
    scanned = scope_counterfactual(files, token, file_bound, byte_bound)
    zero = F.lit(0).cast("bigint")
    limits = F.array_sort(F.array_compact(F.array(
        F.when(F.col("inspected_files").isNull(), F.lit("Repository holds no scanned file")),
        F.when(F.lit(file_bound is not None) & (F.col("inspected_files") > F.lit(file_bound or 0)), F.lit("Repository scan exceeded its bound on files")),
        F.when(F.col("oversized_files") > 0, F.lit("Repository file exceeded its bound on bytes")))))
    detail = repositories.select("repository_id", "required").join(scanned, "repository_id", "left").select(
        "repository_id", "required", F.coalesce("inspected_files", zero).alias("inspected_files"), F.coalesce("matched_files", zero).alias("matched_files"),
        F.coalesce("complete", F.lit(False)).alias("complete"), limits.alias("limitations"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    matched = files.filter(
        suffix.isin(*SCAN_SUFFIXES) & in_scanned_folder(F.col("path"), SCOPE_SKIPPED_FOLDERS) & F.col("text").rlike(token_pattern(token))
    ).join(repositories.select("repository_id"), "repository_id", "left_semi").select("repository_id", "path")
    return detail, matched


def counterfactual_summary(scan: DataFrame, consumers: DataFrame) -> DataFrame:
    """How many consumers the graph shows beyond all repositories; null while the scan is incomplete."""
    zero = F.lit(0).cast("bigint")
    observed = consumers.agg(F.count(F.lit(1)).alias("graph_consumers")).select(
        "graph_consumers", zero.alias("repository_matches"), F.lit(True).alias("complete")
    )
    totals = scan.agg(
        F.coalesce(F.sum("matched_files"), zero).cast("bigint").alias("repository_matches"),
        F.coalesce(F.min("complete"), F.lit(False)).alias("complete"),
    ).select(zero.alias("graph_consumers"), "repository_matches", "complete")
    extra = F.greatest(F.lit(0), F.col("graph_consumers") - F.col("repository_matches"))
    return observed.unionByName(totals).agg(
        F.sum("graph_consumers").alias("graph_consumers"),
        F.sum("repository_matches").alias("repository_matches"),
        F.min("complete").alias("complete"),
    ).select(
        "graph_consumers",
        "repository_matches",
        "complete",
        F.when(F.col("complete"), extra).alias("minimum_additional"),
        (F.col("complete") & (extra > 0)).alias("graph_expands_inventory"),
    )


def reference_scan(files: DataFrame, token: str) -> DataFrame:
    """Files naming the token, classified, and files selecting every column."""
    text = F.col("text")
    named = text.rlike(token_pattern(token))
    in_macros = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == "macros"
    classification = (
        F.when(~named, F.lit(None))
        .when((F.instr(text, "{{") > 0) & in_macros, "macro_or_generated")
        .when(text.rlike(alias_pattern(token)), "aliased_direct")
        .otherwise("direct")
    )
    return files.filter(in_scanned_folder(F.col("path"), REFERENCE_SKIPPED_FOLDERS)).select(
        "path", classification.alias("classification"), text.rlike(SELECT_STAR).alias("selects_all")
    ).filter("classification IS NOT NULL OR selects_all")


# Fixed value: the kinds of dbt node a reference can hide in.
DBT_KINDS = ("model", "seed", "test")
_NODE = "resource_type string, original_file_path string, compiled_code string, depends_on struct<nodes:array<string>>"


def dbt_nodes(manifests: DataFrame) -> DataFrame:
    """The nodes of dbt manifests (repository_id, raw) as rows; entries that are no objects are left out.

    repository_id, unique_id, resource_type, original_file_path, compiled_code, depends_on (sorted).
    """
    entries = F.from_json(F.get_json_object("raw", "$.nodes"), "map<string,string>")
    node = manifests.select("repository_id", F.explode(entries).alias("unique_id", "_raw")).filter(F.col("_raw").startswith("{")).select(
        "repository_id", "unique_id", F.from_json("_raw", _NODE).alias("n"))
    return node.filter(F.col("n.resource_type").isin(*DBT_KINDS)).select(
        "repository_id", "unique_id", "n.resource_type", "n.original_file_path", "n.compiled_code",
        F.array_sort(F.coalesce("n.depends_on.nodes", F.array().cast("array<string>"))).alias("depends_on"))


def dbt_dependencies(nodes: DataFrame) -> DataFrame:
    """The graph of the nodes, an edge from each node to every one that depends on it."""
    return nodes.select("repository_id", F.explode(F.array_distinct("depends_on")).alias("upstream"), F.col("unique_id").alias("downstream"))


def manifest_scan(manifests: DataFrame, files: DataFrame, token: str) -> DataFrame:
    """Where a repository's nodes name the token: in compiled code, in their file (then with its fingerprint), or in what they depend on.

    ``files``: repository_id, path, text. A manifest without nodes is one row with a refusal.
    """
    nodes = dbt_nodes(manifests)
    compiled = nodes.withColumn("compiled_contains_target", F.coalesce(F.col("compiled_code").rlike(token_pattern(token)), F.lit(False)))
    named = files.filter(F.col("text").rlike(token_pattern(token)) & in_scanned_folder(F.col("path"), REFERENCE_SKIPPED_FOLDERS)).select(
        "repository_id", F.col("path").alias("original_file_path"), digest("text").alias("fingerprint"))
    joined = compiled.join(named, ["repository_id", "original_file_path"], "left")
    hit = joined.filter("compiled_contains_target OR fingerprint IS NOT NULL").select("repository_id", F.col("unique_id").alias("upstream"))
    above = (
        dbt_dependencies(nodes).join(hit.distinct(), ["repository_id", "upstream"])
        .groupBy("repository_id", F.col("downstream").alias("unique_id")).agg(F.count(F.lit(1)).alias("named_dependencies"))
    )
    scanned = joined.join(above, ["repository_id", "unique_id"], "left").select(
        "repository_id", "unique_id", "resource_type", "original_file_path", "depends_on", "compiled_contains_target", "fingerprint",
        F.coalesce("named_dependencies", F.lit(0).cast("bigint")).alias("named_dependencies"), F.lit(None).cast("string").alias("refusal_code"))
    without = manifests.filter(~F.coalesce(F.get_json_object("raw", "$.nodes").startswith("{"), F.lit(False))).select(
        "repository_id", F.lit("SOURCE_DBT_UNAVAILABLE").alias("refusal_code"))
    return scanned.unionByName(without, allowMissingColumns=True)


def path_allowed(path: Column, prefixes: Sequence[str]) -> Column:
    """Relative, without parent steps, and equal to or below one of the prefixes."""
    below = F.lit(False)
    for prefix in prefixes:
        clean = prefix.rstrip("/")
        below = below | (path == clean) | path.startswith(f"{clean}/")
    climbs = F.array_contains(F.split(path, "/"), "..") | path.startswith("/")
    return below & ~climbs


def rename_plan(files: DataFrame, before: str, after: str, allowed: Sequence[str]) -> DataFrame:
    """For every file: may it be renamed, and the fingerprints before and after."""
    pattern = token_pattern(before)
    replacement = after.replace("\\", "\\\\").replace("$", "\\$")
    counted = files.withColumn("occurrences", F.regexp_count("text", F.lit(pattern)))
    code = first_code(
        [
            (~path_allowed(F.col("path"), allowed), "SCOPE_TARGET_NOT_ALLOWED"),
            (F.col("occurrences") != 1, "IDENTITY_AMBIGUOUS"),
        ]
    )
    renamed = F.regexp_replace("text", pattern, replacement)
    return counted.withColumn("refusal_code", code).select(
        "path",
        F.col("occurrences").cast("bigint").alias("occurrences"),
        "refusal_code",
        F.when(F.col("refusal_code").isNull(), digest("text")).alias("before_digest"),
        F.when(F.col("refusal_code").isNull(), digest(renamed)).alias("after_digest"),
    )


# Names that mark a value as secret, and names that mark it as a statement.
SECRET_NAMES = ("email", "token", "password", "secret")
QUERY_NAMES = ("statement", "sql", "query", "querytext")


def json_digest(value: Column, kind: T.DataType) -> Column:
    """Digest of a value's JSON text."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    else:
        wrapped = F.to_json(F.array(value))
        text = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    return digest(text)


def _redacted(value: Column, kind: T.DataType, name: str) -> Column:
    """The value with secrets, statements and addresses masked at every depth."""
    if name.lower().replace("_", "") in QUERY_NAMES:
        return F.struct(F.lit(True).alias("redacted"), json_digest(value, kind).alias("digest"))
    return _masked(value, kind, name)


def _masked(value: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_redacted(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _masked(item, kind.elementType, name))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        secret, query = F.array(*[F.lit(n) for n in SECRET_NAMES]), F.array(*[F.lit(n) for n in QUERY_NAMES])
        return F.transform_values(value, lambda key, item: (
            F.when(F.array_contains(query, F.replace(F.lower(key), F.lit("_"), F.lit(""))), json_digest(item, kind.valueType))
            .when(F.array_contains(secret, F.lower(key)) & item.isNotNull(), F.lit(REDACTED))
            .otherwise(redact_emails(item))))
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.lit(REDACTED)) if name.lower() in SECRET_NAMES else redact_emails(value)
    return value


def redact_observations(df: DataFrame) -> DataFrame:
    """Mask addresses in texts, secrets whole, and statements down to their digest.

    What a column holds is read from the schema, at every depth of structs, arrays and
    maps; the plan has no Python in it.
    """
    return df.select(*[_redacted(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def guard_public_text(df: DataFrame, column: str, fallback: str) -> DataFrame:
    return df.withColumn(column, public_text(F.col(column), fallback))


def forbidden_scan(docs: DataFrame) -> DataFrame:
    """One finding per document and kind of forbidden content."""
    return docs.select("doc", F.explode(forbidden_labels(F.col("text"))).alias("label"))


# Licences a registered file may carry, and the form of a pinned revision.
APPROVED_LICENSES = ("CC0-1.0", "LicenseRef-NYC-Public-Domain")
REVISION = r"^[0-9a-f]{40}$"


def file_audit(
    registry: DataFrame, files: DataFrame, url_prefix: str, licenses: Sequence[str] = APPROVED_LICENSES
) -> DataFrame:
    """First failing check of every registered file.

    ``registry``: asset_id, path, format (``zip`` or another), size_bytes, sha256, license_id,
    revision, source_url, members (array). ``files``: path, length, sha256, members (array; null
    where the file is no readable archive). Members are compared as multisets. An archive needs a
    list of members and any other file must have none; a member that would leave its folder, or
    is a folder, is unexpected whatever the list says.
    """
    counts = registry.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_uses"))
    present = files.select("path", F.col("length").alias("_length"), F.col("sha256").alias("_sha"), F.col("members").alias("_members"))
    joined = registry.join(counts, "asset_id").join(present, "path", "left")
    pinned = F.concat_ws("/", F.lit(url_prefix), "revision", "path")
    listed = F.coalesce(F.size("members") > 0, F.lit(False))
    archive = F.coalesce(F.col("format") == "zip", F.lit(False))
    unsafe = F.exists("_members", lambda m: m.startswith("/") | m.endswith("/") | F.array_contains(F.split(m, "/"), ".."))
    differing = F.col("_members").isNull() | unsafe | differs(F.array_sort("_members"), F.array_sort("members"))
    code = first_code(
        [
            (~F.coalesce(F.col("revision").rlike(REVISION), F.lit(False)), "DATASET_SOURCE_UNPINNED"),
            ((F.col("_uses") > 1) | (archive != listed), "DATASET_REGISTRY_INVALID"),
            (~F.coalesce(F.col("license_id").isin(*licenses), F.lit(False)), "DATASET_LICENSE_UNAPPROVED"),
            (differs(F.col("source_url"), pinned), "DATASET_SOURCE_UNPINNED"),
            (F.col("_length").isNull(), "DATASET_CACHE_MISSING"),
            (F.col("_length") != F.col("size_bytes"), "DATASET_SIZE_MISMATCH"),
            (differs("_sha", "sha256"), "DATASET_CHECKSUM_MISMATCH"),
            (archive & differing, "DATASET_ARCHIVE_UNEXPECTED_MEMBER"),
        ]
    )
    return joined.select("asset_id", "path", code.alias("refusal_code"))
