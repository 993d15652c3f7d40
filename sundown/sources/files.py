"""Readers for landed records and file trees."""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundown.functions.hashing import digest
from sundown.functions.identity import IDENTITY_PARTS
from sundown.operators.events import PAYLOAD

READ_BYTES = 8 << 20
SCANS_A_TASK = 32

FIELD = "struct<platform:string,instance:string,database:string,schema:string,table:string,field:string>"
SPEC_SCHEMA = f"spec_id string, target {FIELD}, replacement {FIELD}"
EVENT_SCHEMA = (
    "campaign_id string, sequence bigint, event_type string, occurred_at string, idempotency_key string, "
    "previous_event_digest string, event_digest string"
)


def read_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Retirement specifications, one JSON object per line."""
    return spark.read.schema(SPEC_SCHEMA).json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Campaign events, one JSON object per line, with the payload kept as JSON text."""
    parsed = spark.read.schema(f"{EVENT_SCHEMA}, payload struct<{_as_struct(PAYLOAD)}>").json(folder)
    return parsed.withColumn("payload", F.to_json("payload")).withColumn(
        "occurred_at", F.col("occurred_at").try_cast("timestamp"))


def _as_struct(columns: str) -> str:
    """``name type, ...`` as the fields of a struct."""
    depth, result = 0, []
    for part in columns.split(", "):
        result.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(result)


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written as CSV with a header; the schema is given, never inferred."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"


def relative_path(name: Column, root: str) -> Column:
    """A file's name below ``root``; schemes and hosts of either are left out, and only the leading part is cut."""
    base = "/" + re.sub(_SCHEME, "", root).strip("/") + "/"
    whole = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(name, _SCHEME, ""), r"^/+", ""))
    return F.when(whole.startswith(base), F.substring(whole, F.lit(len(base) + 1), F.length(whole))).otherwise(whole)


def read_text_files(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """Whole text files below a root, with their path relative to it."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    # The metadata path is percent-encoded, and a plus sign in it is a plus sign.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.lit(repository_id).alias("repository_id"), relative_path(name, root).alias("path"), F.col("value").alias("text"))


def storage_uri(path: str) -> str:
    """A path as Spark lists it, in the form that storage libraries know: plain for local files, one name for S3."""
    local = re.sub(r"^file:/*", "/", path)
    return local if local.startswith("/") else re.sub(r"^s3[an]:", "s3:", path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a file, and the file's name there."""
    uri = storage_uri(path)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length) of the files below a root; their content is not read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        .select("path", "length")
    )
    # A scan's partitions count every file as some megabytes, so small files would be a task for every few dozen.
    tasks = found.rdd.getNumPartitions() // SCANS_A_TASK
    return found.coalesce(max(tasks, 4 * spark.sparkContext.defaultParallelism))


def _digest(file: pa.NativeFile) -> str:
    running = hashlib.sha256()
    while block := file.read(READ_BYTES):
        running.update(block)
    return running.hexdigest()


def _sha256(path: str) -> str:
    store, inside = opened(path)
    with store.open_input_stream(inside) as stream:
        return _digest(stream)


def _members(file: pa.NativeFile) -> list[str] | None:
    try:
        with zipfile.ZipFile(file) as archive:
            return [entry.filename for entry in archive.infolist()]
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # no directory at its end, or shorter than one
        return None


def archive_members(path: str) -> list[str] | None:
    """The names in a ZIP file's central directory, in its order, repeats included; null if it is none.

    Only the end of the file and the directory are read, by range, whatever the members' size.
    """
    store, inside = opened(path)
    with store.open_input_file(inside) as file:
        return _members(file)


def _archive(path: str) -> dict[str, object]:
    """Digest and members of an archive, opened once."""
    store, inside = opened(path)
    with store.open_input_file(inside) as file:
        return {"sha256": _digest(file), "members": _members(file)}


def _with_column(listed: DataFrame, name: str, kind: pa.DataType, ddl: str, value: Callable[[str], object]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([value(path) for path in batch.column("path").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.mapInArrow(run, f"{schema}, {name} {ddl}")


def read_file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Size and SHA-256 of every file below a root, whatever its size.

    The listing reads no content; tasks then read each file in blocks and hash as they go.
    """
    hashed = _with_column(_listed(spark, root, pattern), "sha256", pa.string(), "string", _sha256)
    return hashed.select(relative_path(F.col("path"), root).alias("path"), "length", "sha256")


def read_archives(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """Size, SHA-256 and members of the archives below a root, as :func:`sundown.operators.scans.file_audit` wants them."""
    held = pa.struct([("sha256", pa.string()), ("members", pa.list_(pa.string()))])
    found = _with_column(_listed(spark, root, pattern), "held", held, "struct<sha256:string,members:array<string>>", _archive)
    return found.select(relative_path(F.col("path"), root).alias("path"), "length", "held.sha256", "held.members")


def explode_manifest(manifests: DataFrame, raw: str, urn_path: str) -> DataFrame:
    """Nodes of JSON manifests as rows: unique id, resource type, and the URN each declares.

    ``urn_path`` is the JSON path of the declared name inside a node, e.g. ``$.config.meta.urn``.
    """
    nodes = F.from_json(F.get_json_object(raw, "$.nodes"), "map<string,string>")
    return manifests.select("campaign_id", F.explode(nodes).alias("unique_id", "_n")).select(
        "campaign_id", "unique_id", F.get_json_object("_n", "$.resource_type").alias("resource_type"),
        F.get_json_object("_n", urn_path).alias("declared_urn"))


def declared_identity(specs: DataFrame, side: str = "target", environment: str = "PROD") -> DataFrame:
    """The six declared parts of one side of each spec, as the identity match wants them."""
    parts = [F.col(f"{side}.{p}").alias(p) for p in IDENTITY_PARTS if p != "environment"]
    return specs.select("spec_id", *parts, F.lit(environment).alias("environment"))


def spec_digest(specs: DataFrame) -> DataFrame:
    """Specs with a digest of their two sides."""
    return specs.withColumn("specification_digest", digest(F.to_json(F.struct("target", "replacement"))))
