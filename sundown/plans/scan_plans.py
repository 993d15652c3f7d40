"""Scans over documents, pages and conversations as whole texts, and the file registry over documents."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.operators import scans as s
from sundown.plans.twin import twin, view
from sundown.session import cut_lineage, ensure_checkpoint_dir
from sundown.sources.files import opened, read_archives
from sundown.sources.tables import Tables

TOKEN, REPLACEMENT = "the", "thou"


def d() -> Column:
    return F.col("doc_id")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def files(t: Tables) -> DataFrame:
    """Documents as repository files, some given an alias, a template mark or a statement selecting every column."""
    text = F.concat(
        F.when(d() % 7 == 0, F.lit("{{ ref }} ")).otherwise(F.lit("")), "text",
        F.when(d() % 5 == 0, F.lit("\nthe AS alias")).otherwise(F.lit("")),
        F.when(d() % 11 == 0, F.lit("\nSELECT\n * FROM x")).otherwise(F.lit("")))
    folder = F.when(d() % 29 == 0, "target/models").when(d() % 2 == 0, "macros").otherwise("models")
    suffix = _pick((".sql", ".py", ".YML", ".yaml", ".txt", ".md"), d() % 6)
    return t.documents.select(
        F.col("source").alias("repository_id"), F.concat("source", F.lit("/"), folder, F.lit("/d"), d(), suffix).alias("path"), text.alias("text"))


view("files", """
SELECT source AS repository_id, doc_id, doc_id % 29 = 0 AS skipped,
       source || '/' || CASE WHEN doc_id % 29 = 0 THEN 'target/models' WHEN doc_id % 2 = 0 THEN 'macros' ELSE 'models' END || '/d' || doc_id
         || ['.sql', '.py', '.YML', '.yaml', '.txt', '.md'][doc_id % 6 + 1] AS path, doc_id % 6 < 4 AND doc_id % 29 <> 0 AS scanned,
       CASE WHEN doc_id % 7 = 0 THEN '{{ ref }} ' ELSE '' END || text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'the AS alias' ELSE '' END
         || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'SELECT' || chr(10) || ' * FROM x' ELSE '' END AS text FROM documents
""")
# Identifier runs compared for equality: the boundaries are exactly the identifier class.
view("files_counted", f"""
SELECT *, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: w = '{TOKEN}')) AS n FROM files
""")

ALLOWED = ("src0/models", "src1/", "src2")


def scan_texts(t: Tables) -> DataFrame:
    """Every text of three tables, with planted paths, keys and credentials."""
    plant = (
        F.when(d() % 97 == 0, "\n/home/someone/notes").when(d() % 101 == 0, "\n-----BEGIN RSA PRIVATE KEY-----")
        .when(d() % 89 == 0, "\npassword = 'abcdefgh12345678'").when(d() % 83 == 0, "\nwrite to a.b+c@example.org today")
        .when(d() % 79 == 0, "\nplease update every row and set it").when(d() % 73 == 0, "\nsee https://example.org/x").otherwise(""))
    docs = t.documents.select(F.concat(F.lit("d"), d()).alias("doc"), F.concat("text", plant).alias("text"))
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("doc"), F.col("html").alias("text"))
    talks = t.conversations.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("doc"), "text")
    return docs.unionByName(pages).unionByName(talks)


view("scan_texts", """
SELECT 'd' || doc_id AS doc, text || CASE WHEN doc_id % 97 = 0 THEN chr(10) || '/home/someone/notes'
  WHEN doc_id % 101 = 0 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' WHEN doc_id % 89 = 0 THEN chr(10) || 'password = ''abcdefgh12345678'''
  WHEN doc_id % 83 = 0 THEN chr(10) || 'write to a.b+c@example.org today' WHEN doc_id % 79 = 0 THEN chr(10) || 'please update every row and set it'
  WHEN doc_id % 73 = 0 THEN chr(10) || 'see https://example.org/x' ELSE '' END AS text FROM documents
UNION ALL SELECT 'p' || page_id, html FROM pages
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
""")


def observations(t: Tables) -> DataFrame:
    """Rows with a free text, a secret and a statement."""
    return scan_texts(t).select(
        "doc", "text", F.when(F.length("doc") % 3 != 0, F.concat(F.lit("secret-"), "doc")).alias("token"),
        F.concat(F.lit("select * from "), "doc").alias("statement"))


URL = "https://files.example.org/assets"
REVISION = "0123456789abcdef0123456789abcdef01234567"


def registry(t: Tables) -> DataFrame:
    """A registry entry per document, with planted faults in every checked property."""
    path = F.concat(F.lit("docs/"), F.when(d() % 53 == 0, F.lit("gone-")).otherwise(F.lit("")), d())
    revision = F.when(d() % 23 == 0, F.lit("main")).otherwise(F.lit(REVISION))
    url = F.concat_ws("/", F.lit(URL), revision, F.when(d() % 37 == 0, F.lit("elsewhere")).otherwise(path))
    return t.documents.select(
        F.concat(F.lit("a"), F.when(d() % 59 == 0, d() - 1).otherwise(d())).alias("asset_id"),
        path.alias("path"), F.when(d() % 4 == 0, F.when(d() % 36 == 0, "text").otherwise("zip")).otherwise("text").alias("format"),
        (F.octet_length("text") + F.when(d() % 41 == 0, 1).otherwise(0)).cast("bigint").alias("size_bytes"),
        F.when(d() % 43 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(d() % 31 == 0, "Proprietary").otherwise("CC0-1.0").alias("license_id"),
        revision.alias("revision"), url.alias("source_url"),
        F.when(d() % 4 == 0, F.array(F.lit("a.csv"), F.lit("b.csv"))).otherwise(F.array().cast("array<string>")).alias("members"))


def registry_files(t: Tables) -> DataFrame:
    members = (
        F.when(d() % 44 == 0, F.array(F.lit("a.csv"), F.lit("b.csv"), F.lit("b.csv")))
        .when(d() % 52 == 0, F.array(F.lit("a.csv")))
        .when(d() % 68 == 0, F.lit(None).cast("array<string>"))
        .when(d() % 4 == 0, F.array(F.lit("b.csv"), F.lit("a.csv")))
        .otherwise(F.array().cast("array<string>")))
    return t.documents.select(
        F.concat(F.lit("docs/"), d()).alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.sha2("text", 256).alias("sha256"),
        members.alias("members"))


# The members of a landed archive by the remainder of its document's id; the others hold what their list says.
LISTED = ("a.csv", "data/b.csv")
FAULTS = {
    3: ("a.csv", "data/b.csv", "data/b.csv"), 5: ("a.csv",), 7: ("a.csv", "../b.csv"), 11: ("a.csv", "data/b.csv", "data/"), 13: None,
}


def archive_bytes(members: list[str] | None, text: str) -> bytes:
    """A small ZIP file with the text in every member; without members, bytes that are no archive."""
    if members is None:
        return b"PK no archive " + text.encode()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in members:
            archive.writestr(zipfile.ZipInfo(name), text)
    return held.getvalue()


def landed_archives(t: Tables) -> tuple[DataFrame, str]:
    """A ZIP file per document, written by tasks below the shared folder: (doc_id, path, size_bytes, sha256), and the folder."""
    spark = t.spark
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, inside = opened(folder)
        store.create_dir(inside)
        for batch in batches:
            paths, sizes, sums = [], [], []
            for doc, members, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "members", "text")), strict=True):
                content = archive_bytes(members, text or "")
                paths.append(f"d{doc}.zip")
                sizes.append(len(content))
                sums.append(hashlib.sha256(content).hexdigest())
                with store.open_output_stream(f"{inside}/{paths[-1]}") as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(paths), pa.array(sizes), pa.array(sums)], ["doc_id", "path", "size_bytes", "sha256"])

    held = F.array(*[F.lit(m) for m in LISTED])
    for k, names in FAULTS.items():
        held = F.when(d() % k == 0, F.lit(None) if names is None else F.array(*[F.lit(m) for m in names])).otherwise(held)
    source = t.documents.select("doc_id", held.cast("array<string>").alias("members"), "text")
    return cut_lineage(source.mapInArrow(write, "doc_id bigint, path string, size_bytes bigint, sha256 string")), folder


def archive_audit(t: Tables) -> DataFrame:
    """The landed archives against a registry that lists the same two members for all, nothing for some."""
    landed, folder = landed_archives(t)
    listed = F.when(d() % 17 != 0, F.array(*[F.lit(m) for m in LISTED])).otherwise(F.array().cast("array<string>"))
    entries = landed.select(
        F.concat(F.lit("a"), d()).alias("asset_id"), "path", F.lit("zip").alias("format"), "size_bytes",
        F.when(d() % 19 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), F.lit("CC0-1.0").alias("license_id"),
        F.lit(REVISION).alias("revision"), F.concat_ws("/", F.lit(URL), F.lit(REVISION), "path").alias("source_url"), listed.alias("members"))
    return s.file_audit(entries, read_archives(t.spark, folder), URL)


PROJECT = 50  # documents of a dbt project


def manifests(t: Tables) -> DataFrame:
    """A dbt manifest per project of a repository: its documents as nodes, each depending on two neighbours; a few without nodes."""
    number = F.floor(d() / PROJECT)
    name = lambda id_: F.concat(F.lit("model.p."), id_.cast("string"))
    node = F.to_json(F.struct(
        _pick(("model", "seed", "test", "snapshot", "model"), d() % 5).alias("resource_type"),
        F.when(d() % 8 != 0, F.col("path")).alias("original_file_path"),
        F.concat(F.lit("select "), F.when(d() % 3 == 0, f"{TOKEN}_end").when(d() % 4 == 0, TOKEN).otherwise("x"), F.lit(" from t")).alias("compiled_code"),
        F.when(d() % 6 != 0, F.struct(F.array(name(d() + 1), name(d() - 1)).alias("nodes"))).alias("depends_on")))
    pathed = files(t).withColumn("doc_id", F.regexp_extract("path", r"/d(\d+)\.", 1).cast("bigint"))
    grouped = pathed.select("repository_id", number.alias("project"), F.struct(name(d()).alias("key"), node.alias("node")).alias("e")).groupBy(
        "repository_id", "project").agg(F.array_sort(F.collect_list("e")).alias("entries"))  # a project's documents
    body = F.concat_ws(",", F.transform("entries", lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["node"])))
    return grouped.select("repository_id", F.when(F.col("project") % 13 == 12, F.lit('{"nodes":[]}')).otherwise(
        F.concat(F.lit('{"nodes":{'), body, F.lit(',"odd":7}}'))).alias("raw"))


view("dbt_nodes", f"""
SELECT f.repository_id, 'model.p.' || doc_id AS unique_id, ['model', 'seed', 'test', 'snapshot', 'model'][doc_id % 5 + 1] AS resource_type,
       CASE WHEN doc_id % 8 <> 0 THEN path END AS original_file_path, doc_id, doc_id % 3 <> 0 AND doc_id % 4 = 0 AS compiled,
       CASE WHEN doc_id % 8 <> 0 AND n > 0 AND NOT skipped THEN 'sha256:' || sha256(text) END AS fingerprint,
       CASE WHEN doc_id % 6 <> 0 THEN list_sort(['model.p.' || (doc_id + 1), 'model.p.' || (doc_id - 1)]) ELSE [] END AS above
FROM files_counted f WHERE doc_id % 5 <> 3 AND doc_id // {PROJECT} % 13 <> 12
""")

_Q = lambda build: (lambda spark, folder: build(Tables(spark, folder)))


def scope(t: Tables) -> DataFrame:
    return s.scope_counterfactual(files(t), TOKEN)


def repositories(t: Tables) -> DataFrame:
    """Every source as a configured repository, two thirds of them required, and one that holds nothing for each."""
    sources = t.documents.select(F.col("source").alias("repository_id")).distinct()
    empty = sources.select(F.concat("repository_id", F.lit("-empty")).alias("repository_id"))
    return sources.unionByName(empty).withColumn("required", F.length("repository_id") % 3 != 0)


def scope_details(t: Tables) -> tuple[DataFrame, DataFrame]:
    return s.scope_detail(files(t), repositories(t), TOKEN, byte_bound=BYTE_BOUND)


BYTE_BOUND = 20_000


def redacted(t: Tables) -> DataFrame:
    """Text, secret and statement, the statement inside a list of structs."""
    nested = observations(t).select("doc", "text", "token", F.array(F.struct("statement")).alias("runs"))
    return s.redact_observations(nested).select(
        "doc", F.sha2("text", 256).alias("text_digest"), "token", F.col("runs")[0]["statement"]["digest"].alias("statement_digest"))


QUERIES = {
    "b21_file_audit": _Q(lambda t: s.file_audit(registry(t), registry_files(t), URL)),
    "b21_archive_audit": _Q(archive_audit),
    "c13_scope_counterfactual": _Q(scope),
    "c13_scope_detail": _Q(lambda t: scope_details(t)[0].withColumn("limitations", F.concat_ws(",", "limitations"))),
    "c13_matched_paths": _Q(lambda t: scope_details(t)[1]),
    "c13_counterfactual_summary": _Q(lambda t: s.counterfactual_summary(scope(t), t.orders).select(
        "graph_consumers", "repository_matches", "complete", "minimum_additional", "graph_expands_inventory")),
    "c14_reference_scan": _Q(lambda t: s.reference_scan(files(t), TOKEN).select(
        "path", F.coalesce("classification", F.lit("")).alias("classification"), "selects_all")),
    "c14_manifest_scan": _Q(lambda t: s.manifest_scan(manifests(t), files(t), TOKEN).withColumn("depends_on", F.concat_ws(",", "depends_on"))),
    "c16_rename_plan": _Q(lambda t: s.rename_plan(files(t), TOKEN, REPLACEMENT, ALLOWED)),
    "d1_redact_observations": _Q(redacted),
    "d2_public_text_guard": _Q(lambda t: s.guard_public_text(scan_texts(t), "text", "withheld").select(
        "doc", F.sha2("text", 256).alias("text_digest"), (F.col("text") == "withheld").alias("withheld"))),
    "d3_forbidden_scan": _Q(lambda t: s.forbidden_scan(scan_texts(t))),
}

_WORD = r"[\pL\pM\pN_]"
_NOT = r"(?:^|$|[^\pL\pM\pN_])"
_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\pZ]"
_STATEMENT = (
    r"(?:^|[^\pL\pM\pN_])(?:select|insert|update|delete|merge)"
    r"[^\pL\pM\pN_\n](?:[^\n]*[^\pL\pM\pN_\n])?(?:from|into|set)(?:$|[^\pL\pM\pN_])"
)
_SENSITIVE_SQL = " OR ".join(
    f"regexp_matches(text, '(?i){pattern}')"
    for pattern in (
        "/home/|/Users/|[A-Za-z]:\\\\\\\\",
        "https?://|urn:li:",
        rf"(?:^|[^\pL\pM\pN_])[\pL\pM\pN_][\pL\pM\pN_.+-]*@[\pL\pM\pN_.-]+\.[A-Za-z]{{2,}}(?:$|[^\pL\pM\pN_])",
        _STATEMENT,
        rf"{_NOT}(?:token|secret|password|cookie){_SPACE}*[=:]",
    )
)

ORACLES = {
    "b21_file_audit": """
SELECT asset_id, path, CASE WHEN doc_id % 23 = 0 THEN 'DATASET_SOURCE_UNPINNED' WHEN uses > 1 OR doc_id % 36 = 0 THEN 'DATASET_REGISTRY_INVALID'
  WHEN doc_id % 31 = 0 THEN 'DATASET_LICENSE_UNAPPROVED' WHEN doc_id % 37 = 0 THEN 'DATASET_SOURCE_UNPINNED'
  WHEN doc_id % 53 = 0 THEN 'DATASET_CACHE_MISSING' WHEN doc_id % 41 = 0 THEN 'DATASET_SIZE_MISMATCH'
  WHEN doc_id % 43 = 0 THEN 'DATASET_CHECKSUM_MISMATCH' WHEN doc_id % 44 = 0 OR doc_id % 52 = 0 OR doc_id % 68 = 0 THEN 'DATASET_ARCHIVE_UNEXPECTED_MEMBER' END AS refusal_code
FROM (SELECT doc_id, asset_id, count(*) OVER (PARTITION BY asset_id) AS uses, 'docs/' || CASE WHEN doc_id % 53 = 0 THEN 'gone-' ELSE '' END || doc_id AS path
      FROM (SELECT doc_id, 'a' || CASE WHEN doc_id % 59 = 0 THEN doc_id - 1 ELSE doc_id END AS asset_id FROM documents))""",
    "b21_archive_audit": """
SELECT 'a' || doc_id AS asset_id, 'd' || doc_id || '.zip' AS path, CASE WHEN doc_id % 17 = 0 THEN 'DATASET_REGISTRY_INVALID'
  WHEN doc_id % 19 = 0 THEN 'DATASET_CHECKSUM_MISMATCH' WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0
  THEN 'DATASET_ARCHIVE_UNEXPECTED_MEMBER' END AS refusal_code FROM documents""",
    "c13_scope_counterfactual": twin("""
SELECT repository_id, count(*) AS inspected_files, count(*) FILTER (WHERE n > 0) AS matched_files,
       count(*) FILTER (WHERE strlen(text) > 10485760) AS oversized_files,
       count(*) <= 10000 AND count(*) FILTER (WHERE strlen(text) > 10485760) = 0 AS complete
FROM files_counted WHERE scanned GROUP BY 1"""),
    "c13_scope_detail": twin(f"""
SELECT r.repository_id, length(r.repository_id) % 3 <> 0 AS required, coalesce(f.n, 0) AS inspected_files, coalesce(f.hits, 0) AS matched_files,
       f.n IS NOT NULL AND f.long = 0 AS complete, CASE WHEN f.n IS NULL THEN 'Repository holds no scanned file'
         WHEN f.long > 0 THEN 'Repository file exceeded its bound on bytes' ELSE '' END AS limitations
FROM (SELECT DISTINCT source AS repository_id FROM documents UNION ALL SELECT DISTINCT source || '-empty' FROM documents) r
LEFT JOIN (SELECT repository_id, count(*) AS n, count(*) FILTER (WHERE n > 0) AS hits, count(*) FILTER (WHERE strlen(text) > {BYTE_BOUND}) AS long
           FROM files_counted WHERE scanned GROUP BY 1) f USING (repository_id)"""),
    "c13_matched_paths": twin("SELECT repository_id, path FROM files_counted WHERE scanned AND n > 0"),
    "c13_counterfactual_summary": twin("""
SELECT g AS graph_consumers, m AS repository_matches, ok AS complete, CASE WHEN ok THEN greatest(0, g - m) END AS minimum_additional, ok AND g > m AS graph_expands_inventory
FROM (SELECT (SELECT count(*) FROM orders) AS g, (SELECT count(*) FROM files_counted WHERE scanned AND n > 0) AS m,
             (SELECT max(c) <= 10000 FROM (SELECT count(*) AS c FROM files WHERE scanned GROUP BY repository_id)) AS ok)"""),
    "c14_reference_scan": twin(rf"""
SELECT * FROM (SELECT path, CASE WHEN n = 0 THEN '' WHEN contains(text, '{{{{') AND doc_id % 2 = 0 THEN 'macro_or_generated'
    WHEN regexp_matches(text, '(?i)(?:^|[^\pL\pM\pN_]){TOKEN}{_SPACE}+as{_SPACE}+[\pL\pM\pN_]') THEN 'aliased_direct' ELSE 'direct' END AS classification,
  regexp_matches(text, '(?i)(?:^|[^\pL\pM\pN_])select{_SPACE}+\*') AS selects_all FROM files_counted WHERE NOT skipped) WHERE classification <> '' OR selects_all"""),
    "c14_manifest_scan": twin(f"""
SELECT n.repository_id, n.unique_id, resource_type, original_file_path, coalesce(array_to_string(above, ','), '') AS depends_on,
       compiled AS compiled_contains_target, fingerprint, count(h.unique_id) AS named_dependencies, CAST(NULL AS VARCHAR) AS refusal_code
FROM dbt_nodes n LEFT JOIN (SELECT repository_id, unique_id FROM dbt_nodes WHERE compiled OR fingerprint IS NOT NULL) h
  ON h.repository_id = n.repository_id AND list_contains(n.above, h.unique_id) GROUP BY ALL
UNION ALL SELECT source, NULL, NULL, NULL, '', NULL, NULL, NULL, 'SOURCE_DBT_UNAVAILABLE' FROM (
  SELECT DISTINCT source, doc_id // {PROJECT} AS project FROM documents WHERE doc_id // {PROJECT} % 13 = 12)"""),
    "c16_rename_plan": twin(f"""
SELECT path, n AS occurrences, code AS refusal_code, CASE WHEN code IS NULL THEN 'sha256:' || sha256(text) END AS before_digest,
  CASE WHEN code IS NULL THEN 'sha256:' || sha256(regexp_replace(text, '(^|[^A-Za-z0-9_]){TOKEN}($|[^A-Za-z0-9_])', '\\1{REPLACEMENT}\\2')) END AS after_digest
FROM (SELECT *, CASE WHEN NOT (path LIKE 'src0/models/%' OR path LIKE 'src1/%' OR path LIKE 'src2/%') THEN 'SCOPE_TARGET_NOT_ALLOWED'
                     WHEN n <> 1 THEN 'IDENTITY_AMBIGUOUS' END AS code FROM files_counted)"""),
    "d1_redact_observations": twin(r"""
SELECT doc, sha256(regexp_replace(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[redacted-email]', 'g')) AS text_digest,
       CASE WHEN length(doc) % 3 <> 0 THEN '[redacted]' END AS token, 'sha256:' || sha256('"select * from ' || doc || '"') AS statement_digest FROM scan_texts"""),
    "d2_public_text_guard": twin(f"""
SELECT doc, CASE WHEN bad THEN sha256('withheld') ELSE sha256(trimmed) END AS text_digest, bad AS withheld FROM (
  SELECT doc, trimmed, trimmed = '' OR {_SENSITIVE_SQL} AS bad
  FROM (SELECT doc, text, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS trimmed FROM scan_texts))"""),
    "d3_forbidden_scan": twin(rf"""
SELECT doc, 'home path' AS label FROM scan_texts WHERE regexp_matches(text, '(?:/home/|/Users/)[^/\s]+/')
UNION ALL SELECT doc, 'private key' FROM scan_texts WHERE regexp_matches(text, '-----BEGIN .*PRIVATE KEY-----')
UNION ALL SELECT doc, 'credential value' FROM scan_texts
  WHERE regexp_matches(text, '(?im)(?:token|client_secret|password){_SPACE}*[=:]{_SPACE}*["'']?[A-Za-z0-9+/=_-]{{12,}}')"""),
}
