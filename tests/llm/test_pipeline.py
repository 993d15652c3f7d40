"""Every registered query, and each stage of the pipeline on its own input, against plain versions."""

import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from brute import near_components

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from compare import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and [s[0] for s in corpus_pipeline.STAGES][0] == "quality classifier"


@pytest.mark.parametrize("name", [q for q in entry.oracle_sql() if re.match(r"op\d+_", q)])
def test_equals_sql(spark, name):
    good, note, _ = compare(spark, connect(FOLDER), name, FOLDER)
    assert good, note


def test_op1_over_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = entry.queries()["op1_near_dedup"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_components(texts)


def test_scores_over_the_table(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, modulus, rest, border, label in (("op5_quality", 3, 1, 0.5, "quality"), ("op9_toxicity", 4, 2, 0.3, "toxic")):
        rows = entry.queries()[name](spark, FOLDER).collect()
        assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= border)
        known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([r["predicted"] == labels[r["doc_id"]][label] for r in known]) >= 0.8


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        seen[name] = (before, docs)
        assert number == 4 or docs.columns == columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before, after = map(texts, seen["quality classifier"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert set(after) < set(before) and np.mean([(i in after) == bool(labels[i]) for i in before if i in labels]) > 0.95

    before, after = map(texts, seen["exact dedup"])
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert set(after) == set(first.values())

    before, after = map(texts, seen["MinHash near-dedup"])
    assert set(after) == {c for _, c in near_components(before).values()}

    before, after = seen["mixing sources to target weights"]
    words = lambda rows: {s: sum(len(r["text"].split()) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    sizes, taken = words(before.collect()), words(after.collect())
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.03 * sum(sizes.values())
    assert all(len(r["text"]) == r["n_chars"] for r in after.collect())

    before, after = seen["best-fit packing"]
    places = defaultdict(list)
    for r in after.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(length for held in places.values() for _, length in held)
    assert len(places) <= -(-total // 4096) * 1.02 + 1
    assert sum(r["piece"] == 0 for r in after.collect()) == before.count()
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
