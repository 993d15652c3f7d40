"""Whitening against plain whole-number and numpy versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sundown.llm import whitening
from sundown.llm.matrix_plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    """{row place: (n, deviation)}, covariance and the fit list by Python integers."""
    whole = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in rows]
    listed = sorted(set(whole))
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in whole]
    off = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in listed])
    return n, sums, whole, deviations, off.T @ off / n


def held(frame):
    return sorted(((r["vec_id"], r["component"]), r) for r in frame.collect())


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    u = np.column_stack([rng.integers(0, 2, 130), rng.integers(0, 1 << 40, 130), np.zeros(130, np.int64)]).astype(np.uint64)
    widths = np.array([1, 40, 1])
    totals = np.zeros((6, 3, 3), np.int64)
    whitening.plane_products(whitening.bit_planes(u, widths), widths, totals)
    for i in range(3):
        for j in range(i, 3):
            got = sum(int(totals[g, i, j]) << (16 * g) for g in range(6))
            assert got == sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j], strict=True))


def test_query_equals_plain_version(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet")
    kept = [r for r in source.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, sums, whole, deviations, covariance = plain([r["embedding"] for r in kept])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    assert len(rows) == 16 * len(kept) and {r["n"] for r in rows} == {n}
    assert {r["vec_id"]: r["deviation"] for r in rows} == {r["vec_id"]: d for r, d in zip(kept, deviations, strict=True)}
    assert max(r["identity_error"] for r in rows) < 1e-9
    by_id = {r["vec_id"]: x for r, x in zip(kept, whole, strict=True)}
    signs = {}
    for r in rows:
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
        off = np.array([(n * a - s) / n for a, s in zip(by_id[r["vec_id"]], sums, strict=True)])
        expected = off @ axes[:, k] / math.sqrt(values[k])
        if abs(expected) > 1e-3:
            signs.setdefault(k, set()).add(round(r["whitened"] / expected, 5))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 16


def test_bad_rows_copies_and_clashing_names(spark, make):
    frame = make(
        "vec_id long, embedding array<float>, x string, i int, n int",
        (1, [0.5, 0.25], "a", 1, 1), (1, [0.5, 0.25], "a", 1, 1), (2, [-0.5, 0.75], "b", 1, 1), (None, [0.0, 1.0], None, 1, 1),
        (3, None, "c", 1, 1), (4, [None, 0.5], "c", 1, 1), (5, [float("nan"), 0.5], "c", 1, 1), (6, [float("-inf"), 0.5], "c", 1, 1),
        (7, [], "c", 1, 1), (8, [0.1, 0.2, 0.3], "c", 1, 1), (9, [3e38, 0.5], "c", 1, 1),
    )
    rows = whitening.whiten(frame).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in rows} == {3}
    n, sums, whole, deviations, _ = plain([[0.5, 0.25], [-0.5, 0.75], [0.0, 1.0]])
    assert {r["vec_id"]: r["deviation"] for r in rows} == dict(zip([1, 2, None], deviations, strict=True))


def test_direction_without_variance_and_empty_table(spark, make):
    rows = whitening.whiten(make("vec_id long, embedding array<float>", (1, [1.0, 2.0]), (2, [2.0, 2.0]))).collect()
    assert [(r["vec_id"], r["component"], r["whitened"] is None, r["explained"]) for r in sorted(rows)] == [
        (1, 1, False, 1.0), (1, 2, True, 0.0), (2, 1, False, 1.0), (2, 2, True, 0.0)]
    alone = whitening.whiten(make("vec_id long, embedding array<double>", (1, [1.0])))
    assert [tuple(r) for r in alone.collect()] == [(1, 1, 1, 0, None, 0.0, 0.0)]
    assert whitening.whiten(make("vec_id long, embedding array<float>")).collect() == []
    assert whitening.whiten(make("vec_id long, embedding array<float>", (1, None))).collect() == []


def test_large_entries_stay_exact(spark, make):
    values = [[1e9, -1.0], [-1e9, 2.0], [123456.75, 0.5], [1e9, 3.0]]
    frame = make("vec_id long, embedding array<double>", *[(i, v) for i, v in enumerate(values)])
    n, sums, whole, deviations, covariance = plain(values)
    rows = whitening.whiten(frame).collect()
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviations)}
    assert max(r["identity_error"] for r in rows) < 1e-4
