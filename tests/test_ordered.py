"""Chunked ordered helpers against plain windows, on data where one key holds most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.functions.ordered import before_each_row, range_row_numbers, row_numbers, sequence_chunk, sliced_before, sliced_numbers, with_slices


@pytest.fixture(scope="module")
def hot(spark):
    n = 500
    key = F.when(F.col("id") % 5 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20))
    df = spark.range(n).select(key.alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    numbered = df.withColumn("sequence", F.row_number().over(W.partitionBy("k").orderBy("n")))
    return numbered.cache()


@pytest.mark.parametrize("rows", [1, 3, 64, 10_000])
@pytest.mark.parametrize("current", [False, True])
def test_matches_plain_window(hot, got, rows, current):
    ours = before_each_row(
        hot, ["k"], sequence_chunk(rows=rows), ["sequence"], last={"l": F.col("v")}, first={"f": F.col("v")},
        total={"s": F.col("v")}, include_current=current)
    w = W.partitionBy("k").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0 if current else -1)
    plain = hot.select(
        "k", "sequence", F.last("v", True).over(w).alias("l"), F.first("v", True).over(w).alias("f"),
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"))
    names = ("k", "sequence", "l", "f", "s")
    assert got(ours, *names) == got(plain, *names)


def test_row_numbers(hot, got):
    ours = row_numbers(hot.drop("sequence"), ["k"], F.floor(F.col("n") / 10), ["n"], "sequence")
    assert got(ours, "k", "n", "sequence") == got(hot, "k", "n", "sequence")


def test_range_row_numbers(hot, got):
    text = hot.select("k", F.sha2(F.col("n").cast("string"), 256).alias("t"))
    plain = text.withColumn("position", F.row_number().over(W.partitionBy("k").orderBy("t")))
    assert got(range_row_numbers(text, ["k"], ["t"], slices=7), "k", "t", "position") == got(plain, "k", "t", "position")


def tied(spark, repeated):
    """A key with most rows, a third of them at one position, on positions far apart and below zero."""
    return spark.range(900).select(
        F.when(F.col("id") % 10 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.when((F.col("id") % 3 == 0) & F.lit(repeated), 1 << 33).otherwise((F.col("id") - 300) * F.col("id") * 40_000).alias("at"),
        F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"), F.create_map(F.lit("a"), F.col("id")).alias("m"))


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize(("bits", "rows"), [(30, 65_536), (30, 16), (4, 5)])
@pytest.mark.parametrize("current", [False, True])
def test_slices_match_plain_window(spark, got, repeated, bits, rows, current):
    df = tied(spark, repeated)
    ours = sliced_before(
        df, ["k"], ["at"], bits=bits, rows=rows, last={"l": F.col("v")}, first={"f": F.col("v")}, total={"s": F.col("v")}, least={"m1": -F.col("v")},
        include_current=current)
    tie = F.shiftrightunsigned(F.xxhash64("k", "at", "n", "v"), 1)
    w = W.partitionBy("k").orderBy("at", tie).rowsBetween(W.unboundedPreceding, 0 if current else -1)
    plain = df.select(
        "k", "n", F.last("v", True).over(w).alias("l"), F.first("v", True).over(w).alias("f"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"),
        F.min(-F.col("v")).over(w).alias("m1"))
    names = ("k", "n", "l", "f", "s", "m1")
    assert got(ours, *names) == got(plain, *names)


def test_no_slice_holds_many_rows_even_of_one_position(spark):
    df = tied(spark, True).select("k", F.col("at").alias("_position"), F.shiftrightunsigned(F.xxhash64("n"), 1).alias("_tie"))
    sizes = with_slices(df, ["k"], 30, 20).groupBy("k", "_from", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40 and sizes.agg(F.sum("count")).first()[0] == 900
    ordered = with_slices(df, ["k"], 30, 20).groupBy("k", "_from", "_part").agg(
        F.min(F.struct("_position", "_tie")).alias("a"), F.max(F.struct("_position", "_tie")).alias("b"))
    placed = ordered.withColumn("before", F.lag("b").over(W.partitionBy("k").orderBy("_from", "_part")))
    assert placed.filter(F.col("a") <= F.col("before")).count() == 0


def test_sliced_numbers(hot, got):
    ours = sliced_numbers(hot.drop("sequence"), ["k"], ["n"], "sequence", bits=3, rows=4)
    assert got(ours, "k", "n", "sequence") == got(hot, "k", "n", "sequence")
