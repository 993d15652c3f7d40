"""Mixing sources to target weights, by blocks of words.

The words of a source, document after document, are cut into blocks of a fixed length, shorter ones
for a small source, so that whole blocks come near its target. The mix is
a sequence of slots in shards. The source counts of a shard are a multinomial draw, conditioned on
every source's total over all shards, so that the totals meet the targets: a keyed permutation of
all slots deals each source its number of slots. A source's slots take its blocks in the order of
a keyed permutation of the block numbers, a new one for every pass, and blocks and documents are
joined by block number. Permutations are swap-or-not networks, computed for one number at a time,
so nothing is sorted and nothing is kept; DataFrame functions do all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.functions.ordered import before_each_row
from sundown.llm.common import fresh
from sundown.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
LEAST_BLOCKS = 1024  # of a source, as far as it has words
SHARD_SLOTS = 1024
MOST_PASSES = 3
ROUNDS = 20
STRETCH = 4096  # slots that one row stands for before it is spread out
ROWS_A_CHUNK = 20_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: str) -> Column:
    """A source as a join key: code-point order, null last."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))


def permuted(x: Column, size: Column, key: Column, *, inverse: bool = False) -> Column:
    """A keyed permutation of 0 .. size - 1 (swap-or-not)."""
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def step(value: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, turn), size) - value, size)
        swap = F.xxhash64(key, turn, F.lit("swap"), F.greatest(value, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(value)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x, step)


def targets(sized: DataFrame) -> DataFrame:
    """(key, source_size, target) of every source of (key, size).

    Weights are 1, 2, 3, repeating. With sources in the order of limit per weight, those whose
    limit lies below the level that the rest would get are full; the others share what is left.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    by_name, by_limit = every.orderBy("key"), every.orderBy("limit", "key")  # one row per source
    before, after = by_limit.rowsBetween(W.unboundedPreceding, -1), by_limit.rowsBetween(0, W.unboundedFollowing)
    levels = (
        sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("bigint"))
        .withColumn("limit", F.col("source_size") * MOST_PASSES / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_PASSES)
        .withColumn("level", (F.col("all_words") - F.col("full")) / F.sum("weight").over(after))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("limit"), F.col("level")), F.when(F.col("level") <= F.col("limit"), F.struct("limit", "key")))
    return levels.withColumn("at", level.over(every)).select(
        "key", "source_size",
        F.least((F.col("source_size") * MOST_PASSES).cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.lit(0.0))).alias("target"),
    )


def placed(sized: DataFrame) -> DataFrame:
    """The rows with ``start``, the words of their source before them; the order is a hash of doc_id, then doc_id."""
    chunks = max(1, sized.count() // ROWS_A_CHUNK)
    return before_each_row(
        sized, ["key"], F.pmod(F.xxhash64("doc_id"), F.lit(chunks)), ["doc_id", "size", "row_hash"], total={"start": F.col("size")}
    )


def block_length(block_words: int = BLOCK_WORDS) -> Column:
    """Words in a block of a source: at most ``block_words``, fewer where the source would have too few blocks."""
    return F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("bigint")


def slots(sources: DataFrame, seed: int) -> DataFrame:
    """(shard, slot, key, pass, block) of the whole mix."""
    spark = sources.sparkSession
    every = W.partitionBy(F.lit(0))
    counted = (
        sources.filter("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("bigint"))
        .withColumn(
            "own",
            F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), F.col("blocks") * MOST_PASSES),
        )
        .withColumn("first", F.coalesce(F.sum("own").over(every.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_slots", F.sum("own").over(every))
        .filter("own > 0")
        .select("key", "blocks", "own", "first", "all_slots")
    )
    stretches = counted.withColumn(
        "stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("own") - 1) / STRETCH)))
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "stretch")
    begin = F.col("stretch") * STRETCH
    each = stretches.withColumn("turn", F.explode(F.sequence(begin, F.least(begin + STRETCH, F.col("own")) - 1)))
    run = F.floor(F.col("turn") / F.col("blocks"))
    spot = permuted(F.col("first") + F.col("turn"), F.col("all_slots"), F.lit(f"{seed}:slots"), inverse=True)
    block = permuted(F.pmod("turn", "blocks"), F.col("blocks"), F.concat(F.lit(f"{seed}:"), run.cast("string"), F.lit(":"), F.col("key")))
    return each.select(spot.alias("spot"), "key", run.cast("int").alias("pass"), block.alias("block")).select(
        F.floor(F.col("spot") / SHARD_SLOTS).alias("shard"), F.pmod("spot", F.lit(SHARD_SLOTS)).alias("slot"), "key", "pass", "block"
    )


def _spread(rows: DataFrame) -> DataFrame:
    """A row for every block that a document has words in."""
    end, block_words = F.col("start") + F.col("size"), F.col("block_words")
    low = F.col("block") * block_words
    return (
        rows.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
        .withColumn("from_word", F.greatest(F.lit(0), low - F.col("start")))
        .withColumn("words", F.least(end, low + block_words) - F.greatest(F.col("start"), low))
    )


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    # The hash only orders rows that repeat a doc_id.
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), _key(source).alias("key"), word_count(text).alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_hash"),
    )


def mix(sized: DataFrame, seed: int, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized rows in their places, the sources with their targets, and the slots of the mix."""
    rows = cut_lineage(placed(cut_lineage(sized)))
    sources = cut_lineage(targets(rows).withColumn("block_words", block_length(block_words)))
    # One row a source: the planner broadcasts it while its table is small.
    return rows.join(sources.select("key", "block_words"), "key"), sources, slots(sources, seed)


def mixed_documents(
    docs: DataFrame, *, seed: int = 6, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Null and empty texts have no words, and nothing of them is taken; a null source is a source,
    the last; null and repeated doc_ids count as rows of their own; an empty table gives no
    rows; other columns are ignored.
    """
    rows, sources, drawn = mix(_sized(docs, doc_id, text, source), seed, block_words)
    times = drawn.groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        _spread(rows)
        .join(times.hint("merge"), ["key", "block"])  # the planner takes exploded slots for as few as the sources
        .groupBy("key", "start")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        .withColumn("some", F.lit(True))
    )
    # Rows without words may stand at the same place as the next one with words.
    return (
        rows.withColumn("some", F.col("size") > 0)
        .join(taken, ["key", "start", "some"], "left")
        .join(sources.drop("block_words"), "key")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed_texts(
    docs: DataFrame, *, seed: int = 6, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix as documents with the columns of ``docs``, whatever their names: one row per document and pass that takes words of it.

    Where a pass takes all blocks of a document its text is whole, else it is the taken words in
    their order, each with the space that follows it. Rows that repeat doc_id, text and source count
    once; null and empty texts give no row; a null doc_id or source is one like others; an empty
    table stays empty.
    """
    sized = _sized(docs, doc_id, text, source).dropDuplicates(["doc_id", "key", "row_hash"])
    rows, _, drawn = mix(sized, seed, block_words)
    of, key, hash_, taken, whole, words, cut = (fresh(docs, n) for n in ("mix_id", "mix_key", "mix_hash", "mix_spans", "mix_whole", "mix_words", "mix_text"))
    names = {of: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key: F.col("key"), hash_: F.col("row_hash")}
    spans = (
        _spread(rows)
        .join(drawn.select("key", "block", "pass").hint("merge"), ["key", "block"])
        .groupBy(*[c.alias(n) for n, c in names.items()], "start", "size", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias(taken))  # a document's own blocks
        .withColumn(whole, F.aggregate(taken, F.lit(0).cast("bigint"), lambda s, x: s + x["words"]) == F.col("size"))
        .select(*names, taken, whole)
    )
    marked = docs.withColumns(
        {
            of: F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("")), key: _key(source),
            hash_: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )
    spaced = F.regexp_extract_all(F.col(text), F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    joined = marked.dropDuplicates([*names]).join(spans, [*names])
    picked = joined.withColumn(words, F.when(~F.col(whole), spaced)).withColumn(cut, F.when(F.col(whole), F.col(text)).otherwise(F.array_join(
        F.flatten(F.transform(taken, lambda s: F.slice(F.col(words), s["from_word"].cast("int") + 1, s["words"].cast("int")))), "")))
    return picked.select(*[F.col(cut).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
