"""Near duplicates by an inverted join on MinHash signature coordinates.

1. Texts with the same words are one class, a node of the link graph.
2. A signature has ``COORDINATES`` values. A node is posted under each (coordinate, value).
3. A pair above the similarity agrees on ``MATCHES`` coordinates (see below). Order a node's
   postings by the length of their lists, rarest first. Two nodes with ``MATCHES`` common
   lists must meet in the first ``COORDINATES - MATCHES + 1`` lists of both, so the rest, among
   them the long lists of passages that many documents share, are skipped.
4. Lists of a large group of copies would give all its pairs. So every list first compares each
   node with one centre only, the links found are contracted to components, and lists that
   lie in one component are done. After two such rounds with different centres the nodes that
   are still outside their list's largest component are compared with the list's other nodes.
5. A pair is compared by a finer sketch where the list meets, so that texts which are only half
   alike don't leave the join. Sets up to ``BITMAP_MOST`` shingles carry a bitmap with one bit a
   shingle: the common bits and the bits lost inside one set bound the common shingles from
   above, so nothing is lost. Sets beyond ``SKETCH_FROM`` carry one bit of each of ``SKETCH``
   further minima. Any two sets that could be alike have one of the two in common.
6. The pairs left are confirmed on the full shingle sets.

A pair of exactly 75 % agrees on fewer than 20 of 48 coordinates with a probability below 1e-6,
and differs in more than ``SKETCH_MOST`` of 1,024 bits with one below 1e-6; then it is lost only if
no other chain of links connects it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.llm.common import SPACE, connected_components, fresh, map_batches, raw_text
from sundown.session import cut_lineage

WORDS = 5
COORDINATES = 48
MATCHES = 20
SHARE = (75, 100)  # intersection : union
BITMAP = 2_048  # bits
BITMAP_MOST = 768  # shingles
SKETCH = 1_024  # bits
SKETCH_FROM = 512  # shingles; a pair with one set beyond BITMAP_MOST has both beyond this
SKETCH_MOST = 180  # bits that may differ: binomial with an eighth each

_MIX = np.random.default_rng(48_075).integers(1, 1 << 63, COORDINATES + WORDS, dtype=np.uint64) | np.uint64(1)
_FINE = np.random.default_rng(1_024_075).integers(1, 1 << 32, 2 * SKETCH, dtype=np.uint32) | np.uint32(1)
_EMPTY = np.empty(0, np.uint64)


class _WordHashes(dict):
    """Hash of a word, remembered; starts anew when it grows beyond its bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; both are what ``bytes`` does."""
    return text.lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five-word shingles; fewer words are one shingle, none are none."""
    if not words:
        return _EMPTY
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    rows = len(words) - size + 1
    mixed = np.full(rows, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashed[i : i + rows]) * _MIX[COORDINATES + i]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """Smallest value of each coordinate's hash."""
    least = np.full(COORDINATES, ~np.uint64(0))
    for start in range(0, len(found), 4096):  # bounded memory for any length
        block = found[None, start : start + 4096] * _MIX[:COORDINATES, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least.view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """One bit for every shingle, in words."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(found >> np.uint64(40)) % np.uint64(BITMAP)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit of the smallest value of each of ``SKETCH`` hashes, in words."""
    values = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    least = np.full(SKETCH, ~np.uint32(0))
    for start in range(0, len(values), 1024):
        np.minimum(least, (values[None, start : start + 1024] * _FINE[:SKETCH, None]).min(axis=1), out=least)
    # The lowest bit of a product is that of its factor, so a high one of another product is taken.
    return np.packbits(((least * _FINE[SKETCH:]) >> np.uint32(27)).astype(np.uint8) & 1, bitorder="little").view("<i8")


def words_key(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def words_key_of(text: str) -> Column:
    """The same key of a text column."""
    upper = "".join(map(chr, range(65, 91)))
    low = F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())
    return F.unhex(F.sha2(F.trim(F.regexp_replace(low, SPACE, " ")).cast("binary"), 256))


def _signed_classes(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, sizes, values = [], [], []
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        found = shingles(words)
        keys.append(words_key(words))
        sizes.append(len(found))
        values.append(signature(found) if len(found) else None)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
            pa.array(values, pa.list_(pa.int64())),
        ],
        ["doc_id", "words_key", "n_shingles", "signature"],
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [words_of(text) for text in batch.column("text").to_pylist()]
    found = [shingles(w) for w in words]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array([words_key(w) for w in words], pa.binary()),
            pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
            pa.array([bitmap(f) if len(f) <= BITMAP_MOST else None for f in found], pa.list_(pa.int64())),
            pa.array([sketch(f) if len(f) > SKETCH_FROM else None for f in found], pa.list_(pa.int64())),
        ],
        ["doc_id", "words_key", "shingles", "bitmap", "sketch"],
    )


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, words_key, n_shingles, signature); no signature for a text without words."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    return map_batches(source, _signed_classes, "doc_id bigint, words_key binary, n_shingles bigint, signature array<bigint>")


def prefix_postings(signed: DataFrame) -> DataFrame:
    """(token, doc_id) of the lists in which a pair with enough matches must meet.

    A token is a (coordinate, value). Lists of one document can't collide, so they count as the
    rarest and never leave the counting.
    """
    posted = signed.select("doc_id", F.posexplode("signature").alias("coordinate", "value")).select(
        F.xxhash64("coordinate", "value").alias("token"), "doc_id"
    )
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    lists = (
        posted.join(shared, "token")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("length", "token"))).alias("tokens"))  # 48 at most
        .filter(F.size("tokens") >= MATCHES)
        .select("doc_id", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))).alias("t"))
        .select("doc_id", F.col("t.token").alias("token"))
    )
    return lists


def _common_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)


def _differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _alike(a: str, b: str) -> Column:
    """Could the sets of these nodes (structs of n, lost, bitmap, sketch) reach the share? First by size, then by sketch."""

    def of(name: str, field: str) -> Column:
        return F.col(f"{name}.{field}")

    least, most = F.least(of(a, "n"), of(b, "n")), F.greatest(of(a, "n"), of(b, "n"))
    common = _common_bits(of(a, "bitmap"), of(b, "bitmap")) + F.least(of(a, "lost"), of(b, "lost"))
    enough = common * (SHARE[0] + SHARE[1]) >= (of(a, "n") + of(b, "n")) * SHARE[0]
    near = _differing_bits(of(a, "sketch"), of(b, "sketch")) <= SKETCH_MOST
    fine = F.when(of(a, "bitmap").isNotNull() & of(b, "bitmap").isNotNull(), enough).otherwise(near)
    return (least * SHARE[1] >= most * SHARE[0]) & fine


def alike(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sizes and sketches allow a link."""

    def side(name: str) -> DataFrame:
        return sketched.select(F.col("doc_id").alias(name), F.col("fine").alias(f"f_{name}"))

    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(_alike("f_a", "f_b")).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets agree enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    either = F.size("x") + F.size("y") - F.col("common")
    return (
        both.withColumn("common", common).filter(F.col("common") * SHARE[1] >= either * SHARE[0]).select("a", "b")
    )


def _centred(lists: DataFrame) -> DataFrame:
    """Each document of a list with the list's centre, the first by the hash of its id: alike lists share it."""
    centre = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("centre"))).alias("c"))
    return (
        lists.join(centre.select("token", "c.centre"), "token")
        .filter("doc_id <> centre")
        .select(F.greatest("doc_id", "centre").alias("a"), F.least("doc_id", "centre").alias("b"))
    )


def _open_lists(lists: DataFrame, sketched: DataFrame) -> DataFrame:
    """The postings of lists with several components: with sketch, all such lists of the node, and the list's largest component."""
    held = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = (
        held.groupBy("token")
        .agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("components"))
        .filter("components > 1")
        .select("token", F.col("m.component").alias("main"))
    )
    return (
        lists.join(largest, "token")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("token", "main")).alias("held"), F.first("component").alias("component"))  # 48 at most
        .join(sketched, "doc_id")
        .select("doc_id", "component", "fine", F.col("held.token").alias("tokens"), F.explode("held").alias("t"))
        .select("*", F.col("t.token").alias("token"), F.col("t.main").alias("main"))
        .drop("t")
    )


def _centred_again(open_: DataFrame) -> DataFrame:
    """Pairs of each node and a centre drawn anew for every list, if components, sizes and sketches allow a link."""
    first = F.struct(F.xxhash64("token", "doc_id"), "doc_id", "component", "fine")
    centre = open_.groupBy("token").agg(F.min(first).alias("c")).select(
        "token", F.col("c.doc_id").alias("x"), F.col("c.component").alias("cx"), F.col("c.fine").alias("fx")
    )
    return (
        open_.select("token", "doc_id", "component", "fine")
        .join(centre, "token")
        .filter((F.col("cx") != F.col("component")) & _alike("fx", "fine"))
        .select(F.greatest("x", "doc_id").alias("a"), F.least("x", "doc_id").alias("b"))
        .distinct()
    )


def _rest(open_: DataFrame) -> DataFrame:
    """Pairs of different components in one list whose sizes and sketches allow a link.

    At least one node of a pair is outside its list's largest component. A pair that meets
    in several lists comes from the first of them only.
    """
    rows = open_.withColumn("few", F.col("component") != F.col("main"))
    few = rows.filter("few").select(
        "token", F.col("doc_id").alias("x"), F.col("component").alias("cx"), F.col("fine").alias("fx"), F.col("tokens").alias("tx"),
    )
    return (
        few.join(rows, "token")
        .filter(
            (F.col("cx") != F.col("component"))
            & (~F.col("few") | (F.col("x") < F.col("doc_id")))
            & _alike("fx", "fine")
            & (F.array_min(F.array_intersect("tx", "tokens")) == F.col("token"))
        )
        .select(F.greatest("x", "doc_id").alias("a"), F.least("x", "doc_id").alias("b"))
    )


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links between documents."""

    def named(frame: DataFrame, name: str) -> DataFrame:
        other = components.select(F.col("id").alias(name), F.col("component").alias("c"))
        return frame.join(other, name, "left").withColumn(name, F.coalesce("c", name)).drop("c")

    grown = cut_lineage(connected_components(named(named(links, "a"), "b")))
    known = components.join(grown.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left").select(
        "id", F.coalesce("c", "component").alias("component")
    )
    # A document that was alone until now is its own component's name.
    return cut_lineage(known.union(grown.join(components, "id", "left_anti").select("id", "component")))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per input row: doc_id, words_key, n_shingles, component_id."""
    signed = cut_lineage(signatures(docs, doc_id, text))
    filled = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # The number is given once, as the table is written. An id that stands for two texts is two nodes.
    classes = cut_lineage(
        filled.groupBy("words_key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    posted = prefix_postings(classes.select(F.col("node").alias("doc_id"), "signature"))
    crowded = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    lists = cut_lineage(posted.join(crowded, "token", "left_semi"))
    met = cut_lineage(
        classes.select("node", "doc_id", "words_key").join(lists.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    )
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    read = map_batches(
        source.join(met.select("doc_id").distinct(), "doc_id", "left_semi"), _sets,
        "doc_id bigint, words_key binary, shingles array<bigint>, bitmap array<bigint>, sketch array<bigint>",
    )
    sets = cut_lineage(read.join(met, ["doc_id", "words_key"]).dropDuplicates(["doc_id", "words_key"]).select(
        F.col("node").alias("doc_id"), "shingles", "bitmap", "sketch"
    ))
    ones = F.aggregate("bitmap", F.lit(0), lambda n, x: n + F.bit_count(x))
    n = F.size("shingles")
    sketched = cut_lineage(sets.select("doc_id", F.struct(n.alias("n"), (n - ones).alias("lost"), "bitmap", "sketch").alias("fine")))
    links = confirm(alike(_centred(lists), sketched), sets)
    components = cut_lineage(connected_components(links))
    for step in range(2):
        placed = lists.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id")
        )
        open_ = _open_lists(placed, sketched)
        components = _joined(components, confirm(_rest(open_) if step else _centred_again(open_), sets))
    linked = classes.select("words_key", "doc_id", F.col("node").alias("id")).join(components, "id")
    first = linked.groupBy("component").agg(F.min("doc_id").alias("linked_id"))
    merged = classes.select("words_key", F.col("doc_id").alias("least")).join(
        linked.select("words_key", "component").join(first, "component"), "words_key", "left"
    ).select("words_key", F.coalesce("linked_id", "least").alias("component_id"))
    return signed.select("doc_id", "words_key", "n_shingles").join(merged, "words_key", "left").select(
        "doc_id", "words_key", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null texts count as empty; texts without words link with nothing and stay; texts of any length
    are read whole. Rows without doc_id link with nothing, have no component and stay. Rows that
    repeat a doc_id are judged by their own text. An empty table gives no rows; other columns are
    not read.
    """
    return _rows(docs, doc_id, text).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns, whatever their names.

    Null and empty texts and rows without doc_id stay. Of rows that repeat a doc_id those go whose
    text belongs to a component with a smaller one. An empty table stays empty.
    """
    gone = _rows(docs, doc_id, text).filter("doc_id <> component_id").select(F.col("doc_id").alias("id"), "words_key").distinct()
    of, key = fresh(docs, "id"), fresh(docs, "key")
    keyed = docs.withColumn(of, F.col(doc_id).cast("bigint")).withColumn(key, words_key_of(text))
    return keyed.join(gone.select(F.col("id").alias(of), F.col("words_key").alias(key)), [of, key], "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
