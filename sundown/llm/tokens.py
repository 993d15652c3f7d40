"""Token ids of whole texts, and their storage as ORC.

No token of the word tokenizer spans white space, so a text is encoded word by word, each distinct
word once per worker: ids come from the tokenizers library, and a text is a join of remembered
byte strings. Words of letters go through the library's normaliser and byte alphabet to the
vocabulary's model, marks that follow them are looked up apart; all others go through the whole tokenizer.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.llm.common import raw_text
from sundown.session import ensure_checkpoint_dir

END_ID = 1
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII but letters, digits and the apostrophe, which may begin a unit with letters
_PAST_LATIN = "\u0100"  # no character below it is composed with another below it


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """``encoder.encode(text)``: the ids of a text as little-endian unsigned 32-bit integers."""

    BOUND = 200_000  # remembered words; when there are more, they become those ``before``, and the ones before go

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.byte_letters = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.latin = {i: self.byte_letters(chr(i))[0][0] for i in range(128, 256)}
        self.before: dict[bytes, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _unit(self, word: str) -> bytes:
        """Ids of a unit as the byte alphabet writes it."""
        ids = [t.id for t in self.tokenize(word)]
        return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else _packed(ids)

    def _letters(self, word: str) -> bytes | None:
        """Ids of a lower-cased word that is one unit of letters, None if it isn't."""
        if max(word) < _PAST_LATIN and word == word.lower():  # normal; ASCII letters even stand for their own bytes
            return self._unit(word.translate(self.latin))
        word = self.normalise(word)
        return self._unit(self.byte_letters(word)[0][0]) if word.isalpha() else None

    def _encoded(self, word: bytes) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters.isalpha():  # ASCII
            if len(letters) < len(word):  # marks after letters are a unit of their own
                return self[letters] + self[word[len(letters) :]]
            lower = word.lower()
            return self[lower] if lower != word else self._unit(word.decode())
        text = letters.decode("utf-8", "replace")
        ids = None
        if text.isalpha():
            # Case is folded here only where that is the library's way: one letter becomes one letter.
            latin = max(text) < _PAST_LATIN
            if len(letters) < len(word):
                if latin or self.normalise(text).isalpha():
                    return self[letters] + self[word[len(letters) :]]
            else:
                lower = text.lower().encode() if latin else word.lower()
                ids = self[lower] if lower != word else self._letters(text)
        return self._whole(word.decode("utf-8", "replace")) if ids is None else ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(self) >= self.BOUND:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


class FileEncoder(Encoder):
    """For tasks that write token files: their workers hold no other caches, so twice the words are remembered."""

    BOUND = 400_000


_encoders: dict[tuple[str, type[Encoder]], Encoder] = {}


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder of a kind per worker and vocabulary file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = kind(path)
    return _encoders[path, kind]


def crc32_of(ids: np.ndarray | bytes) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, bytes) else np.asarray(ids, "<u4").tobytes())


END = np.array([END_ID], "<u4").tobytes()


def write_token_files(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """ORC files of (doc_id, part, start_in_part, n_tokens, ids) in ascending doc_id order.

    Rows are dealt out by ranges of doc_id and sorted inside a range, so file names and rows are
    ascending; null ids come first, equal ones in the order of their texts. A null text is empty
    and holds the end id alone. Files carry row indexes and Bloom filters on doc_id; integers are
    run-length encoded by the format. An empty table writes an empty file set.
    """
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, FileEncoder).encode
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                ids = [encode(x.as_py()) + END for x in rows.column("text")]
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(counts)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(start + offsets[:-1]), pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    dealt = source.repartitionByRange(slices, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        dealt.mapInArrow(run, "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>")
        .write.option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before.

    Every stripe is read on its own; a file holds its own running starts, so only one sum per
    file is added. A filter on doc_id reaches the stripes' indexes and Bloom filters.
    """
    files = spark.read.schema("doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>").orc(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per file: as many as the writer had slices.
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return files.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def with_crc32(df: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Replace a column of ids (array or bytes) by its CRC-32."""
    others = [c for c in df.columns if c != ids]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            if pa.types.is_list(column.type):
                values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                sums = [crc32_of(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            else:
                sums = [zlib.crc32(x.as_buffer()) for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sums, pa.int64())], [*others, name])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"{name} bigint"]))
