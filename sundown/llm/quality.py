"""Quality of texts by attention over passages (multiple-instance learning).

Every passage of 64 words is encoded as a vector of shares: classes of bytes, lengths of words,
repetition. A gated attention layer, learned from labels of whole documents alone, weighs the
passages; the document's score is that of the weighted representation. Encoding and scoring
run where the rows are; fitting takes a bounded sample of labelled rows with their whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundown.llm.common import fresh, map_batches, raw_text
from sundown.session import cut_lineage

PASSAGE_WORDS = 64
SAMPLE_ROWS = 6_000  # labelled rows used for fitting, each with its whole text
SAMPLE_PASSAGES = 300_000  # of the rows together: beyond it fewer rows are used
HIDDEN = 24
EPOCHS = 60

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LONGEST = 16


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)  # 0: everything else, such as control characters
    for i, byte in enumerate(_PUNCTUATION):
        table[byte] = i + 1
    after = len(_PUNCTUATION) + 1
    table[ord("0") : ord("9") + 1] = after
    table[ord("A") : ord("Z") + 1] = after + 1
    table[ord("a") : ord("z") + 1] = after + 2
    table[128:192] = after + 3
    table[192:] = after + 4
    table[32] = after + 5
    return table


_CLASSES = _byte_classes()
_CLASS_COUNT = int(_CLASSES.max()) + 1
#: byte classes, lengths of words, and six figures on repetition and size
WIDTH = _CLASS_COUNT + _LONGEST + 6


def encode(text: bytes) -> np.ndarray:
    """One row of ``WIDTH`` features per passage; a text without words is one row of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    count = len(words)
    starts = np.arange(0, count, PASSAGE_WORDS)
    passages = len(starts)
    lengths = np.fromiter(map(len, words), np.int64, count)
    sizes = np.add.reduceat(lengths + 1, starts)
    codes = _CLASSES[np.frombuffer(b" ".join(words) + b" ", np.uint8)]
    passage_of_byte = np.repeat(np.arange(passages), sizes)
    shares = np.bincount(passage_of_byte * _CLASS_COUNT + codes, minlength=passages * _CLASS_COUNT)
    shares = shares.reshape(passages, _CLASS_COUNT) / sizes[:, None]
    held = np.diff(np.append(starts, count))
    passage_of_word = np.repeat(np.arange(passages), held)
    spread = np.bincount(
        passage_of_word * _LONGEST + np.minimum(lengths, _LONGEST) - 1, minlength=passages * _LONGEST
    ).reshape(passages, _LONGEST) / held[:, None]
    rest = np.empty((passages, 6))
    rest[:, 0] = [len(set(words[s : s + PASSAGE_WORDS])) for s in starts.tolist()]
    rest[:, 0] /= held
    repeats = np.fromiter((a == b for a, b in zip(words, words[1:])), np.float64, count - 1) if count > 1 else np.zeros(0)
    rest[:, 1] = np.add.reduceat(np.append(repeats, 0.0), starts) / held
    rest[:, 2] = len(set(words)) / count
    rest[:, 3] = np.log1p(count) / 10
    rest[:, 4] = held / PASSAGE_WORDS
    rest[:, 5] = text.count(b"\n") / count
    return np.concatenate([shares, spread, rest], axis=1).astype(np.float32)


@dataclass
class AttentionModel:
    """tanh(x W + b) passages, softmax over v . (tanh(h A) * sigmoid(h G)), logistic score of the weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the bags that begin at ``starts`` in the passages ``x``; a bag's is the same in whatever company."""
        weights = {k: v.astype(np.float64) for k, v in self.weights.items()}
        scaled = (x.astype(np.float64) - self.mean) / self.scale
        return _forward(weights, scaled, starts, _row_by_row)["p"]


def _row_by_row(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, summed for every row in the same order, which a library's product doesn't promise."""
    out = x[:, :1] * w[0]
    for k in range(1, len(w)):
        out += x[:, k : k + 1] * w[k]
    return out if w.ndim > 1 else out[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(
    w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.matmul
) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(product(x, w["W"]) + w["b"])
    t, g = np.tanh(product(h, w["A"])), _sigmoid(product(h, w["G"]))
    e = product(t * g, w["v"])
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(product(z, w["c"]) + w["d"])}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    error = (f["p"] - y) / len(y)
    dz = error[:, None] * w["c"]
    along = np.einsum("ij,ij->i", dz[bag], h)
    de = a * (along - np.add.reduceat(a * along, starts)[bag])
    dt, dg = de[:, None] * w["v"] * g * (1 - t * t), de[:, None] * w["v"] * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["A"].T + dg @ w["G"].T
    du = dh * (1 - h * h)
    return {
        "W": x.T @ du, "b": du.sum(0), "A": h.T @ dt, "G": h.T @ dg, "v": (t * g).T @ de,
        "c": f["z"].T @ error, "d": error.sum(keepdims=True),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> AttentionModel:
    """Adam over mini-batches of whole documents; without two classes the score is the labels' mean."""
    rng = np.random.default_rng(seed)
    width = WIDTH

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    w = {
        "W": start(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "A": start(HIDDEN, HIDDEN), "G": start(HIDDEN, HIDDEN),
        "v": start(HIDDEN), "c": start(HIDDEN), "d": np.zeros(1, np.float32),
    }
    if len(bags) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        w["c"][:] = 0
        w["d"][:] = np.log((share + 0.01) / (1.01 - share))
        return AttentionModel(np.zeros(width, np.float32), np.ones(width, np.float32), w)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    first, second, step = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2)), None, 0
    first, second = first
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for begin in range(0, len(order), 256):
            chosen = order[begin : begin + 256]
            x = np.concatenate([bags[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])[:-1]])
            step += 1
            for k, grad in _gradient(w, x, starts, labels[chosen]).items():
                grad = grad + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return AttentionModel(mean.astype(np.float32), scale.astype(np.float32), w)


def remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(labels: DataFrame, doc_id: str, label: str, training: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, the first in a hashed order, each with one label."""
    return (
        labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .filter(training)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
        .limit(rows)
    )


def within(found: DataFrame, column: str, rows: int, most: int, held: Column | None = None) -> DataFrame:
    """The first rows in a hashed order, at most ``rows`` and at most ``most`` bytes together (by default of ``column``).

    Whole rows only; a row that alone takes a sixteenth of the bytes is not sampled.
    """
    order = [F.xxhash64("doc_id", F.lit(13)), F.col("doc_id"), F.col(column)]
    landed = cut_lineage(found)
    # One task orders the sample's sizes, ``rows`` at most, not its contents.
    sizes = landed.select("doc_id", (F.octet_length(column) if held is None else held).cast("bigint").alias("bytes"), F.sha2(column, 256).alias("content"))
    first = sizes.filter(F.col("bytes") * 16 <= most).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "content").limit(rows)
    before = W.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "content").rowsBetween(W.unboundedPreceding, 0)
    taken = first.withColumn("sum", F.sum("bytes").over(before)).filter(F.col("sum") <= most)
    kept = landed.withColumn("content", F.sha2(column, 256)).join(taken, ["doc_id", "content"], "left_semi")
    return kept.drop("content").orderBy(*order).limit(rows)


def _encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text in batch.column("text").to_pylist():
        out.append(encode(text).tobytes())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "passages"]
    )


def train(
    docs: DataFrame, labels: DataFrame, training: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = SAMPLE_ROWS,
) -> AttentionModel:
    """Fit on whole labelled documents for which ``training`` (over doc_id) holds: at most ``rows``, and ``SAMPLE_PASSAGES`` in all."""
    sample = labelled_sample(labels, doc_id, label, training, rows)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    # The sample is bounded by its parameter.
    found = map_batches(source.join(F.broadcast(sample), "doc_id"), _encoded, "doc_id bigint, label int, passages binary")
    taken = within(found, "passages", rows, SAMPLE_PASSAGES * WIDTH * 4).toPandas()
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in taken["passages"]]
    return fit(bags, taken["label"].to_numpy(np.float32))


def scorer(model: AttentionModel, column: str = "_text", name: str = "score"):
    """Batches with one more column, the score; the column that was scored goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(column)
            scores = np.empty(batch.num_rows)
            bags: list[np.ndarray] = []
            begin = 0

            def flush(end: int) -> None:
                starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]).astype(np.int64)
                scores[begin:end] = model.score(np.concatenate(bags), starts)

            held = 0
            for i in range(batch.num_rows):
                bags.append(encode(texts[i].as_py()))
                held += len(bags[-1])
                if held >= 4096 or i == batch.num_rows - 1:
                    flush(i + 1)
                    bags, begin, held = [], i + 1, 0
            kept = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(scores)], [*kept, name])

    return run


def score(docs: DataFrame, model: AttentionModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts are one passage of zeros; null and repeated doc_ids stay as they are;
    an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("_text"))
    return source.mapInArrow(scorer(model), "doc_id bigint, score double")


def keep_likely(docs: DataFrame, model: AttentionModel, border: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``border``, with all their columns; nothing is shuffled."""
    scored, raw = fresh(docs, "score"), fresh(docs, "raw_text")
    schema = T.StructType([*docs.schema.fields, T.StructField(scored, T.DoubleType())])
    rows = docs.withColumn(raw, raw_text(text)).mapInArrow(scorer(model, raw, scored), schema)
    return rows.filter(F.col(scored) >= border).select(*docs.columns)
