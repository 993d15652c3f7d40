"""Toxicity by a counterfactually regularised sparse logistic classifier.

Features say which words a text holds, and with which four and five letters they begin, so that
inflected forms count too. Every labelled text that mentions a group is paired with the same text
after its identity terms were swapped for others of their kind; differences of the two scores are
penalised, so a group's name alone can't carry weight. An L1 penalty leaves the few features
that matter, which keeps very long texts from adding up noise. A second fit on these alone undoes
the shrinkage.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.llm.common import map_batches, raw_text
from sundown.llm.quality import labelled_sample, within

SAMPLE_ROWS = 6_000  # labelled rows used for fitting, each with its whole text
SAMPLE_FEATURES = 12_000_000  # of the rows together: beyond it fewer rows are used
LEAST_ROWS = 4  # a feature must occur in so many sampled rows
LEAST_LEAN = 4.0  # and differ so many standard deviations from the labels' share
SPARSITY = 1e-4
RIDGE = 2e-5
PAIR_PENALTY = 1.0

#: Terms that swap with each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("blind", "deaf", "disabled", "autistic"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {
    term.encode(): tuple(other.encode() for other in terms if other != term) for terms in IDENTITY_TERMS for term in terms
}
_EDGES = b".,;:!?\"'()[]{}<>*_-"


def distinct_words(text: bytes) -> set[bytes]:
    return {w.strip(_EDGES) for w in set(text.lower().split())}


def features(word: bytes) -> tuple[int, ...]:
    """The word and its beginnings of four and five letters as 64-bit hashes."""
    if not word:
        return ()
    letters = word.decode("utf-8", "replace")
    starts = [f"{n}:{letters[:n]}" for n in (4, 5) if len(letters) >= n]
    return tuple(xxhash.xxh3_64_intdigest(s) for s in (f"w:{letters}", *starts))


def feature_set(words: Iterable[bytes]) -> set[int]:
    return {f for w in words for f in features(w)}


def counterfactual(words: set[bytes]) -> set[bytes] | None:
    """The words after every identity term was swapped for another of its kind; None if there is none."""
    terms = words & _SWAP.keys()
    if not terms:
        return None
    choice = xxhash.xxh3_64_intdigest(b" ".join(sorted(terms)))
    return (words - terms) | {_SWAP[t][choice % len(_SWAP[t])] for t in terms}


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[int, float]

    def score(self, active: Iterable[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + math.fsum(self.weights[f] for f in active), -30, 30))))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.count, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.count)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, e[self.row], self.width)


def _solve(x: _Rows, y: np.ndarray, plus: _Rows, minus: _Rows, sparsity: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the last weight is the bias. ``plus`` and ``minus`` hold the features a swap adds and removes."""
    n, width = max(1, x.count), x.width
    w = np.zeros(width + 1)
    share = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
    w[-1] = np.log(share / (1 - share))
    ahead, momentum = w.copy(), 1.0
    # Largest curvature by power iteration, from a start that no pair's difference is orthogonal to.
    v = np.random.default_rng(9).random(width + 1)
    v /= np.linalg.norm(v)
    top = 1.0
    for _ in range(30):
        s = x.times(v[:-1]) + v[-1]
        after = np.append(x.back(s), s.sum()) / (4 * n)
        if plus.count:
            d = plus.times(v[:-1]) - minus.times(v[:-1])
            after[:-1] += 2 * PAIR_PENALTY * (plus.back(d) - minus.back(d)) / plus.count
        top = max(float(np.linalg.norm(after)), 1e-9)
        v = after / top
    rate = 1 / (1.3 * top + ridge)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x.times(ahead[:-1]) + ahead[-1], -30, 30))) - y
        grad = np.append(x.back(error) / n + ridge * ahead[:-1], error.sum() / n)
        if plus.count:
            d = plus.times(ahead[:-1]) - minus.times(ahead[:-1])
            grad[:-1] += 2 * PAIR_PENALTY * (plus.back(d) - minus.back(d)) / plus.count
        new = ahead - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * sparsity, 0)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w[:-1], float(w[-1])


def _columns(hashes: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    return place[names[place] == hashes]


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> ToxicityModel:
    """``rows``: the feature hashes of each text; ``pairs``: hashes that a swap adds and removes."""
    found, counts = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_counts=True)
    found, counts = found[counts >= LEAST_ROWS], counts[counts >= LEAST_ROWS]
    # A feature that the labels don't lean on by chance's standards needs no weight.
    hits = np.zeros(len(found))
    for r, y in zip(rows, labels):
        if y > 0.5:
            hits[_columns(r, found)] += 1
    share = float(labels.mean()) if len(labels) else 0.0
    lean = np.abs(hits - counts * share) / np.sqrt(np.maximum(counts * share * (1 - share), 1e-9))
    found = found[lean >= LEAST_LEAN]
    swapped = np.unique(np.concatenate([*(h for pair in pairs for h in pair), np.empty(0, np.uint64)]))
    found = np.union1d(found, swapped)

    def solve(names: np.ndarray, sparsity: float, steps: int) -> tuple[np.ndarray, float]:
        x = _Rows([_columns(r, names) for r in rows], len(names))
        plus = _Rows([_columns(a, names) for a, _ in pairs], len(names))
        minus = _Rows([_columns(b, names) for _, b in pairs], len(names))
        return _solve(x, labels, plus, minus, sparsity, RIDGE, steps)

    w, _ = solve(found, SPARSITY, 300)
    kept = found[np.abs(w) > 1e-6]
    w, bias = solve(kept, 0.0, 1000)
    return ToxicityModel(bias, {int(h): float(v) for h, v in zip(kept, w)})


def _sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, added, removed = [], [], []
    for text in batch.column("text").to_pylist():
        words = distinct_words(text)
        have = feature_set(words)
        other = counterfactual(words)
        after = feature_set(other) if other is not None else have
        rows.append(np.array(sorted(have), np.uint64).tobytes())
        added.append(np.array(sorted(after - have), np.uint64).tobytes())
        removed.append(np.array(sorted(have - after), np.uint64).tobytes())
    binary = pa.binary()
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("label"), pa.array(rows, binary), pa.array(added, binary), pa.array(removed, binary)],
        ["doc_id", "label", "features", "added", "removed"],
    )


def train(
    docs: DataFrame, labels: DataFrame, training: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Fit on whole labelled documents for which ``training`` (over doc_id) holds: at most ``rows``, and ``SAMPLE_FEATURES`` in all."""
    sample = labelled_sample(labels, doc_id, label, training, rows)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    # The sample is bounded by its parameter.
    found = map_batches(
        source.join(F.broadcast(sample), "doc_id"), _sampled,
        "doc_id bigint, label int, features binary, added binary, removed binary",
    )
    held = F.octet_length("features") + F.octet_length("added") + F.octet_length("removed")
    taken = within(found, "features", rows, SAMPLE_FEATURES * 8, held).toPandas()

    def hashes(column: str) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in taken[column]]

    pairs = [(a, b) for a, b in zip(hashes("added"), hashes("removed")) if len(a) or len(b)]
    return fit(hashes("features"), taken["label"].to_numpy(float), pairs)


class _Active(dict):
    """A word's features that have a weight, remembered; starts anew when it grows beyond its bound."""

    BOUND = 500_000

    def __init__(self, weights: dict[int, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = tuple(f for f in features(word.strip(_EDGES)) if f in self.weights)
        return value


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the model's score for no words; null and repeated doc_ids stay as
    they are; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        active = _Active(model.weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = []
            for value in batch.column("text"):
                words = set(value.as_py().lower().split())
                scores.append(model.score({f for found in map(active.__getitem__, words) for f in found}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, score double")
