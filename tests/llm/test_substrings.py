"""Repeated passages against a plain count of all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sundown.llm import substrings as s
from sundown.llm.substring_plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, size=35):
    """{row place: (doc_id, n_words, n_removed, kept words)}"""
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def digests(rows):
    return sorted(((d or 0), n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in rows)


def rows_of(frame):
    return sorted(((r["doc_id"] or 0), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 2)), min_size=1, max_size=8), st.integers(1, 9))
def test_index_counts_windows(segments, size):
    words = [np.array(x) for x, _ in segments]
    index = s.FmIndex(words, np.array([w for _, w in segments]))
    counts = Counter()
    for x, w in segments:
        for i in range(len(x) - size + 1):
            counts[tuple(x[i : i + size])] += w
    found = index.repeated(size)
    for (x, _), start in zip(segments, index.starts, strict=True):
        for i in range(len(x) - size + 1):
            assert found[start + i] == (counts[tuple(x[i : i + size])] > 1)


def test_backward_search_counts_any_pattern():
    rng = np.random.default_rng(2)
    segments = [rng.integers(1, 6, n) for n in (50, 1, 80, 30)]
    index = s.FmIndex(segments, np.array([1, 1, 1, 1]))
    for length in range(1, 7):
        for _ in range(30):
            pattern = rng.integers(1, 6, length)
            low, high = np.array([0]), np.array([len(index.text)])
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            expected = sum((x[i : i + length] == pattern).all() for x in segments for i in range(len(x) - length + 1))
            assert high[0] - low[0] == expected == index.weight[high[0]] - index.weight[low[0]]


def made(seed, size):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    passages = [[word() for _ in range(draw.randrange(size // 2, 3 * size))] for _ in range(5)]
    rows = []
    for i in range(90):
        words = [word() for _ in range(draw.randrange(3 * size))]
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = draw.choice(passages)
        if i % 9 == 0:
            words += ["again"] * draw.randrange(3 * size)
        if i % 11 == 0:
            words = words + words
        rows.append((i, draw.choice([" ", "\n", "  \t"]).join(words)))
    rows += rows[:4] + [(500, None), (501, ""), (502, " \n "), (None, rows[5][1]), (503, "ünï " * 2 * size), (3, rows[7][1])]
    return rows


@pytest.mark.parametrize(("size", "gram", "shard", "hot"), [(35, 8, 1 << 22, 1 << 20), (6, 3, 2_000, 1 << 20), (6, 3, 2_000, 60), (8, 8, 500, 0)])
def test_equals_plain_version(spark, make, size, gram, shard, hot):
    rows = made(size, size)
    frame = make("doc_id long, text string, key string, anchor int, copies int", *[(*r, "k", 1, 1) for r in rows])
    got = s.remove_repeats(frame, words=size, gram=gram, shard_bytes=shard, hot_bytes=hot)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = plain(rows, size)
    assert rows_of(got) == digests(expected) and any(r for _, _, r, _ in expected) and not all(r for _, _, r, _ in expected)


def test_query_equals_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_substring_dedup"](spark, SF)) == digests(plain(rows))


def test_cleaned_texts_keep_what_loses_nothing(spark, make):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one\n{passage} two"), (2, f"{passage}  three"), (3, "left  as it\nis"), (4, None)]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in s.cleaned_texts(make("doc_id long, text string", *rows)).collect()}
    assert got == {1: (40, "one two"), 2: (40, "three"), 3: (0, "left  as it\nis"), 4: (0, None)}


def test_very_long_periodic_text_and_an_empty_table(spark, make):
    rows = [(1, "a b c " * 20_000), (2, " ".join(f"u{i}" for i in range(60_000)))]
    assert rows_of(s.remove_repeats(make("doc_id long, text string", *rows))) == digests(plain(rows))
    assert rows_of(s.remove_repeats(make("doc_id long, text string"))) == []


def test_index_looks_up_seeds_and_steps_on_from_matches_only(monkeypatch):
    steps, rounds = [], []
    extend = s.FmIndex.extend

    def counted(self, symbols, low, high):
        steps.append(len(symbols))
        rounds.append(1)
        return extend(self, symbols, low, high)

    monkeypatch.setattr(s.FmIndex, "extend", counted)
    alone = [np.arange(1 + 300 * k, 301 + 300 * k) for k in range(20)]
    assert not s.FmIndex(alone, np.ones(20, np.int64), 16).repeated(35).any() and sum(steps) == 0
    steps.clear(), rounds.clear()
    long = np.random.default_rng(3).integers(1, 1_000_000, 1_000)
    numbered = np.unique(long, return_inverse=True)[1] + 1
    found = s.FmIndex([numbered, numbered[:500]], np.array([1, 1]), 16).repeated(35)
    assert found[:466].all() and not found[466:1001].any() and found[1001:1467].all() and sum(rounds) < 2 * (s.STRETCH + 35)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=150), st.integers(1, 2)), min_size=1, max_size=6), st.integers(1, 9), st.integers(1, 9))
def test_seeded_index_counts_windows(segments, seed, more):
    size = seed + more - 1
    words = [np.array(x) for x, _ in segments]
    index = s.FmIndex(words, np.array([w for _, w in segments]), seed)
    counts = Counter()
    for x, w in segments:
        for i in range(len(x) - size + 1):
            counts[tuple(x[i : i + size])] += w
    found = index.repeated(size)
    for (x, _), start in zip(segments, index.starts, strict=True):
        for i in range(len(x) - size + 1):
            assert found[start + i] == (counts[tuple(x[i : i + size])] > 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=20).filter(lambda w: len(w.split()) == 1 and w.split()[0] == w), min_size=4, max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_segments_of_texts_found_together_are_those_of_each(texts, size):
    def found(texts):
        words = s.Words([b" ".join(t) for t in texts])
        anchors, grams = s.anchors(words, size, 1)
        text, first, many = s.segments_of(anchors, words.texts, size)
        places = s.anchor_repeats(grams, size, first, many)
        return [(t, f - words.texts[t], m, a, p) for t, f, m, a, p in zip(text, first, many, anchors[first], places, strict=True)]

    assert found(texts) == [(i, *row[1:]) for i, t in enumerate(texts) for row in found([t])]


def test_words_hash_by_all_their_bytes():
    texts = [b"a b a\x00 " + b"x" * 300 + b" " + b"x" * 299 + b"y", b"b a " + b"x" * 300, b"12345678 123456789 12345678\x00"]
    words = s.Words(texts)
    plain_words = b" ".join(texts).split(b" ")
    hashed = words.hashes().tolist()
    assert len({*hashed}) == len({*plain_words}) == len({*zip(plain_words, hashed, strict=True)})
    assert words.span(3, 5) == b" ".join(plain_words[3:5]) and words.texts.tolist() == [0, 5, 8, 11]
    assert s.least(np.array([3, 1, 2, 5, 4, 6, 0]), 3).tolist() == [1, 1, 2, 4, 0]


def test_words_of_equal_segments_are_fetched_once(spark, make, monkeypatch):
    written = []
    cut = s.cut_lineage

    def counted(frame, *more):
        out = cut(frame, *more)
        if "content" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(s, "cut_lineage", counted)
    text = " ".join(f"p{i}" for i in range(200))
    got = s.remove_repeats(make("doc_id long, text string", *[(i, text) for i in range(20)]))
    assert {(r["n_words"], r["n_removed"]) for r in got.collect()} == {(200, 200)}
    words = s.Words([text.encode()])
    assert sum(written) == len(s.segments_of(s.anchors(words, 35, 8)[0], words.texts, 35)[0])
