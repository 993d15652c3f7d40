"""Collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from sundown.llm import collocations as c


def plain(rows, longest=3, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) rows by counting everything."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            ):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[n] for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def made(seed, rows, vocabulary, hot=0):
    draw = random.Random(seed)
    names = [f"W{i}" if i % 3 else f"é{i}" for i in range(vocabulary)]
    texts = []
    for i in range(rows):
        words = []
        for _ in range(draw.randrange(60)):
            words.append(names[min(int(draw.expovariate(0.4)), vocabulary - 1)])
            if hot and draw.random() < hot:
                words += ["the", "same", "phrase"]
            words.append(draw.choice([" ", "\t", "  ", ". ", "\n", "!", " , "]))
        texts.append((draw.choice(["en", "de", None]), " ".join(words) if i % 7 else None))
    return texts


@pytest.mark.parametrize(("group", "frequent", "buffer"), [(4_000_000, 10_000, 2_000_000), (100, 8, 150), (5, 3, 40)])
def test_equals_plain_version_however_the_prefixes_are_grouped(spark, make, monkeypatch, group, frequent, buffer):
    texts = made(3, 120, 14, hot=0.2)
    whole = c.frequent_phrases
    monkeypatch.setattr(c, "frequent_phrases", lambda texts, words, longest, least: whole(texts, words, longest, least, group, frequent))
    monkeypatch.setattr(c, "BUFFER_WORDS", buffer)
    frame = make("lang string, text string, many long, part int, word string", *[(l, t, 1, 1, "x") for l, t in texts])
    assert rows_of(c.collocations(frame)) == plain(texts)


def test_blocks_come_back():
    words = [b"", b"a", "\u00e9t\u00e9".encode(), b"zz"]
    columns, many = [np.array([1, 1, 3]), np.array([0, 2, 1]), np.array([0, 3, 0])], np.array([7, 1, 1 << 40])
    back, again, counts = c.unpack(c.pack(words, columns, many), 3)
    assert [[back[i] for i in col] for col in again] == [[words[i] for i in col] for col in columns] and counts.tolist() == many.tolist()


def test_longer_phrases_and_a_short_list(spark, make):
    texts = made(5, 80, 8)
    frame = make("lang string, text string", *texts)
    assert rows_of(c.collocations(frame, longest=4, least=5, top=7)) == plain(texts, 4, 5, 7)
    assert rows_of(c.collocations(frame, longest=2, least=3)) == plain(texts, 2, 3)


def test_ties_empty_texts_and_an_empty_table(spark, make):
    frame = make("lang string, text string", ("x", ""), (None, None), ("x", " .,; \n"), *[("x", "b c. a b. C D")] * 10)
    assert rows_of(c.collocations(frame)) == plain([("x", "b c. a b. C D")] * 10)
    assert rows_of(c.collocations(make("lang string, text string"))) == []


def test_a_very_long_text(spark, make):
    text = ("alpha beta gamma " * 40_000) + ". " + "x" * 100_000
    assert rows_of(c.collocations(make("lang string, text string", ("en", text), ("en", text)))) == plain([("en", text)] * 2)


def test_suffix_counts_with_many_words():
    numbers = np.array([5, 6, 7, 0, 5, 6, 0, 5, 6, 7, 0], np.int64)
    few, many = c.count_suffixes(numbers, 3, 8)
    wide, same = c.count_suffixes(numbers, 3, 1 << 31)
    expected = {(5, 6, 7): 2, (6, 7, 0): 2, (7, 0, 0): 2, (5, 6, 0): 1, (6, 0, 0): 1}
    assert {tuple(map(int, k)): int(n) for *k, n in zip(*few, many, strict=True)} == expected
    assert {tuple(map(int, k)): int(n) for *k, n in zip(*wide, same, strict=True)} == expected
