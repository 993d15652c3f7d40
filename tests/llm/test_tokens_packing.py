import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sundown.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)


def ids_of(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé'.,s \n\t<|>endoftextİΣß ́")), max_size=60))
def test_word_by_word_equals_the_whole_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist() == ids_of(text)


def test_special_words():
    for text in ("it's <|endoftext|>x", "don't,stop.", "A.B.", "<|ENDOFTEXT|>", "éÉ.", "x" * 5000, "1,234.5"):
        assert np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist() == ids_of(text)


def test_words_with_marks_and_latin_letters():
    words = ["Straße,", "ÉCOLE!!", "mañana&&&", "µÿß", "don't!", "a_b", "x--", "Σας.", "İ.", "é\u0301,", "e\u0301", "abc<|endoftext|>", "abc<|", "ab\u00d7", "na\u0308.", "9,9.", "K.", "ŉ,", "ſ;"]
    for word in words:
        assert np.frombuffer(ENCODER.encode(word.encode()), "<u4").tolist() == ids_of(word)
    assert np.frombuffer(ENCODER.encode(b"ab\xff,"), "<u4").tolist() == ids_of("ab\ufffd,")


def test_words_with_marks_miss_the_whole_tokenizer_and_common_words_outlive_the_bound(monkeypatch):
    fresh = tokens.Encoder(PATH)
    whole = []
    monkeypatch.setattr(fresh, "_whole", lambda word, real=fresh._whole: whole.append(word) or real(word))
    monkeypatch.setattr(tokens.Encoder, "BOUND", 8)
    for i in range(60):
        letters = chr(97 + i % 26) * (1 + i // 26)
        text = f"same {letters}ño&&& {letters}."
        assert np.frombuffer(fresh.encode(text.encode()), "<u4").tolist() == ids_of(text)
        assert len(fresh) <= 8 and len(fresh.before) <= 8
    assert set(whole) == {"&&&", "."}
    assert b"same" in fresh or b"same" in fresh.before


def test_token_files_are_written_with_the_longer_memory(monkeypatch):
    again = []
    files = tokens.encoder(PATH, tokens.FileEncoder)
    assert files is tokens.encoder(PATH, tokens.FileEncoder) and files is not tokens.encoder(PATH)
    monkeypatch.setattr(tokens.FileEncoder, "BOUND", 60)
    monkeypatch.setattr(files, "tokenize", lambda word, real=files.tokenize: again.append(word) or real(word))
    text = " ".join(f"{chr(97 + i % 26)}q{'z' * (i // 26)}" for i in range(60))
    for _ in range(2):
        assert np.frombuffer(files.encode(text.encode()), "<u4").tolist() == ids_of(text)
    assert len(again) == 60  # what is remembered is not encoded again
    assert tokens.Encoder.BOUND < 400_000  # packing, beside other caches, keeps its own


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_holds_exactly_the_pieces(histogram):
    plan, bound = packing.plan_with_bound(histogram, 64)
    held = {}
    for config, many in plan:
        assert sum(l * k for l, k in config) <= 64 and many > 0
        for l, k in config:
            held[l] = held.get(l, 0) + k * many
    assert held == histogram
    plain = sum(m for _, m in packing._best_fit(histogram, 64))
    assert bound - 1e-6 <= sum(m for _, m in plan) <= plain + 2


def best_number(pieces, capacity):
    """The fewest sequences by trying every way."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_plans_are_near_the_best(pieces):
    histogram = {l: pieces.count(l) for l in pieces}
    plan, bound = packing.plan_with_bound(histogram, 20)
    best = best_number(pieces, 20)
    assert bound <= best + 1e-6 and best <= sum(m for _, m in plan) <= best + 1


@pytest.mark.parametrize(("histogram", "most"), [
    ({1400: 1000, 1300: 1000, 1390: 1000}, 1001),
    ({2049: 600, 1030: 600, 1010: 600, 1000: 600}, 750),
    (dict(zip(*(v.tolist() for v in np.unique(np.random.default_rng(1).integers(1000, 1700, 20_000), return_counts=True)))), 6850),
])
def test_the_program_decides_the_number_of_sequences(histogram, most):
    plan, bound = packing.plan_with_bound(histogram)
    held = {}
    for config, many in plan:
        assert sum(l * k for l, k in config) <= 4096
        for l, k in config:
            held[l] = held.get(l, 0) + k * many
    assert held == histogram
    assert bound - 1e-6 <= sum(m for _, m in plan) <= most


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.floats(0.1, 5), min_size=1, max_size=5))
def test_pricing_is_the_best_configuration(prices):
    lengths = np.array(list(prices))
    sack = packing.Knapsack(lengths, np.array(list(prices.values())), 30)
    chosen = sack.configuration(30)
    best = [0.0] * 31
    for room in range(31):
        best[room] = max([0.0, *(best[room - l] + p for l, p in prices.items() if l <= room)])
    assert sum(lengths[i] * k for i, k in chosen.items()) <= 30
    assert sum(sack.prices[i] * k for i, k in chosen.items()) == pytest.approx(best[30])


TEXTS = [(3, "Some words, here."), (1, None), (2, ""), (9, "long " * 9000), (5, "Some words, here."), (5, "Some words, here."), (None, "nameless")]


def test_packing_round_trip(spark, make):
    docs = make("doc_id bigint, text string, length string", *[(i, t, "x") for i, t in TEXTS])
    rows = packing.pack(docs, PATH).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 4096 and r["start"] == 4096 * r["piece"]
        whole.setdefault(r["doc_id"], []).append(ids)
    assert sum(whole[9], []) == ids_of("long " * 9000) + [1]
    assert whole[5] == [ids_of("Some words, here.") + [1]] * 2 and whole[1] == [[1]] and whole[2] == [[1]]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs.filter("false"), PATH).count() == 0


def test_token_files_round_trip(spark, make, tmp_path):
    docs = make("doc_id bigint, text string, part string", *[(i, t, "x") for i, t in TEXTS])
    tokens.write_token_files(docs, str(tmp_path / "t"), PATH)
    read = tokens.read_token_files(spark, str(tmp_path / "t"))
    rows = sorted(read.collect(), key=lambda r: r["start"])
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [i for i, _ in order]
    at = 0
    for r, (_, text) in zip(rows, order):
        assert list(r["ids"]) == ids_of(text or "") + [1] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    summed = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokens.with_crc32(read).collect()}
    assert all(summed[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in spark.read.orc(str(tmp_path / "t")).filter(
        "doc_id = 9"
    )._jdf.queryExecution().executedPlan().toString()
    tokens.write_token_files(docs.filter("false"), str(tmp_path / "e"), PATH)
    assert tokens.read_token_files(spark, str(tmp_path / "e")).count() == 0
