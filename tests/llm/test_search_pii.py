import random
import time

import numpy as np
import pytest

from sundown.llm import pii, top_k
from sundown.llm.search_plans import QUERIES


def plain_top(vectors, queries, k):
    good = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in queries:
        if q in good:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_top_k_equals_brute_force(spark, make, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 40)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + 0.2 * rng.normal(size=6)]) for i in range(150)]
    rows += [(i, rows[i % 3][1]) for i in range(150, 190)]  # ties
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6), (280, []), (300, [1.0, 2.0])]
    frame = make("vec_id bigint, embedding array<float>, id string", *[(i, v, "x") for i, v in rows], (None, rows[0][1], "x"), (7, rows[7][1], "x"))
    found = {}
    for r in top_k.top_k(frame, frame.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = {q: v for q, v in plain_top(rows, [i for i, _ in rows if i % 20 == 0], 20).items() if v}
    assert found == want
    assert top_k.top_k(frame.filter("false"), frame.filter("false"), 20).count() == 0


def test_bound_eliminates_most_candidates():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 60
    vectors = np.floor(centres[np.arange(2000) % 20] + rng.normal(size=(2000, 16)) * 2).astype(np.int64)
    pivots = top_k.choose_pivots(vectors)
    table = top_k._distances(vectors, pivots)
    found, evaluated = top_k.search_block(
        vectors[:20], np.arange(20), table[:20], np.full(20, np.nan), vectors, np.arange(2000), table, 10
    )
    assert evaluated < 20 * 2000 / 2
    for q in range(20):
        scores = vectors @ vectors[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [(-s, i) for qq, i, s in found if qq == q] == want


class Counted(np.ndarray):
    """Counts products."""

    calls = 0

    def __matmul__(self, other):
        Counted.calls += 1
        return np.asarray(self) @ np.asarray(other)


def test_queries_that_no_bound_helps_are_evaluated_together():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (4000, 64))
    table = top_k._distances(vectors, top_k.choose_pivots(vectors[:500]))
    ids, counted = np.arange(4000), vectors.view(Counted)
    found, _ = top_k.search_block(counted[:200], ids[:200], table[:200], np.full(200, 20_000.0), counted, ids, table, 20)
    assert 0 < Counted.calls <= 20
    for q in range(0, 200, 33):
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q and s >= 20_000)[:20]
        assert [(-s, i) for qq, i, s in found if qq == q] == want


def test_scores_beyond_exact_doubles():
    vectors = np.array([[1 << 30, 3], [(1 << 30) + 1, 5], [1 << 30, 4], [-7, 1]] + [[i, 0] for i in range(600)], np.int64)
    table = top_k._distances(vectors, top_k.choose_pivots(vectors, 1))
    found, _ = top_k.search_block(vectors[:3], np.arange(3), table[:3], np.full(3, np.nan), vectors, np.arange(604), table, 2)
    for q in range(3):
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q)[:2]
        assert [(-s, i) for qq, i, s in found if qq == q] == want


KEY = b"test key"
TEXT = "Herr Schmidt (bob.Smith9@mail.example.com) rang +1 (663) 555-6869 from 10.2.3.4, card 4111 1111 1111 1111, token = \"1eb9c0ff12\". Frau Schmidt und Госп"


def test_entities_and_forms():
    kinds = {(k, o): d for _, _, k, d, o in pii.find_entities(TEXT)}
    assert set(kinds) == {
        ("name", "Schmidt"), ("email", "bob.Smith9@mail.example.com"), ("phone", "+1 (663) 555-6869"), ("ip", "10.2.3.4"),
        ("card", "4111 1111 1111 1111"), ("secret", "1eb9c0ff12"),
    }
    for start, end, kind, detail, original in pii.find_entities(TEXT):
        assert TEXT[start:end] == original
        made = pii.surrogate(kind, detail, original, KEY, 0)
        assert made != original and made == pii.surrogate(kind, detail, original, KEY, 0) != pii.surrogate(kind, detail, original, b"other", 0)
        assert kind == "name" or [k for _, _, k, _, _ in pii.find_entities(f"token = {made} " if kind == "secret" else made)] == [kind]
    card = pii.surrogate("card", "valid", "4111 1111 1111 1111", KEY, 0)
    assert pii.luhn(card.replace(" ", "")) == 0 and card[4] == " " and card[0] == "4"
    assert pii.surrogate("ip", "", "10.2.3.4", KEY, 0).startswith("10.")
    assert set(pii.surrogate("secret", "", "1eb9c0ff12", KEY, 0)) <= set("0123456789abcdef")
    assert pii.surrogate("phone", "", "+1 (663) 555-6869", KEY, 0).startswith("+1 (") and "555-" in pii.surrogate("phone", "", "+1 (663) 555-6869", KEY, 0)
    man, woman = (pii.surrogate("name", g, "Schmidt", KEY, 0).split("-")[0] for g in "mf")
    assert man in pii.NAMES["m", "latin"] and woman in pii.NAMES["f", "latin"]
    assert pii._script(pii.surrogate("name", "f", "Иванова", KEY, 0)) == "cyrillic"


def test_pseudonyms_are_whole_consistent_and_distinct(spark, make):
    docs = make(
        "doc_id bigint, text string, row string", (1, TEXT, "x"), (2, "ask bob.Smith9@mail.example.com or bob.Smith8@mail.example.com", "x"), (3, "nothing", "x"),
        (4, None, "x"), (5, "", "x"), (1, TEXT, "x"), (None, "call +1 (663) 555-6869", "x"), (6, "w " * 50_000 + "1.2.3.4", "x"),
    )
    rows = pii.pseudonymised_documents(docs, KEY).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["text"] == "nothing" and by[4][0]["text"] is None and by[5][0]["n_entities"] == 0
    assert len(by[1]) == 2 and by[1][0]["text"] == by[1][1]["text"] and by[1][0]["n_entities"] == 7
    for original in ("bob.Smith9@", "663) 555-6869", "10.2.3.4", "4111 1111", "1eb9c0ff12", "Schmidt"):
        assert original not in by[1][0]["text"]
    email = [w for w in by[1][0]["text"].split() if "@" in w][0].strip("()")
    others = [w for w in by[2][0]["text"].split() if "@" in w]
    assert others[0] == email != others[1]
    assert by[None][0]["text"].split(" ", 1)[1] in by[1][0]["text"]
    assert by[6][0]["text"].startswith("w " * 50_000) and not by[6][0]["text"].endswith(" 1.2.3.4")
    assert pii.pseudonymised_documents(docs.filter("false"), KEY).count() == 0


def test_collisions_are_drawn_again(spark, make):
    # One digit: nine other surrogates for ten originals, so most draws collide at first.
    entities = make("type string, detail string, original string", *[("ssn", "", f"{i:02d}") for i in range(40)])
    made = {r["original"]: r["surrogate"] for r in pii.assign_surrogates(entities, KEY).collect()}
    assert len(made) == 40 and len(set(made.values())) == 40 and not set(made) & set(made.values())


def replaced(text, key=KEY):
    """The text with the first draw of every entity's surrogate."""
    out, at = [], 0
    for start, end, kind, detail, original in pii.find_entities(text):
        assert text[start:end] == original and start >= at
        out += [text[at:start], pii.surrogate(kind, detail, original, key, 0)]
        at = end
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("length", [12, 70, 240, 5_000, 100_000])
@pytest.mark.parametrize("form", [
    "password = {}", "api_key: '{}'", "Token={}.{}.{}", "see sk_live_{} here", "write to {}@mail.example.com", "at a.b@{}.example.org now", "mail x@one.{}.org",
])
def test_nothing_of_a_long_entity_is_left(form, length):
    drawn = "".join(random.Random(length).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=length))
    text = "Before, " + form.replace("{}", drawn) + ", after"
    assert pii._MARKS.search(text)
    after = replaced(text)
    kept = {drawn[i : i + 8] for i in range(length - 7)}
    domain = "one." in form  # further labels of a domain stay
    assert domain or not any(after[i : i + 8] in kept for i in range(len(after) - 7))
    assert after.startswith("Before, ") and after.endswith(", after") and after != text


def test_long_runs_without_entities_cost_their_length():
    for text in ("a" * 300_000, "a.b-" * 80_000, "1 " * 100_000, "Dr " * 60_000, "token " * 40_000, "@" * 100_000, "A1" * 100_000):
        started = time.perf_counter()
        pii.find_entities(text)
        assert time.perf_counter() - started < 10


def test_all_words_of_a_name_and_cards_in_any_grouping():
    text = "Dr. Jane Doe-Smith and Frau J. Müller paid by 41 11 11 11 11 11 11 11 or 4111-1111-1111-1111."
    assert [(k, o) for _, _, k, _, o in pii.find_entities(text)] == [
        ("name", "Jane"), ("name", "Doe-Smith"), ("name", "J."), ("name", "Müller"), ("card", "41 11 11 11 11 11 11 11"), ("card", "4111-1111-1111-1111")]
    assert pii._MARKS.search("41 11 11 11 11 11 11 11")
    assert pii.find_entities("password: ________") == []


def test_forms_without_a_free_member_end(spark, make):
    entities = make(
        "type string, detail string, original string", ("email", "", "测试@例子.公司"), ("secret", "", "1"), *[("secret", "", str(i)) for i in range(10)],
        *[("ip", "", f"127.0.0.{i}") for i in range(3)], ("key", "", "AKIA__________"), ("secret", "", "ไทย"), ("secret", "", "----a"))
    made = {(r["type"], r["original"]): r["surrogate"] for r in pii.assign_surrogates(entities, KEY).collect()}
    originals = {o for _, o in made}
    assert len(made) == 17 and len(set(made.values())) == 17 and not set(made.values()) & originals
    assert made["email", "测试@例子.公司"].endswith(".公司") and "@" in made["email", "测试@例子.公司"]


def test_query_replaces_every_entity_of_every_row(spark):
    folder = "/root/testdata/sf0.001"
    rows = {(r["doc_id"], r["n_entities"]): r["text"] for r in QUERIES["op10_pii"](spark, folder).collect()}
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(source)
    for r in source:
        found = pii.find_entities(r["text"] or "")
        text = rows[r["doc_id"], len(found)]
        # Plain version: what is left between the entities is untouched and in order.
        at, place = 0, 0
        for start, end, _, _, original in found:
            piece = r["text"][at:start]
            place = text.index(piece, place) + len(piece)
            at = end
            assert not text.startswith(original, place)
        assert text is None if r["text"] is None else text.endswith(r["text"][at:])


def test_top_k_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = plain_top(vectors, [i for i, _ in vectors if i % 20 == 0], 20)
    got = {}
    for r in QUERIES["op4_top_k"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
