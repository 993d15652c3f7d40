import numpy as np
from brute import near_components

from sundown.llm import common, exact_dedup, near_dedup
from sundown.llm.common import connected_components

LONG = " ".join(f"w{i}" for i in range(6000))


def words(n, salt="a"):
    return " ".join(f"{salt}{i}" for i in range(n))


def test_borders_cover_the_text_and_follow_content():
    text = (LONG * 4).encode()
    ends = exact_dedup.borders(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) <= exact_dedup.MOST_BYTES and len(sizes) > 5
    moved = exact_dedup.borders(b"something else in front " + text)
    cut = lambda t, e: {t[a:b] for a, b in zip([0, *e], e)}
    common = cut(text, ends) & cut(b"something else in front " + text, moved)
    assert len(common) > len(cut(text, ends)) / 2
    assert exact_dedup.borders(b"") == []


def test_exact_groups(spark, make, got):
    docs = make(
        "doc_id bigint, text string, kept string",
        (4, "a  b\n", "x"), (2, "a b ", "x"), (3, "a b", "x"), (7, LONG, "x"), (5, LONG.replace(" ", "\t"), "x"),
        (9, None, "x"), (8, "", "x"), (1, "A b ", "x"), (2, "a b ", "x"), (None, "a b", "x"), (None, "alone", "x"),
    )
    rows = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(docs).collect()}
    pick = lambda i: [(r["keep_id"], r["group_size"], r["kept"]) for (d, _), r in rows.items() if d == i]
    assert pick(4) == [(2, 3, False)] and pick(2) == [(2, 3, True)]
    assert pick(7) == [(5, 2, False)] and pick(9) == [(8, 2, False)] and pick(1) == [(1, 1, True)]
    assert pick(3) == [(3, 2, True)]
    assert sorted(pick(None), key=str) == [(3, 2, False), (None, 1, True)]
    left = got(exact_dedup.drop_exact_duplicates(docs), "doc_id")
    assert left == sorted([(1,), (2,), (3,), (5,), (8,), (None,)], key=lambda r: (r[0] is not None, str(r[0])))
    assert exact_dedup.exact_duplicates(docs.filter("false")).count() == 0


def test_ambiguous_identifiers_are_settled_by_the_whole_text(spark, make, monkeypatch):
    import sundown.llm.exact_dedup as module

    docs = make("doc_id bigint, text string", (1, "one"), (2, "two"), (3, "one"))
    listed = spark.createDataFrame([(1, [7]), (2, [7]), (3, [7])], "doc_id bigint, recipe array<bigint>")
    real = module.recipes(docs).drop("recipe").join(listed, "doc_id")
    monkeypatch.setattr(module, "recipes", lambda *a, **k: real)
    monkeypatch.setattr(module, "ambiguous_identifiers", lambda *a, **k: spark.createDataFrame([(7,)], "identifier bigint"))
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in module.exact_duplicates(docs).collect()}
    assert rows == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(1, 2), (2, 1), (3, 3)]
    found = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(7, 40)} == {7} and found[2] == 1
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rounds_over_few_edges_shuffle_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(int(x), int(y)) for x, y in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, y in edges:
        if x != y:
            parent[max(top(x), top(y))] = min(top(x), top(y))
    plans = []
    cut = common.cut_small
    monkeypatch.setattr(common, "cut_small", lambda df, rows: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, rows))
    for most in (common.ROWS_A_TASK, 0):  # as one partition, and as many
        monkeypatch.setattr(common, "ROWS_A_TASK", most or 1)
        plans.clear()
        found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert {r["id"]: r["component"] for r in found.collect()} == {n: top(n) for n in parent}
        assert len(plans) > 3 and any("Exchange" in p for p in plans) == (not most)


def test_near_groups_equal_brute_force(spark, make):
    base = words(120).split()
    texts = {
        1: " ".join(base), 2: " ".join(base[:60] + ["new"] + base[60:]), 3: " ".join(base + ["x", "y"]), 4: words(120, "b"),
        5: "a b c", 6: "A b  c", 7: "a b c d", 8: None, 9: "", 10: LONG, 11: LONG + " end", 12: " ".join(base[:90] + words(40, "z").split()),
    }
    # A passage that many short documents share, and copies that differ in one word.
    passage = words(30, "p")
    texts |= {100 + i: f"{passage} {words(25, f'u{i}x')}" for i in range(30)}
    texts |= {200 + i: " ".join([*base[:i], f"edit{i}", *base[i + 1 :]]) for i in range(30)}
    docs = make("doc_id bigint, text string, component string", *[(i, t, "x") for i, t in texts.items()])
    rows = near_dedup.near_duplicates(docs.union(docs.filter("doc_id = 2"))).collect()
    assert len(rows) == len(texts) + 1
    want = near_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_edges(spark, make):
    docs = make("doc_id bigint, text string", (None, words(20)), (1, words(20)), (2, None))
    rows = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert rows == {None: (None, True), 1: (1, True), 2: (2, True)}
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0
    assert near_dedup.drop_near_duplicates(docs).count() == 3


def test_signature_agreement_follows_similarity():
    base = words(400).split()
    a = near_dedup.shingles([w.encode() for w in base])
    b = near_dedup.shingles([w.encode() for w in base[:360] + words(40, "q").split()])
    common = len(set(a.tolist()) & set(b.tolist()))
    share = common / (len(a) + len(b) - common)
    agree = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(agree - share) < 0.25


def test_an_id_with_two_texts_loses_neither(make):
    words = [f"w{i}" for i in range(60)]
    b, near, other = " ".join(words), " ".join([*words, "end"]), "quite another text that nobody else has"
    frame = make("doc_id long, text string, id string, key string, component int, node int", *[
        (d, t, "i", "k", 1, 2) for d, t in ((3, b), (5, near.upper()), (5, other), (None, b), (9, None), (9, ""), (5, near))])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame).collect())
    assert got == [(0, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (9, 9, True), (9, 9, True)]
    left = near_dedup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["id"], r["node"]) for r in left.collect()) == [
        (0, b, "i", 2), (3, b, "i", 2), (5, other, "i", 2), (9, "", "i", 2), (9, "", "i", 2)]
    assert near_dedup.drop_near_duplicates(frame.filter("false")).collect() == []


def test_bitmap_bounds_the_common_shingles_from_above():
    rng = np.random.default_rng(4)
    for size in (1, 20, 300, 768):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 63, size // 2 + 1, dtype=np.uint64)]))
        bits = [np.bitwise_count(near_dedup.bitmap(x).view(np.uint64)) for x in (a, b)]
        common = int(np.bitwise_count(near_dedup.bitmap(a).view(np.uint64) & near_dedup.bitmap(b).view(np.uint64)).sum())
        lost = min(len(x) - int(n.sum()) for x, n in zip((a, b), bits, strict=True))
        assert len(np.intersect1d(a, b)) <= common + lost


def test_sketch_bits_differ_for_an_eighth_at_the_border():
    rng = np.random.default_rng(6)
    off = []
    for _ in range(30):
        shared, one, two = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), *(rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in "ab")
        x, y = (near_dedup.sketch(np.concatenate([shared, z])).view(np.uint64) for z in (one, two))
        off.append(int(np.bitwise_count(x ^ y).sum()))
    assert 120 < np.mean(off) < 136 and max(off) <= near_dedup.SKETCH_MOST


def test_exact_duplicates_keep_columns_of_any_name(make):
    frame = make("doc_id long, text string, _sha string, exact_id string, _stays int", (2, "a  b", "x", "y", 1), (1, "a b", "z", "w", 2), (None, None, "n", "n", 3), (3, "", "e", "e", 4))
    left = exact_dedup.drop_exact_duplicates(frame)
    assert sorted((r["doc_id"] or 0, r["_sha"], r["exact_id"], r["_stays"]) for r in left.collect()) == [(1, "z", "w", 2), (3, "e", "e", 4)]
    assert left.columns == frame.columns and exact_dedup.drop_exact_duplicates(frame.filter("false")).collect() == []
