import zlib

import numpy as np
from pyspark.sql import functions as F

from sundown.llm import quality, toxicity

GOOD = "The river runs slowly past the old town and its quiet houses, and people walk there in the evening. "
BAD = "BUY!! NOW!! $$$ CLICK!! "


def test_attention_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    w = {
        "W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "A": rng.normal(size=(4, 4)), "G": rng.normal(size=(4, 4)),
        "v": rng.normal(size=4), "c": rng.normal(size=4), "d": rng.normal(size=1),
    }
    x, starts, y = rng.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._forward(w, x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, grad in quality._gradient(w, x, starts, y).items():
        flat, place = w[name].reshape(-1), 0
        old = flat[place]
        flat[place] = old + 1e-6
        up = loss()
        flat[place] = old - 1e-6
        down = loss()
        flat[place] = old
        assert abs((up - down) / 2e-6 - np.reshape(grad, -1)[place]) < 1e-6, name


def test_quality_learns_and_finds_a_bad_passage_anywhere(spark, make):
    docs = [(i, GOOD * (1 + i % 40) if i % 3 else BAD * (5 + i % 60), "x") for i in range(240)]
    frame = make("doc_id bigint, text string, score string", *docs, (None, GOOD, "x"), (900, None, "x"), (901, "", "x"))
    labels = make("doc_id bigint, quality int", *[(i, int(i % 3 > 0)) for i in range(240)], (3, None), (None, 1), (4, 1))
    model = quality.train(frame, labels, quality.remainder("doc_id", 3) != 1)
    rows = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40 and all((rows[i] >= 0.5) == (i % 3 > 0) for i in held)
    assert 0 <= rows[900] <= 1 and rows[900] == rows[901] and rows[None] >= 0.5
    kept = quality.keep_likely(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(240) if i % 3}
    assert quality.score(frame.filter("false"), model).count() == 0


def test_one_class_and_no_labels(spark, make):
    docs = make("doc_id bigint, text string", (1, GOOD))
    for labels in (make("doc_id bigint, quality int, toxic int", (1, 1, 1)), make("doc_id bigint, quality int, toxic int").limit(0)):
        model = quality.train(docs, labels, F.lit(True))
        assert 0 < quality.score(docs, model).first()["score"] < 1
        assert 0 < toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).first()["score"] < 1


def test_encoding_reads_the_whole_text():
    assert len(quality.encode((GOOD * 1000).encode())) == -(-19 * 1000 // 64)
    assert quality.encode(b" \n ").shape == (1, quality.WIDTH)


def test_toxicity_held_out_and_swapped(spark, make):
    rng = np.random.default_rng(3)
    neutral = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(neutral, 30))
        toxic = int(i % 5 == 0)
        # A group is named in most toxic texts and in few others, so its name looks guilty.
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(3, "muslims")
        if toxic:
            words.insert(9, str(rng.choice(["scumbag", "scumlord", "vilest", "viler"])))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    docs = make("doc_id bigint, text string, score string", *rows, (5000, "word1 muslims word2", "x"), (5001, None, "x"), (5002, "scumfresh word3", "x"))
    model = toxicity.train(docs, make("doc_id bigint, toxic int", *labels), quality.remainder("doc_id", 4) != 2)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(found[i] >= 0.3) == (i % 5 == 0) for i in held]) > 0.97
    assert found[5000] < 0.05 and found[5001] < 0.05 and found[5002] > 10 * found[5001]  # a new form of a learned beginning
    swapped = toxicity.counterfactual(toxicity.distinct_words(b"Word1, Muslims! word2"))
    assert swapped is not None and b"muslims" not in swapped and b"word1" in swapped
    texts = [toxicity.distinct_words(t) for t in (b"word1 muslims word2", b"word1 christians word2", b"word1 jews word2")]
    scores = [model.score(f for f in toxicity.feature_set(t) if f in model.weights) for t in texts]
    assert max(scores) - min(scores) < 0.05


def test_pair_penalty_moves_weight_off_identity_terms():
    names = {w: np.array(toxicity.features(w), np.uint64) for w in (b"muslims", b"christians", b"awful", b"plain")}
    mix = lambda *ws: np.unique(np.concatenate([names[w] for w in ws]))
    rows = [mix(b"muslims", b"awful")] * 20 + [mix(b"plain")] * 60 + [mix(b"awful")] * 10 + [mix(b"muslims", b"plain")] * 2
    labels = np.array([1.0] * 20 + [0.0] * 60 + [1.0] * 10 + [0.0] * 2)
    pair = (names[b"christians"], names[b"muslims"])
    free = toxicity.fit(rows, labels, [])
    held = toxicity.fit(rows, labels, [pair] * 22)
    weight = lambda m: sum(m.weights.get(int(f), 0.0) for f in names[b"muslims"])
    gap = lambda m: abs(weight(m) - sum(m.weights.get(int(f), 0.0) for f in names[b"christians"]))
    assert gap(held) < 0.3 * gap(free) + 0.05
