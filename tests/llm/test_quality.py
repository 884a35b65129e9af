import numpy as np

from pyspark.sql import functions as F

from helpers import DOCS, clashing, docs_of
from millrace.llm import quality

ROWS = [(b"some quiet words in a row, as people write them " * 9, 1), (b"BUY!!! NOW$$$ CHEAP%%% " * 20, 0)] * 8


def test_learns_and_scores_between_0_and_1():
    net = quality.fit(ROWS, epochs=10)
    good, bad = net.score(b"other quiet words that people write in rows " * 5), net.score(b"WIN!!! FREE$$$ OFFER%%% " * 30)
    assert 0 <= bad < 0.5 < good <= 1
    late = net.score(b"quiet words that people write " * 400 + b"BUY!!! NOW$$$ CHEAP%%% " * 400)
    assert late < good  # the end of a long text counts


def loss(net, raw, y):
    """Of one text, in double precision: chunks of two halves, the largest response of each filter, the mean of chunks."""
    b = np.frombuffer(raw + bytes(max(0, quality.WIDTH - len(raw)) or -(len(raw) - quality.WIDTH) % quality.STRIDE), np.uint8)
    x = net["embed"][b]
    z = np.array([x[i : i + quality.WIDTH].reshape(-1) @ net["filters"] for i in range(0, len(b) - quality.WIDTH + 1, quality.STRIDE)])
    halves = [z[i : i + quality.HALF] for i in range(0, len(z), quality.HALF)]
    chunks = [np.concatenate(halves[i : i + 2]) for i in range(max(1, len(halves) - 1))]
    top = np.maximum(np.array([c.max(axis=0) for c in chunks]) + net["bias"], 0)
    p = 1 / (1 + np.exp(-(top.mean(axis=0) @ net["out"] + net["out_bias"][0])))
    return -np.log(p if y else 1 - p), p


def doubles(net):
    return {k: getattr(net, k).astype(float) for k in ("embed", "filters", "bias", "out", "out_bias")}


def test_scores_against_brute_force(spark):
    net = quality.fit(ROWS, epochs=1)
    rng = np.random.default_rng(1)
    texts = ["", "a", "short text", "x" * 12, "y" * 13, "é" * 300] + ["".join(rng.choice(list("abc def!\n0"), n)) for n in (200, 203, 380, 381, 400, 1000, 5000)]
    got = {r.doc_id: r.score for r in quality.classify(docs_of(spark, texts), net).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - loss(doubles(net), t.encode(), 1)[1]) < 1e-4


def test_gradients():
    """Backpropagation against differences of the loss."""
    net = quality.Network.new(3)
    rows = [((b"abcdefghijklmnopqrstuvwxyz ,.!" * 40)[:900], 1), (b"0123456789 $%&/" * 30, 0), (b"tiny", 1)]
    grad, base = quality.gradients(net, rows, {0: 1.5, 1: 0.75}), doubles(net)
    total = lambda n: sum({0: 1.5, 1: 0.75}[y] * loss(n, r, y)[0] for r, y in rows) / quality.BATCH
    rng = np.random.default_rng(2)
    for name, g in grad.items():
        flat = np.flatnonzero(g)
        assert len(flat)
        for at in rng.choice(flat, min(12, len(flat)), replace=False):
            around = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in base.items()}
                moved[name].reshape(-1)[at] += step
                around.append(total(moved))
            assert abs((around[0] - around[1]) / 2e-6 - g.reshape(-1)[at]) < 1e-3 * max(0.02, abs(g.reshape(-1)[at])) + 2e-5


def test_windows_cover_the_text():
    net = quality.Network.new()
    for n in (0, 1, 11, 12, 13, 16, 17, 500):
        b, x = net.windows(bytes(range(1, 256)) * 2 if n > 400 else bytes(n))
        assert (len(x) - 1) * quality.STRIDE + quality.WIDTH == len(b)


def test_table(spark):
    net = quality.fit(ROWS, epochs=2)
    texts = [None, "", "a", "same", "same", "long text " * 100000]
    got = {r.doc_id: r.score for r in quality.classify(clashing(docs_of(spark, texts)), net).collect()}
    assert len(got) == 6 and got[0] == got[1] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.classify(spark.createDataFrame([], DOCS), net).count() == 0


def test_training_without_labels(spark):
    docs = docs_of(spark, ["a", None, "b"])
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, 1), (2, None)], "doc_id long, quality int")
    net = quality.train_network(docs, labels, ~quality.held_out())  # contradiction, nulls: nothing is left
    assert 0 <= net.score(b"x") <= 1
    assert quality.train_network(docs, labels.where("false"), ~quality.held_out()).score(b"") <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.9 * len(rows) > 0


def test_labels_of_missing_or_too_long_documents_take_no_room(spark):
    texts = [("good words here " if i % 2 else "bad zzz qqq ") * 3 for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, "x" * (quality.SAMPLE_BYTES + 1)) for i in range(500, 540)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(i, i % 2) for i in range(500, 540)] + [(i, i % 2) for i in range(10_000, 16_000)], "doc_id long, quality int")
    seen = []
    kept, quality.fit = quality.fit, lambda rows, positive: seen.append((rows, positive))
    try:
        quality.train_network(docs, labels, F.lit(True), each=50)
    finally:
        quality.fit = kept
    (rows, positive), = seen
    assert positive == 0.5 and sorted(y for _, y in rows) == [0] * 50 + [1] * 50


def test_the_sample_is_bounded_and_of_usable_texts(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(300)] + [(5, "text number 5")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(300)] + [(i, 1) for i in range(1000, 9000)], "doc_id long, quality int")
    seen = []
    kept, quality.fit = quality.fit, lambda rows, positive: seen.append((rows, positive))
    try:
        quality.train_network(docs, labels, F.lit(True), each=60)
    finally:
        quality.fit = kept
    (rows, _), = seen
    assert sum(y == 0 for _, y in rows) == 60 and sum(y == 1 for _, y in rows) == 60 and len({t for t, _ in rows}) == 120
