"""Stages of the pipeline against plain recomputations on a small table with odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, Score string, copy int"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng, rows, labels = random.Random(4), [], []
    words = [f"wort{i}" for i in range(200)]
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        text += " vilxor skruntish" * toxic
        text = text if good else text.replace(" ", "$$ %% ")
        rows.append((i, text, "de", ["hot", "hot", "cold", None][i % 4], len(text), "s", 7))
        labels.append((i, good, toxic))
    rows += [(300, None, None, None, None, None, None), (301, "", "de", "tiny", 0, "s", 1), (5, rows[5][1], "de", "hot", 9, "s", 2), (None, "no id here", "de", "hot", 4, "s", 3)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA), rows, sf


@pytest.mark.parametrize("stage", ["toxicity", "quality"])
def test_classifier_stages_keep_what_the_model_says(spark, small, stage):
    """Rows kept are those that the fitted model itself scores so, text by text on the driver."""
    import corpus_pipeline as C
    from veriloom.llm import quality, toxicity
    from veriloom.llm.labelled import sample

    docs, rows, sf = small
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    if stage == "toxicity":
        net, words = toxicity.learn(docs, labels), toxicity.Words()
        keeps = lambda t: net.scores([t], words)[0] < 0.5
    else:
        model = quality.fit(*sample(docs, labels, "quality", quality.PER_CLASS, quality.MOST_CHARS))
        keeps = lambda t: model.scores([t])[0] >= 0.3
    out = dict(C.STAGES)[stage](spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if keeps(r.text or ""))
    assert dict(C.STAGES)[stage](spark, docs.where("false"), sf).count() == 0


def test_mixing_stage_draws_by_inversion(spark, small):
    """Copies of each row recomputed from the hash and the distribution, one row at a time."""
    import corpus_pipeline as C

    docs, rows, sf = small
    chars = Counter()
    for r in rows:
        chars[r[3]] += len(r[1] or "")
    chars = {s: max(1, n) for s, n in chars.items()}
    shares = {s: math.sqrt(n) for s, n in chars.items()}
    rate = {s: shares[s] / sum(shares.values()) * sum(chars.values()) / chars[s] for s in chars}

    def copies(doc_id, source):
        pieces = max(1, math.ceil(rate[source] / 8.0))
        mean, total = rate[source] / pieces, 0
        for k in range(1, pieces + 1):
            u = int(hashlib.md5(f"20:{'null' if doc_id is None else doc_id}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-mean)
            n = 0
            while u >= c and n < 63:
                n += 1
                p *= mean / n
                c += p
            total += n
        return total

    want = Counter({r: copies(r[0], r[3]) for r in rows})
    got = Counter(tuple(r) for r in dict(C.STAGES)["mixing"](spark, docs, sf).collect())
    assert got == +want and sum(got.values()) > 100


def test_gradients_of_the_network():
    """The first step of training goes against the numerical gradient of the weighted loss."""
    from veriloom.llm import toxicity as X

    words = X.Words()
    docs = words.rows(["good day to you", "vilxor day skrunt", "a good plan", "skrunt vilxor you"])
    y = np.array([0, 1, 0, 1])
    net = X.Network()
    net._start(docs, y, words.features)

    def loss(out):
        net.out = out
        p = 1 / (1 + np.exp(-net.logits(docs, words.features).astype(np.float64)))
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    first = net.out.astype(np.float64).copy()
    numeric = np.array([(loss(first + 1e-3 * e) - loss(first - 1e-3 * e)) / 2e-3 for e in np.eye(len(first))])
    trained = X.Network()
    trained.train(docs, y, words.features, epochs=1, batch=4, rate=1e-3)
    moved = trained.out - first
    strong = np.abs(numeric) > 1e-3
    assert strong.any() and (np.sign(moved[strong]) == -np.sign(numeric[strong])).all()
