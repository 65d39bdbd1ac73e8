"""What plans and fits hold on the driver, which has a JVM beside them."""

import random
import tracemalloc

import numpy as np


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_packing_plan_holds_patterns_as_an_array():
    """87,000 patterns for every length up to 1024: 28 MB as tuples, 5 MB as an array."""
    from veriloom.llm.packing import plan

    histogram = {k: 1000 // k + 1 for k in range(1, 1025)}
    made, most = peak(lambda: plan(histogram, 1024))
    used = dict.fromkeys(histogram, 0)
    for lengths, n in made:
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] += n
    assert used == histogram
    assert most < 12e6


def test_words_of_a_sample_are_held_in_parts(monkeypatch):
    """3.9 million characters: 40 MB if all texts' words are held at once; rows are the same whatever the parts."""
    from veriloom.llm import toxicity as T

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", *(" ".join(rng.choices(vocabulary, k=rng.randint(0, 900))) for _ in range(1500)), "Last W5"]
    words = T.Words()
    rows, most = peak(lambda: words.rows(texts))
    assert most < 25e6
    monkeypatch.setattr(T, "PART_CHARS", 1 << 40)
    whole = T.Words()
    assert all(np.array_equal(a, b) for a, b in zip(rows, whole.rows(texts), strict=True)) and len(rows) == len(texts)
    assert words.row == whole.row and np.array_equal(words.features, whole.features) and np.array_equal(words.language, whole.language)
    assert T.Words().rows([]) == []


def test_written_tables_trim_the_jvm(spark, monkeypatch):
    """A table that is written has the JVM give memory back, and is written whatever the JVM can."""
    from veriloom.llm import common

    assert common.trim(spark)
    calls = []
    monkeypatch.setattr(common, "trim", lambda s: calls.append(s) and False)
    assert common.materialize(spark.range(7), "seven").count() == 7 and calls == [spark]
