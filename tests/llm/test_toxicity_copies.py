"""What toxicity learns from: all labelled texts but exact copies."""

import random

from heliograph.llm import toxicity


def test_only_exact_copies_are_left_out(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(40)]
    texts = [" ".join(rng.sample(common, 40) + [f"own{i}-{k}" for k in range(10)]) for i in range(120)]
    rows = [(t, i % 2) for i, t in enumerate(texts)] + [(texts[0], 0)] * 5 + [(texts[0], 1)]
    left = toxicity.without_copies(spark.createDataFrame(rows, "text string, label int")).collect()
    assert sorted((r["text"], r["label"]) for r in left) == sorted(set(rows))
