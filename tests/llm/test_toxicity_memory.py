"""What fitting the toxicity network holds in the driver."""

import random
import tracemalloc

import numpy as np

from driftloom.llm import toxicity


def test_features_of_many_words_by_parts(monkeypatch):
    rng = random.Random(5)
    words = list({bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(1, 14))) for _ in range(30_000)})
    want = toxicity.word_features(words)
    monkeypatch.setattr(toxicity, "PART", 1000)
    tracemalloc.start()
    got = toxicity.all_features(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert peak < 3 * sum(x.nbytes for x in want)
    net = toxicity.Net()
    assert np.array_equal(net.all_vectors(got), net.vectors(want))
    assert [len(x) for x in toxicity.all_features([])] == [0, 0, 0]
