"""Answers from the length histogram, against the documents' own lengths."""

import numpy as np

from kinfold.llm import length_histogram as L


def test_limits_and_quantiles(spark):
    rng = np.random.default_rng(4)
    lengths = [0, 0, 3, 3, 700, 1025, *rng.integers(0, 4000, 300).tolist()]
    histogram = spark.createDataFrame([(int(n),) for n in lengths], "n_tokens long").groupBy("n_tokens").count().withColumnRenamed("count", "n_docs")
    limits = [0, 1, 512, 513, 1024, 3000, 10**6]
    got = {r.limit: r for r in L.at_limits(histogram, limits).collect()}
    assert set(got) == set(limits)
    for c, r in got.items():
        longer = [n for n in lengths if n > c]
        assert (r.docs_longer, r.tokens_longer, r.tokens_up_to, r.truncated_total) == (len(longer), sum(longer), sum(lengths) - sum(longer), sum(min(n, c) for n in lengths))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    told = {r.share: r.n_tokens for r in L.quantiles(L.suffix_sums(histogram), shares).collect()}
    own = sorted(lengths)
    assert told == {q: own[max(0, int(np.ceil(q * len(own))) - 1)] for q in shares}


def test_of_nothing(spark):
    empty = spark.createDataFrame([], "n_tokens long, n_docs long")
    assert [tuple(r) for r in L.at_limits(empty, [5]).collect()] == [(5, 0, 0, 0, 0)]
    assert [tuple(r) for r in L.quantiles(L.suffix_sums(empty), [0.5]).collect()] == [(0.5, None)]
