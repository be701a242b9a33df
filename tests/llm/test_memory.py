"""Memory of the n-gram join's first stage."""

import tracemalloc
from collections import Counter

import numpy as np

from roadweave.llm import ngram_join

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_frequencies_are_merged_in_little_memory():
    f, g = ngram_join._Frequencies(), np.random.default_rng(5)
    f.tokens, f.counts = np.arange(1 << 20, dtype=np.uint64) * np.uint64(3), np.full(1 << 20, 2)
    lots = [g.integers(0, 1 << 40, 100_000, dtype=np.uint64) for _ in range(24)]
    tracemalloc.start()
    for lot in lots:
        f.add(lot)
    f.flush()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak


def test_frequencies_are_exact_below_the_bound():
    f, g, want = ngram_join._Frequencies(), np.random.default_rng(5), Counter()
    for _ in range(4):
        lot = g.integers(0, 500, 2000, dtype=np.uint64)
        want.update(lot.tolist())
        f.add(lot)
        f.flush()
    assert dict(zip(f.tokens.tolist(), f.counts.tolist())) == want and (f.tokens[1:] > f.tokens[:-1]).all()


def test_keep_one_each_takes_small_batches(spark, monkeypatch):
    seen, before, kept = [], spark.conf.get(ROWS), ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: seen.append(int(spark.conf.get(ROWS))) or kept(df, name))
    docs = spark.createDataFrame([(k, f"one two three four five six {k % 2}") for k in range(6)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one_each(docs).collect()) == [0, 1]
    assert seen and max(seen) <= 1000 and spark.conf.get(ROWS) == before
