import math
from collections import Counter, defaultdict

import pytest

from compare import compare, duck
from decafix.llm import catalogue, mixing


def test_same_as_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(spark, duck(sf), catalogue.QUERIES["op4_mixing"], catalogue.SQL["op4_mixing"], sf) == ""


def table(spark, sizes, n_tokens=10):
    rows = [(i, " ".join(["w"] * n_tokens), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame([(*r, 5, 9) for r in rows], "doc_id long, text string, source string, epoch int, t int")


@pytest.mark.parametrize("sizes,entropy,most", [({"a": 900, "b": 90, "c": 10}, 0.7, 50.0), ({"a": 900, "b": 90, "c": 10}, 0.99, 3.0), ({"a": 100, "b": 100}, 0.9, 4.0), ({"a": 50}, 0.9, 4.0)])
def test_weights(spark, sizes, entropy, most):
    docs = table(spark, sizes)
    rows = mixing.choose(docs, mixing.Target(entropy, most, blocks=8)).collect()
    total = sum(sizes.values())
    got = Counter(r["source"] for r in rows)
    n = len(sizes)
    epochs = {s: got[s] / sizes[s] for s in sizes}
    assert max(epochs.values()) <= most + 0.01 and sum(got.values()) <= total and sum(got.values()) >= total - n * 2
    h = -sum(got[s] / total * math.log(got[s] / total) for s in sizes)
    natural = -sum(sizes[s] / total * math.log(sizes[s] / total) for s in sizes)
    if n > 1 and natural < entropy * math.log(n) and max(epochs.values()) < most - 0.1:
        assert abs(h - entropy * math.log(n)) < 0.02
    if natural >= entropy * math.log(max(n, 1)):
        assert got == sizes
    by = defaultdict(Counter)
    for r in rows:
        by[r["source"]][r["doc_id"]] += 1
    assert all(max(c.values()) - min(c.values() if len(c) == sizes[s] else [0, *c.values()]) <= 1 for s, c in by.items())


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", None, 1), (None, "c d", None, 1), (1, None, "s", 1), (2, "", "s", 1), (3, "x y", "s", 1), (3, "x y", "s", 1), (3, "z", "s", 1), (4, "w " * 40_000, "s", 1)], "doc_id long, text string, source string, block int")
    out = mixing.mix(docs, mixing.Target(0.5, 4.0, blocks=4))
    assert out.columns == ["doc_id", "text", "source", "block", "epoch", "block_rank"]
    assert {(r["doc_id"], r["source"]) for r in out.collect()} <= {(None, None), (3, "s"), (4, "s")} and out.where("text IS NULL OR text = ''").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    small = mixing.choose(table(spark, {"a": 100, "b": 100}), mixing.Target(budget=500))
    assert sum(r["tokens"] for r in small.collect()) in range(480, 501)


def test_own_epoch_is_replaced_and_blocks_grow(spark, monkeypatch):
    docs = table(spark, {"a": 60, "b": 6})
    out = mixing.mix(docs, mixing.Target(0.9, 4.0, blocks=4))
    assert out.columns == ["doc_id", "text", "source", "t", "epoch", "block_rank"] and {r["t"] for r in out.collect()} == {9}
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 2)
    fine = mixing.choose(docs, mixing.Target(0.5, 4.0)).collect()
    assert 640 <= sum(r["tokens"] for r in fine) <= 660 and max(r["block_rank"] for r in fine) > 30
