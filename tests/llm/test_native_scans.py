import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from compare import TABLES, compare, duck
from decafix.llm import catalogue, licenses
from decafix.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_decontaminate", "op10_licenses"])
def test_same_as_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert compare(spark, duck(sf), catalogue.QUERIES[name], catalogue.SQL[name], sf) == ""


def test_masks_are_lossless():
    for n in range(1, 21):  # a window of the item, and the places in it that may differ
        span = min(n, dc.WINDOW)
        off = 0 if n < dc.ONE_OFF else 1 if n < dc.WINDOW else dc.WINDOW - dc.NEEDED
        hits = [{o + p for p in m} for m, low, high in dc.MASKS if low <= min(n, dc.LONG) <= high for o in range(span - m[-1])]
        assert all(any(not h & set(e) for h in hits) for e in combinations(range(span), off))


def _leaked(text, items):
    """Ids of the items that a text leaks, by trying all alignments."""
    w, out = re.findall(r"[a-z0-9]+", (text or "").lower()), set()
    for i, t in items:
        need = min(11, len(t) - 1) if len(t) >= 7 else len(t)
        for d in range(-len(t), len(w)):
            same = [0 <= d + k < len(w) and w[d + k] == t[k] for k in range(len(t))]
            if t and max(sum(same[k : k + 13]) for k in range(len(t))) >= need and (len(t) >= 4 or len(t) == len(w)):
                out.add(i)
    return out


@pytest.mark.parametrize("limit", [dc.BROADCAST_HASHES, 1])
def test_short_items(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(dc, "BROADCAST_HASHES", limit)
    r = random.Random(8)
    items = [(n, [f"i{n}w{r.randrange(4)}" for _ in range(n)]) for n in range(1, 15)] + [(20, ["no"] * 3), (21, ["yes"]), (22, [])]
    texts = [None, "", "no no no", "no no", "oh no no no", "yes", "yes yes", "Yes!"]
    for _, t in items:
        for off in (0, 0, 1, 2):
            w = list(t)
            for at in r.sample(range(len(w)), min(off, len(w))):
                w[at] = "changed"
            texts += [" ".join(w), " ".join(["pad"] * 5 + w + ["pad"]), " ".join(w[1:] + ["pad"]), " ".join(["pad"] + w[:-1])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {x["doc_id"]: x["n_items"] for x in dc.leaks(docs, bench).collect()}
    want = {k: len(_leaked(t, items)) for k, t in enumerate(texts)}
    assert got == want and sum(n > 0 for n in want.values()) > 60
    if limit > 1:  # the query's SQL says the same
        docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
        for t in TABLES:
            if t not in ("documents", "benchmark"):
                spark.read.parquet(f"{SF}/{t}.parquet").limit(1).write.parquet(f"{tmp_path}/{t}.parquet")
        assert compare(spark, duck(str(tmp_path)), catalogue.QUERIES["op6_decontaminate"], catalogue.SQL["op6_decontaminate"], str(tmp_path)) == ""


def test_substitutions(spark):
    r = random.Random(4)
    item = [f"w{i}" for i in range(20)]
    rows = []
    for k in range(120):
        w = [f"x{r.randrange(99)}" for _ in range(30)] + item[: r.choice([20, 13, 12, 11, 10])] + [f"y{r.randrange(99)}" for _ in range(20)]
        for at in r.sample(range(30, 42), r.randrange(4)):
            w[at] = "changed"
        rows.append((k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "short alpha beta gamma delta epsilon zeta"), (503, "one two three four five six seven"), (None, " ".join(item)), (None, "clean words only here"), (1000, " ".join(["pad"] * 50_000 + item)), (503, "other text"), (504, "W0 W1, w2! W3 w4 w5 w6 w7 w8 w9 w10")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, key int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five six seven"), (3, "alpha beta gamma delta epsilon zeta"), (None, None), (1, " ".join(item))], "item_id long, text string")

    searched = [(1, item), (2, "one two three four five six seven".split()), (3, "alpha beta gamma delta epsilon zeta".split())]
    leaks = lambda text: len(_leaked(text, searched))
    got = sorted((str(x["doc_id"]), x["n_items"]) for x in dc.leaks(docs, items).collect())
    assert got == sorted((str(i), leaks(t)) for i, t in rows) and any(n for _, n in got)
    kept = sorted((str(x["doc_id"]), x["text"] or "") for x in dc.clean(docs, items).collect())
    assert kept == sorted((str(i), t or "") for i, t in rows if not leaks(t))
    assert dc.leaks(docs.limit(0), items).count() == 0 and dc.leaks(docs, items.limit(0)).where("contaminated").count() == 0


def test_shuffled_seed_join_gives_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a = sorted(map(tuple, dc.leaks(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST_HASHES", 1)
    assert sorted(map(tuple, dc.leaks(docs, items).collect())) == a


def test_licenses(spark):
    mit = licenses.TEMPLATES[8][2]
    rows = [(1, "Released under the MIT License."), (2, "x " * 37 + mit.upper().replace("THE ", "the, ") + " y" * 30), (3, "Apache License, Version 2.0; cc-by-nc. CC BY NC under the MIT license"), (4, None), (5, ""), (6, "cc by\nnc cc by nc"), (7, "the mit under license"), (None, "Licensed under CC BY-NC 4.0."), (None, "plain"), (8, "word " * 60_000 + "under the mit license"), (8, "other"), (9, "accÉby nc cc by é nc")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, labels string")
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert (by[1]["base_labels"], by[1]["labels"], by[1]["n_base"], by[1]["first_word"]) == ("mit", "mit", 1, 1)
    assert by[2]["labels"] == "mit" and by[2]["base_labels"] == "" and 0.9 <= by[2]["score"] <= 1
    assert (by[3]["base_labels"], by[3]["n_base"], by[3]["first_word"], by[3]["last_word"]) == ("apache-2,cc-by-nc,mit", 4, 0, 11)
    assert all(by[i]["n_words"] == 0 and by[i]["first_word"] is None and by[i]["score"] == 0.0 and by[i]["labels"] == "" for i in (4, 5))
    assert (by[6]["n_base"], by[6]["first_word"], by[6]["last_word"]) == (2, 0, 3) and by[7]["n_base"] == 0
    assert len(got) == len(rows) and got[(None, 7)]["base_labels"] == "cc-by-nc" and got[(None, 1)]["labels"] == "" and got[(8, 60_004)]["first_word"] == 60_000 and by[9]["n_base"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_filters_lose_nothing(spark):
    r = random.Random(9)
    sets = licenses._sets()
    vocabulary = sorted({x for _, _, t, _ in sets for x in t})
    texts = []
    for _ in range(60):
        _, _, t, need = r.choice(sets)
        w = r.sample(t, min(len(t), need + r.randrange(-1, 2))) + r.sample(vocabulary, 3)
        r.shuffle(w)
        texts.append(["pad"] * r.randrange(50) + w + ["pad"] * 5)
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "key long, w array<string>").withColumn("v", F.array_intersect("w", licenses._strings(vocabulary)))
    got = {(x["key"], x["label"]): x["containment"] for x in licenses.similar(rows).collect()}
    want = {}
    for i, w in enumerate(texts):
        for s, label, t, need in sets:
            for at in range(0, len(w), s):
                common = len(set(w[at : at + 2 * s]) & set(t))
                if common >= need:
                    want[i, label] = max(want.get((i, label), 0), common / len(t))
    assert got == want and want
