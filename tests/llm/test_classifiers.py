import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from decafix.llm import catalogue, language, quality

SF = "/root/testdata/sf0.01"


def test_crc(spark):
    got = spark.range(50).select(quality.crc_mod("id", 5)).collect()
    assert [g[0] for g in got] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]


def test_quality_on_held_out(spark):
    rows = catalogue.QUERIES["op3_quality"](spark, SF).collect()
    q = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good, bad = ([r["score"] for r in rows if r["held_out"] and q.get(r["doc_id"]) == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_edges(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("the of and to in is that".split()) for _ in range(60)) for _ in range(30)] + ["### %%% !!! " * 20 + str(i) for i in range(30)]
    docs = spark.createDataFrame([*[(i, t, i) for i, t in enumerate(texts)], (None, "x", 0), (900, None, 0), (901, "", 0), (902, "é" * 300_000, 0), (1, texts[1], 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([*[(i, int(i < 30)) for i in range(60)], (None, 1), (5, None), (7, 0), (999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i] > 0.5 for i in range(30)) and all(got[i] < 0.5 for i in range(30, 60)) and got[900] == got[901] == model.prior
    kept = [x["doc_id"] for x in quality.keep_good(docs, labels).collect()]
    assert set(range(30)) <= set(kept) and not set(kept) & set(range(30, 60)) and kept.count(1) == 2 and quality.keep_good(docs, labels).columns == docs.columns
    none = quality.fit(docs, labels.limit(0))
    assert {x["score"] for x in quality.score(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_language_on_held_out(spark):
    rows = catalogue.QUERIES["op8_language"](spark, SF).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_scores_against_plain_naive_bayes(spark):
    """Sample, counts and posteriors worked out text by text with dictionaries; in one matrix and in matrices of two languages."""
    import math
    from collections import Counter

    r = random.Random(3)
    letters = {"aa": "abcd ", "bb": "bcde ", "cc": "cdef ", "dd": "xyz ", "ee": "abz "}
    rows = [(i, "".join(r.choice(letters[g]) for _ in range(r.randrange(3, 40))), g) for i, g in enumerate(sorted(letters) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, language.Sample(rows=5))
    order = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect()}
    grams = lambda t: [int(c) for code in language.codes(language.points([t])[0]) for c in code]
    counts = {}
    for g in letters:
        mine = sorted((order[i], i, t) for i, t, x in rows if x == g)[:5]
        counts[g] = Counter(c for _, _, t in mine for c in grams(t))
    total = {g: sum(c.values()) for g, c in counts.items()}
    for together in (2, 256):
        got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict(docs, model, together=together).collect()}
        for i, t, _ in rows:
            ll = {g: sum(math.log((counts[g][c] + 0.5) / (total[g] + 0.5 * language.BUCKETS)) for c in grams(t)) + math.log(1 / 5) for g in letters}
            best = max(sorted(ll), key=lambda g: ll[g])
            p = 1 / sum(math.exp(v - ll[best]) for v in ll.values())
            has = any(map(str.isalpha, t))
            assert got[i][0] == (best if has else "und") and abs(got[i][1] - (p if has else 0)) < 1e-3


def test_many_languages(spark):
    rows = [(i, f"word{i % 300} " * 5, f"l{i % 300:03}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 300 and len(model.parts()) == 2
    got = {x["doc_id"]: x["lang_pred"] for x in language.predict(docs, model).collect()}
    assert sum(got[i] == g for i, _, g in rows) > 880


def test_quality_scores_against_plain_compression(spark):
    """Dictionaries, sizes and the curve worked out text by text."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = quality.crc_mod(F.col("id"), 5) != 0
    model = quality.fit(docs, labels, learn=learn)
    marked = {i: q for i, q in duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 5}
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    kinds = [[texts[i].encode() for i in sorted(marked) if marked[i] == q and texts[i] and len(texts[i].encode()) <= 32_768] for q in (1, 0)]
    cut = lambda t: [t[i : i + 512] for i in range(0, len(t), 512)]
    dictionaries = [quality.build_dictionary(k, 400_000) for k in kinds]
    assert [model.good, model.bad] == dictionaries and model.prior == np.mean([q for q in marked.values()])
    press = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in dictionaries]
    w = model.weights
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    for i, t in list(texts.items())[:150]:
        b = (t or "").encode()
        if b:
            g, z = (sum(len(c.compress(p)) for p in cut(b)) for c in press)
            want = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * (z - g) / len(b) + w[2] * (z + g) / (2 * len(b)), -50, 50)))
            assert abs(got[i] - want) < 0.02


def test_ngrams_stay_in_their_text(monkeypatch):
    r = np.random.default_rng(2)
    log_p = r.normal(size=(language.BUCKETS, 3)).astype(np.float32)
    texts = ["", "a", "Ab c", "ééé", "x" * 50, "\U0001f600 hi"]
    alone = [language.sums([t], log_p) for t in texts]
    for piece in (3, 7, 1 << 18):
        monkeypatch.setattr(language, "_PIECE", piece)
        total, n = language.sums(texts, log_p)
        assert n.tolist() == [int(a[1][0]) for a in alone] and np.allclose(total, np.concatenate([a[0] for a in alone]), atol=1e-4)
    low = " ab c "
    assert alone[2][1][0] == sum(len(low) - k + 1 for k in language.ORDERS)


def test_language_edges(spark):
    rows = [(i, t, lang, 3.0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    rows += [(100, None, None, 1.0), (101, "", None, 1.0), (102, "12 !? 3", "en", 1.0), (None, "the dog", "fr", 1.0), (103, "the cat " * 40_000, None, 1.0), (104, "le chien", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.fit(docs, learn=F.lit(True))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict(docs, model).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en" and got[104][0] == "fr" and got[None][0] == "en"
    assert {x["lang_pred"] for x in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
