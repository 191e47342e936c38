import duckdb
import pytest

import corpus_pipeline
from decafix.llm import mixing, quality
from tests.llm.test_simhash import brute_similar
from tests.llm.test_suffix import brute as brute_suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and set(stages[0].columns) <= set(stages[-1].columns)


def test_quality(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(stages[0], model).collect() if r["score"] >= 0.3}
    assert set(rows(stages[1])) == good and len(good) < stages[0].count()


def test_near_duplicates(stages):
    want = brute_similar({i: r["text"] for i, r in rows(stages[1]).items()})
    assert set(rows(stages[2])) == set(want.values())


def test_repeats(stages):
    before, after = rows(stages[2]), rows(stages[3])
    removed = {int(i): n for i, _, n, _, _ in brute_suffix([(i, r["text"]) for i, r in before.items()])}
    for i, r in before.items():
        if not removed[i]:
            assert after[i] == r
        elif i in after:
            assert abs(len(r["text"].encode()) - len(after[i]["text"].encode()) - removed[i]) <= 8 and after[i]["n_chars"] == len(after[i]["text"])


def test_leaks(stages):
    before, after = rows(stages[3]), set(rows(stages[4]))
    words = lambda t: t.lower().replace(",", " ").replace(".", " ").split()
    items = [" ".join(words(t)) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    whole = {i for i, r in before.items() if any(x in " ".join(words(r["text"])) for x in items)}
    assert whole and not whole & after


def test_mixture(stages):
    want = sorted((r["doc_id"], r["epoch"]) for r in mixing.choose(stages[4]).collect())
    assert sorted((r["doc_id"], r["epoch"]) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, clashing names, a very long text; and an empty table."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    body = " ".join(f"word{k}" for k in range(200))
    odd = [(None, body, "en", None, 1), (None, None, None, "s", None), (7_000, None, "en", "s", 0), (7_001, "", "en", "s", 0), (7_002, body + " and more", None, None, None), (7_002, "another text under this id " * 3, "en", "s", 5)]
    odd += [(7_003, "the long one " + " ".join(f"w{k % 5000}x{k}" for k in range(60_000)), "en", "s", 1)] + [(7_004, "twice the very same row of the table, which is short", "en", "s", 1)] * 2
    own = {c: F.lit(1) for c in ("id", "h", "d", "key", "a", "b", "block", "epoch", "places", "component")}
    rows = some.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).withColumns(own)
    for name, table in (("documents", rows), ("labels", spark.read.parquet(f"{SF}/labels.parquet")), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert set(rows.columns) <= set(out.columns) and got and all((r["text"] or "").strip() and r["h"] == r["id"] == r["component"] == 1 for r in got)
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in rows.collect()}
    (tmp_path / "none").mkdir()
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
