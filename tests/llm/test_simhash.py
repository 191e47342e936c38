import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from decafix.llm import simhash
from decafix.llm.components import components, spanning


def brute_fp(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, radius=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_similar(texts):
    """Components of texts whose sets of five-word shingles are at least 0.8 alike; texts without words are alone."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)] + [(7, 7), (1, 900), (900, 1)] + [(50, 1000 + i) for i in range(40)]
    nodes, roots = spanning(*np.array(edges).T)
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(7)
    got = {x["node"]: x["component"] for x in components(df).collect()}
    assert got == want and want[160] == 100 and want[900] == 1 and 7 not in want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    many = spark.range(200_000).selectExpr("id as a", "id - id % 1000 as b").repartition(8)
    assert components(many).agg({"component": "sum", "node": "count"}).collect()[0].asDict() == {"sum(component)": 999 * sum(range(0, 200_000, 1000)), "count(node)": 199_800}


TEXTS = [None, "", " \n\t", "One", "one  TWO", "ONE two", "a b c", "A B C", "Ünï b c", "ünï b c", "x " * 5000, "a b c d e f g h i j k l m n o p", "\x0b a b c", "a b a b a b a b"]


def test_against_brute_force(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("alpha beta gamma delta of the to and".split()) + str(r.randrange(50)) for _ in range(300)) for _ in range(12)]
    texts = TEXTS + base * 2
    for b in base:
        w = b.split()
        for _ in range(6):
            w[r.randrange(300)] = f"z{r.randrange(9)}"
            texts.append(" ".join(w))
    rows = [(i, t, "extra", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: int(x["fingerprint"], 16) for i, x in got.items()} == fps
    want = brute_components(fps)
    assert {i: x["component_id"] for i, x in got.items()} == want
    kept = {x["doc_id"] for x in simhash.keep_one(df).collect()}
    assert kept == {i for i, c in brute_similar(dict(enumerate(texts))).items() if i == c} and len(kept) < len(texts) - 60


@pytest.mark.parametrize("dense", [2, 32, 10_000])
def test_links_connect_all_within_radius(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(dense)
    centre = r.getrandbits(64)
    fps = {r.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(300):
        x = centre
        for b in r.sample(range(64), r.randrange(1, 5)):
            x ^= 1 << b
        fps.add(x)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(sorted(fps))]
    found = [(e["a"], e["b"]) for e in simhash.links(spark.createDataFrame(rows, "fp long, id long")).collect()]
    value = {i: x for x, i in rows}
    assert all(((value[a] ^ value[b]) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = brute_components({i: x & (1 << 64) - 1 for x, i in rows})
    assert {i: got.get(i, i) for i in want} == want


def test_nulls_ties_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c")], "doc_id long, text string")
    got = defaultdict(list)
    for x in simhash.near_duplicates(df).collect():
        got[x["doc_id"]].append(x["component_id"])
    assert got == {None: [None], 5: [5, 5], 9: [5]}
    assert sorted(str(x["doc_id"]) for x in simhash.keep_one(df).collect()) == ["5", "5", "None"]
    crowd = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(200)) + f" end{i}") for i in range(300)], "doc_id long, text string")
    assert [x["doc_id"] for x in simhash.keep_one(crowd).collect()] == [0]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_repeated_id_is_one_node(spark):
    r = random.Random(2)
    a, b, c = (" ".join(f"{x}{r.randrange(999)}" for _ in range(80)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b), (9, c), (7, c), (8, None), (7, ""), (None, a)], "doc_id long, text string")
    got = defaultdict(set)
    for x in simhash.near_duplicates(df).collect():
        got[x["doc_id"]].add(x["component_id"])
    assert got == {1: {1}, 2: {1}, 3: {1}, 7: {7}, 8: {7}, 9: {7}, None: {None}}


def test_pivot_table_discards_only_what_is_too_far(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(40)]
    pairs = [(x, x ^ sum(1 << k for k in r.sample(range(64), n))) for x in fps for n in (1, 2, 3, 30)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = simhash.coordinates(spark.createDataFrame([(i, signed(x)) for i, (x, _) in enumerate(pairs)], "i long, fp long"))
    other = simhash.coordinates(spark.createDataFrame([(i, signed(y)) for i, (_, y) in enumerate(pairs)], "i long, fp long")).selectExpr("i", "p0 as p0_2", "p1 as p1_2")
    met = rows.join(other, "i").where(simhash.within("p0", "p0_2") & simhash.within("p1", "p1_2"))
    left = {x["i"] for x in met.collect()}
    near = {i for i, (x, y) in enumerate(pairs) if (x ^ y).bit_count() <= 2}
    far = {i for i, (x, y) in enumerate(pairs) if (x ^ y).bit_count() == 30}
    assert near <= left and len(far & left) <= 2


def variants(r, base, n, share, new):
    """n texts of base's words, each with a passage of its own of so many new words in place of a share of them."""
    out = []
    for i in range(n):
        w, k = list(base), round(len(base) * share)
        at = r.randrange(len(w) - k)
        w[at : at + k] = [f"n{new}x{i}y{j}" for j in range(k)]
        out.append(" ".join(w))
    return out


def test_hub_links_its_variants(spark):
    r = random.Random(3)
    base = [f"b{r.randrange(10_000)}" for _ in range(300)]
    texts = variants(r, base, 300, 0.085, 0)
    texts[150] = " ".join(base)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    alone = [i for i in range(300) if not any(j != i and j != 150 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(300))]
    assert len(alone) >= 3  # members that only the hub links
    got = {x["id"]: x["component"] for x in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    want = {i: c for i, c in brute_similar(dict(enumerate(texts))).items()}
    assert {i: got.get(i, i) for i in want} == want and set(want.values()) == {0}


@pytest.mark.parametrize("tile", [3, 4096])
def test_join_lists_every_pair_alike(spark, tile):
    r, sets, rows = random.Random(tile), {}, []
    core = list(range(100))
    for i in range(120):
        mine = set(r.sample(core, r.randrange(70, 100))) | {r.randrange(1000, 10**6) for _ in range(r.randrange(20))} if i % 3 else {r.randrange(10**6) for _ in range(r.randrange(1, 9))}
        sets[i] = mine
        h = np.array(sorted(mine), np.uint64)
        prefix = simhash.prefix_of(h, np.arange(50, dtype=np.uint64), np.arange(50, 0, -1))
        rows.append((i, len(mine), prefix.astype(np.int64).tolist(), i % 7))
    got = [(x["a"], x["b"]) for x in simhash.alike(spark.createDataFrame(rows, "id long, n long, prefix array<long>, group long"), tile).collect()]
    alike = {(i, j) for i in sets for j in range(i + 1, 120) if i % 7 != j % 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(set(got)) == len(got) and len(alike) > 20 and alike <= set(got) and all(a < b and a % 7 != b % 7 for a, b in got)


def test_frequent_shingles_count_all_documents(spark, monkeypatch):
    r = random.Random(12)
    common = " ".join(f"c{i}" for i in range(14))
    texts = [" ".join(f"r{r.randrange(10**6)}" for _ in range(30)) + (f" {common}" if i % 3 == 0 else "") + (" a b c d e" if i % 5 == 0 else "") for i in range(900)]
    counts = Counter(h for t in texts for h in simhash.shingle_hashes(t.encode()).tolist())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    h, n = simhash.frequent_shingles(docs)
    got = dict(zip(h.tolist(), n.tolist(), strict=True))
    hot = {k: c for k, c in counts.items() if c > 100}
    assert len(hot) >= 11 and hot.items() <= got.items() and all(got[k] <= counts[k] for k in got) and sorted(got) == h.tolist()
    monkeypatch.setattr(simhash, "HELD", 64)
    h, n = simhash.frequent_shingles(docs)
    assert all(c <= counts[k] for k, c in zip(h.tolist(), n.tolist(), strict=True))
    h, n = simhash.frequent_shingles(docs.limit(0))
    assert len(h) == len(n) == 0


def test_recall_near_the_threshold(spark):
    pairs, new = [], iter(range(10**6))
    for n in (60, 200, 500):
        for extra in (0.20, 0.24):
            for _ in range(20):
                w = [f"q{next(new)}" for _ in range(n)]
                m = n - 4
                pairs.append((" ".join(w), " ".join(w + [f"z{next(new)}" for _ in range(int(m * extra))])))
                w = [f"q{next(new)}" for _ in range(n)]
                v, k = list(w), int(m * extra / (2 + extra)) - 4  # replaced: k words change k + 4 shingles of each
                v[20 : 20 + k] = [f"z{next(new)}" for _ in range(k)]
                pairs.append((" ".join(w), " ".join(v)))
    texts = [t for p in pairs for t in p]
    got = {x["id"]: x["component"] for x in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert all(got.get(2 * i + 1) == 2 * i and 2 * i not in got for i in range(len(pairs)))


def test_repeated_lines_count_once(spark):
    body, line = " ".join(f"w{k}" for k in range(300)), " the same old line comes again"
    once, often = body + line, body + line * 200
    a, b = simhash.wide_of([simhash.shingle_hashes(t.encode()) for t in (once, often)])
    assert sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= 30
    df = spark.createDataFrame([(1, once), (2, often), (3, body[:900])], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == [1, 3]


def test_repeated_ids_are_compared_row_by_row(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(100)) for c in "xyz")
    rows = [(1, y), (2, x), (2, y + " more"), (2, z), (2, z), (3, z + " more"), (4, x + " more"), (4, "alone here"), (5, x), (5, x + " more"), (6, ""), (None, x)]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, y), (2, x), (2, z), (2, z), (4, "alone here"), (6, ""), (None, x)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sketches_never_exceed_the_difference():
    r = random.Random(9)
    for _ in range(300):
        x = {r.getrandbits(64) for _ in range(r.randrange(1, 400))}
        y = set(r.sample(sorted(x), r.randrange(len(x) + 1))) | {r.getrandbits(64) for _ in range(r.randrange(1, 200))}
        a, b = (simhash.sketch_of(np.array(sorted(s), np.uint64)) for s in (x, y))
        assert simhash.sketch_distance(a, b) == simhash.sketch_distance(b, a) <= len(x ^ y) and simhash.sketch_distance(a, a) == 0


def test_pivot_bounds_never_exceed_the_difference():
    r, sets = random.Random(11), []
    for _ in range(300):
        x = {r.getrandbits(64) for _ in range(r.choice((1, 3, 40, 200, 700, 3000)))}
        sets.append((x, set(r.sample(sorted(x), r.randrange(len(x) + 1))) | {r.getrandbits(64) for _ in range(r.randrange(1, 300))}))
    crowd = {r.getrandbits(50) << 12 for _ in range(2500)}  # all in one cell, and too many of them for a byte
    assert simhash.pivots_of(np.array(sorted(crowd), np.uint64)) == b""
    sets.append((crowd, set(sorted(crowd)[:2400])))
    rows = [[simhash.pivots_of(np.array(sorted(s), np.uint64)) for s in side] for side in zip(*sets, strict=True)]
    for x, y in (rows, rows[::-1], (rows[0], rows[0])):
        got = simhash.pivot_bounds(x, y)
        assert all(g <= (0 if x is y else len(a ^ b)) for g, (a, b) in zip(got.tolist(), sets, strict=True))
    # unrelated sets of like size are told apart by the table alone, at any size
    for n in (30, 300, 3000, 30_000):
        x, y = ([simhash.pivots_of(np.array(sorted({r.getrandbits(64) for _ in range(n)}), np.uint64)) for _ in range(40)] for _ in range(2))
        assert (simhash.pivot_bounds(x, y) > (1 - simhash.SIMILARITY) / (1 + simhash.SIMILARITY) * 2 * n).mean() >= 0.9


def test_keep_one_discards_by_the_pivot_table(spark, monkeypatch):
    """Texts that share a passage but aren't alike meet in the join of shingles; the pivot table alone discards them, and no text of theirs is fetched."""
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(240)) + f" {passage}" for _ in range(40)]
    texts += [f"{texts[0]} more", " ".join(texts[1].split()[20:])]
    sets = [simhash.shingle_hashes(t.encode()) for t in texts]
    rows = [(i, len(h), simhash.pivots_of(h), b"\0" * 64) for i, h in enumerate(sets)]  # sketches that discard nothing
    pairs = spark.createDataFrame([(i, j) for j in range(42) for i in range(j)], "a long, b long")
    docs, fetched, cut = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: fetched.append(df) or cut(df))
    got = simhash.verified(docs, spark.createDataFrame(rows, "id long, n long, pivots binary, sketch binary"), pairs).collect()
    assert sorted((x["a"], x["b"]) for x in got) == [(0, 40), (1, 41)]
    assert fetched[1].count() == 4
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs.withColumnRenamed("id", "doc_id")).collect()) == list(range(40))


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_bitmap_marks_all_that_are_asked_for(spark, words, monkeypatch):
    monkeypatch.setattr(simhash, "WORDS", words)
    rows = spark.createDataFrame([(i, i % 7) for i in range(-500, 500)] + [(None, 1)], "a long, `b` int")
    ids = spark.createDataFrame([(i,) for i in range(-500, 10**6, 100)] + [(-500,), (None,)], "id long")
    got = {x["a"]: x["__marked"] for x in simhash.marked(rows, ids, "a").collect()}
    assert len(got) == 1001 and all(got[i] for i in range(-500, 500, 100))
    assert sum(got.values()) <= 1001 if words == 1 else sum(got.values()) <= 20
    assert not any(x["__marked"] for x in simhash.marked(rows, ids.limit(0), "a").collect())
