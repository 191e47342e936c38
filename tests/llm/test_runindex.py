import random

import numpy as np
import pytest

from decafix.llm.runindex import RunIndex
from decafix.llm.text import joined


def brute(strings, query):
    return [max((k for k in range(1, len(query) - i + 1) if any(query[i : i + k] in s for s in strings)), default=0) for i in range(len(query))]


@pytest.mark.parametrize("seed", range(25))
def test_matching_statistics(seed):
    r = random.Random(seed)
    letters = [b"ab", b"abc", bytes([0, 255]), b"abcdefgh"][seed % 4]
    word = lambda n: bytes(r.choice(letters) for _ in range(r.randrange(n)))
    base = word(60) + b"a"
    strings = [word(40) for _ in range(r.randrange(1, 8))] + [base[: r.randrange(len(base))] + word(5) + base[r.randrange(len(base)) :] for _ in range(5)] + [base, base]
    queries = [word(50) for _ in range(4)] + [base + word(4) + base, b"", b"z" + base, base[5:] + b"zz"]
    depth = r.randrange(1, 30)
    index = RunIndex(*joined(strings), depth)
    got, rows = index.matching_statistics(*joined(queries))
    assert got.tolist() == [x for q in queries for x in brute(strings, q)]
    places = [q[i : i + depth] for q in queries for i in range(len(q))]
    assert all(first == next(k for k, s in enumerate(strings) if w in s) for w, m, first in zip(places, got, index.first_string(rows), strict=True) if m >= depth)


def test_runs_are_few_in_repetitive_text():
    text = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(120))
    one, many = RunIndex(*joined([text])), RunIndex(*joined([text] * 50))
    assert len(many.run_start) <= len(one.run_start) + 2 and many.n == 50 * 121


def test_common_extension():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(30)) * 3 + bytes([r.randrange(97, 99)]) for _ in range(6)]
    data, bounds = joined(strings)
    index = RunIndex(data, bounds)
    places = [(int(index.start[i]) + k, s[k:]) for i, s in enumerate(strings) for k in range(len(s))]
    pick = [(r.choice(places), r.choice(places)) for _ in range(500)]
    want = [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for (_, x), (_, y) in pick]
    assert index.common(np.array([a for (a, _), _ in pick]), np.array([b for _, (b, _) in pick])).tolist() == want
