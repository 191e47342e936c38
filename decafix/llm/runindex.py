"""A run-length index of a set of short strings: run-compressed Burrows-Wheeler transform with sampled run ends, and matching statistics."""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols of 9 bits that one 63-bit word holds


class RunIndex:
    """Indexes strings, given joined with their bounds; each ends in a symbol of its own, so no match crosses from one into the next.

    ``ranks`` are the names of all substrings of 7, 14, 28, ... symbols (a string's end padded), from prefix doubling: they sort the suffixes
    and afterwards measure common extensions of two places. Of the transform, runs are kept: their characters, starts, images under the last-to-first
    mapping, and the text places at their first and last rows.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, depth: int | None = None) -> None:
        """With ``depth``, also the intervals of rows whose suffixes share that many symbols, and the first string in each."""
        lens = np.diff(bounds)
        n = len(data) + len(lens)  # with an end for each string
        self.start = bounds[:-1] + np.arange(len(lens))
        owner = np.repeat(np.arange(len(lens)), lens + 1)
        self.end = (self.start + lens)[owner]  # the place of the own end
        text = np.zeros(n + FIRST, np.int64)
        text[np.arange(len(data)) + np.repeat(np.arange(len(lens)), lens)] = data.astype(np.int64) + 1
        self.text, self.n, at = text, n, np.arange(n)
        word = np.zeros(n, np.int64)
        for k in range(FIRST):
            word = (word << 9) | np.where(at + k < self.end, text[k : n + k], 0)
        self.ranks, self.steps, span = [self._names(word)], [FIRST], FIRST
        while span <= int(lens.max(initial=0)):
            r = self.ranks[-1]
            far = at + span
            second = np.where(far < self.end, r[np.minimum(far, n - 1)], 0)
            self.ranks.append(self._names((r << 32) | second))
            span *= 2
            self.steps.append(span)
        sa = np.argsort(self.ranks[-1], kind="stable")  # equal suffixes: by string, as their ends' order says
        before = np.where(sa == self.start[owner[sa]], 0, text[sa - 1])
        if depth:
            new = np.ones(n, bool)
            new[1:] = ~self._agree(sa[:-1], sa[1:], depth)
            self.interval = np.flatnonzero(new)
            self.earliest = np.minimum.reduceat(owner[sa], self.interval) if n else np.zeros(0, np.int64)
        heads = np.flatnonzero(np.diff(before, prepend=-1) != 0) if n else np.zeros(0, np.int64)
        self.run_start, self.run_char = heads, before[heads]
        self.run_len = np.diff(np.append(heads, n))
        self.first, self.last = sa[heads], sa[heads + self.run_len - 1]
        by = np.lexsort((heads, self.run_char))
        ahead = np.cumsum(self.run_len[by]) - self.run_len[by]
        self.image = np.empty(len(heads), np.int64)
        self.image[by] = ahead  # rows of smaller characters, then of earlier runs: characters in order make this the count itself
        self.order = by
        self.keys = self.run_char[by] * len(heads) + by

    @staticmethod
    def _names(words: np.ndarray) -> np.ndarray:
        order = np.argsort(words, kind="stable")
        ranked = words[order]
        names = np.empty(len(words), np.int64)
        names[order] = np.cumsum(np.diff(ranked, prepend=ranked[:1] - 1) != 0)
        return names

    def _agree(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Whether two places share ``depth`` symbols: the names of two overlapping substrings are equal."""
        k = max(i for i, step in enumerate(self.steps) if step <= max(depth, FIRST))
        if self.steps[k] > depth or 2 * self.steps[k] < depth:
            return self.common(a, b) >= depth
        r, ahead = self.ranks[k], depth - self.steps[k]
        room = np.minimum(self.end[a] - a, self.end[b] - b) >= depth
        return room & (r[a] == r[b]) & (r[np.minimum(a + ahead, self.n - 1)] == r[np.minimum(b + ahead, self.n - 1)])

    def first_string(self, rows: np.ndarray) -> np.ndarray:
        """The first string that holds the ``depth`` symbols at each row."""
        return self.earliest[np.searchsorted(self.interval, rows, "right") - 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of two text places."""
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for r, step in zip(reversed(self.ranks), reversed(self.steps), strict=True):
            for _ in range(2 if step == self.steps[-1] else 1):
                same = (total < room) & (r[np.minimum(a, self.n - 1)] == r[np.minimum(b, self.n - 1)])
                total += step * same
                a += step * same
                b += step * same
        for _ in range(FIRST):
            same = (total < room) & (self.text[np.minimum(a, self.n)] == self.text[np.minimum(b, self.n)])
            total, a, b = total + same, a + same, b + same
        return np.minimum(total, room)

    def matching_statistics(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the query strings, the length of the longest match that starts there with any indexed string, and a row of that match. All queries are
        streamed at once, right to left: one step moves every query by the last-to-first mapping of its row's run, or, where the run has
        another character, first to the nearer end of a run of that character (the one whose sampled place has the longer common extension)."""
        lens, out, rows = np.diff(bounds), np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        if not self.n:
            return out, rows
        count = len(lens)
        row, place, length = np.zeros(count, np.int64), np.full(count, self.first[0]), np.zeros(count, np.int64)
        runs = len(self.run_start)
        for step in range(int(lens.max(initial=0))):
            live = np.flatnonzero(lens > step)
            at = bounds[1:][live] - 1 - step
            c = data[at].astype(np.int64) + 1
            q, p, m = row[live], place[live], length[live]
            run = np.searchsorted(self.run_start, q, "right") - 1
            other = np.flatnonzero(self.run_char[run] != c)
            if len(other):
                key = c[other] * runs + run[other]
                k = np.searchsorted(self.keys, key)
                up, down = self.order[np.maximum(k - 1, 0)], self.order[np.minimum(k, runs - 1)]
                has_up, has_down = (k > 0) & (self.run_char[up] == c[other]), (k < runs) & (self.run_char[down] == c[other])
                lcp_up = np.where(has_up, self.common(p[other], self.last[up]), -1)
                lcp_down = np.where(has_down, self.common(p[other], self.first[down]), -1)
                upper = lcp_up >= lcp_down
                run[other] = np.where(upper, up, down)
                q[other] = np.where(upper, self.run_start[up] + self.run_len[up] - 1, self.run_start[down])
                p[other] = np.where(upper, self.last[up], self.first[down])
                m[other] = np.minimum(m[other], np.maximum(lcp_up, lcp_down))
                none = other[~(has_up | has_down)]
                q[none], run[none], p[none], m[none] = 0, 0, self.first[0], -1
                found = np.ones(len(live), bool)
                found[none] = False
            else:
                found = np.ones(len(live), bool)
            q = np.where(found, self.image[run] + q - self.run_start[run], 0)
            p = np.where(found, p - 1, p)
            row[live], place[live], length[live] = q, p, m + 1
            out[at], rows[at] = m + 1, q
        return out, rows
