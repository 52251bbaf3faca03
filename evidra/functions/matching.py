"""Shares of matching characters of many pairs of texts at once, as ``difflib.SequenceMatcher`` counts them."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

#: From this length of the right text on, the matcher starts no run at signs that make up more than 1 % of it.
POPULAR = 200
#: Cells of the table of one pair; pairs beyond are handed to the matcher.
CELLS = 1 << 20
#: Cells of the rows that are filled at once: what a core keeps at hand.
AT_ONCE = 1 << 15
#: Cells of a row below which texts of more than some 64 signs are matched one by one.
FEW = 256


class _Texts:
    """The texts as one array of signs; of each, the places at which runs may start if it is on the right."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.plain = np.array([t.isascii() for t in texts], bool)
        self.start = np.cumsum(self.length) - self.length
        self.signs = np.frombuffer("".join(t if p else "?" * len(t) for t, p in zip(texts, self.plain, strict=True)).encode() + b"?", np.uint8)
        rare = np.ones(len(self.signs), bool)
        for t in np.flatnonzero(self.length >= POPULAR):
            at = slice(self.start[t], self.start[t] + self.length[t])
            rare[at] = (np.bincount(self.signs[at], minlength=256) <= self.length[t] // 100 + 1)[self.signs[at]]
        self.place = np.flatnonzero(rare)
        self.rank = np.concatenate([[0], np.cumsum(rare)])
        self.beside = np.concatenate([[0], np.where(np.diff(self.place) == 1, 255, 0)]).astype(np.uint8)
        self.rare = self.rank[self.start + self.length] - self.rank[self.start]


def _longest(texts: _Texts, work: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest common run of each (pair, a, length, b, length); the first in a, then in b."""
    _, a, la, b, lb = work
    text, low, high = texts.signs, texts.rank[b], texts.rank[b + lb]
    rows, columns, n = int(la.max()), int((high - low).max()), work.shape[1]
    best, row, column, one = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64), np.uint8(1)
    if columns:
        i, j = np.arange(rows)[:, None], low + np.arange(columns)[:, None]
        left = text[np.minimum(a + i, len(text) - 1)]
        outside, j = j >= high, np.minimum(j, len(texts.place) - 1)
        right, beside = text[texts.place[j]], texts.beside[j]
        # beyond a text's end stand signs that equal nothing
        left[i >= la], right[outside] = 254, 255
        gaps = bool((beside[1:] == 0).any())
        # runs[j + 1]: length of the common run that ends at the row's sign and at j
        runs, above, same = np.zeros((columns + 1, n), np.uint8), np.zeros((columns + 1, n), np.uint8), np.empty((columns, n), np.uint8)
        for x in range(rows):
            np.equal(right, left[x], out=same.view(bool))
            np.negative(same, out=same)
            if gaps:
                np.bitwise_and(above[:-1], beside, out=above[:-1])
            np.add(above[:-1], one, out=runs[1:])
            np.bitwise_and(runs[1:], same, out=runs[1:])
            most = runs.max(axis=0)
            more = (most > best).nonzero()[0]
            if len(more):
                best[more] = most[more]
                row[more] = x
                column[more] = runs[1:, more].argmax(axis=0)
            runs, above = above, runs
            runs[0] = 0
    size = best.astype(np.int64)
    i = a + np.where(size > 0, row + 1 - size, 0)
    j = np.where(size > 0, texts.place[np.minimum(low + column, len(texts.place) - 1)] + 1 - size, b)
    # runs go on over frequent signs
    more = (high - low < lb).nonzero()[0]
    if len(more):
        back = _alike(text, i[more] - 1, j[more] - 1, np.minimum(i - a, j - b)[more], -1)
        i[more], j[more], size[more] = i[more] - back, j[more] - back, size[more] + back
        size[more] += _alike(text, i[more] + size[more], j[more] + size[more], np.minimum(a + la - i, b + lb - j)[more] - size[more], 1)
    return i, j, size


def _alike(text: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many signs from i and from j on are equal, ``most`` at most."""
    out, more, steps = np.zeros(len(i), np.int64), (most > 0).nonzero()[0], np.arange(32)
    while len(more):
        at = out[more][:, None] + steps
        same = (at < most[more][:, None]) & (text[np.clip(i[more][:, None] + way * at, 0, len(text) - 1)] == text[np.clip(j[more][:, None] + way * at, 0, len(text) - 1)])
        run = np.where(same.all(axis=1), len(steps), same.argmin(axis=1))
        out[more] += run
        more = more[run == len(steps)]
    return out


def _one_by_one(matcher: SequenceMatcher, at: tuple[int, int, int, int]) -> int:
    """Characters in matching runs within (from, to) of both texts."""
    found, todo = 0, [at]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, size = matcher.find_longest_match(a0, a1, b0, b1)
        found += size
        if size:
            todo += [w for w in ((a0, i, b0, j), (i + size, a1, j + size, b1)) if w[0] < w[1] and w[2] < w[3]]
    return found


def _matched(texts: _Texts, x: np.ndarray, y: np.ndarray, quick: np.ndarray) -> np.ndarray:
    """Characters in matching runs of texts x and y: the longest one, and again on its left and on its right."""
    found = np.zeros(len(x), np.int64)
    whole = np.stack([np.arange(len(x)), texts.start[x], texts.length[x], texts.start[y], texts.length[y]])
    whole, quick = whole[:, (whole[2] > 0) & (whole[4] > 0)], quick[(texts.length[x] > 0) & (texts.length[y] > 0)]
    work, single = whole[:, quick], [whole[:, ~quick]]
    while work.shape[1]:
        tall, wide = work[2] // 4, texts.rank[work[3] + work[4]] - texts.rank[work[3]]
        order = np.lexsort((wide, tall))
        work, tall, cells = work[:, order], tall[order], np.cumsum(wide[order] + 1)
        rest = []
        at = 0
        while at < work.shape[1]:
            # of about one length, so that few rows are filled in vain
            end = min(int(np.searchsorted(cells, (cells[at - 1] if at else 0) + AT_ONCE)), int(np.searchsorted(tall, tall[at] * 5 // 4 + 1)))
            end = max(at + 1, end)
            part, at = work[:, at:end], end
            if tall[at - 1] > 16 and cells[at - 1] - (cells[at - 1 - part.shape[1]] if at > part.shape[1] else 0) < FEW:
                single.append(part)
                continue
            i, j, size = _longest(texts, part)
            np.add.at(found, part[0], size)
            p, a, la, b, lb = part
            before = np.stack([p, a, i - a, b, j - b])
            after = np.stack([p, i + size, a + la - i - size, j + size, b + lb - j - size])
            for w in (before, after):
                rest.append(w[:, (size > 0) & (w[2] > 0) & (w[4] > 0)])
        work = np.concatenate([work[:, :0], *rest], axis=1)
    # those of one right text follow each other, so that the matcher prepares it once
    single = np.concatenate(single, axis=1)
    matcher, last = SequenceMatcher(None), -1
    for p, a, la, b, lb in single[:, np.argsort(y[single[0]], kind="stable")].T.tolist():
        if y[p] != last:
            last = y[p]
            matcher.set_seq2(texts.texts[last])
        matcher.set_seq1(texts.texts[x[p]])
        a, b = a - texts.start[x[p]], b - texts.start[last]
        found[p] += _one_by_one(matcher, (int(a), int(a) + la, int(b), int(b) + lb))
    return found


def ratios(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """``SequenceMatcher(None, a, b).ratio()`` of each pair, NaN where one is None; left and right are not interchangeable."""
    codes: dict[str, int] = {}
    of = lambda some: np.fromiter((-1 if t is None else codes.setdefault(t, len(codes)) for t in some), np.int64, len(some))
    left, right = of(a), of(b)
    known = (left >= 0) & (right >= 0)
    out = np.full(len(left), np.nan)
    if not known.any():
        return out
    pair, back = np.unique(left[known] * len(codes) + right[known], return_inverse=True)
    x, y = pair // len(codes), pair % len(codes)
    texts = _Texts(list(codes))
    total = texts.length[x] + texts.length[y]
    # lengths of runs are kept in a byte
    quick = texts.plain[x] & texts.plain[y] & (texts.rare[y] < 255) & (texts.length[x] * texts.rare[y] <= CELLS)
    out[known] = np.where(total > 0, 2.0 * _matched(texts, x, y, quick) / np.maximum(total, 1), 1.0)[back]
    return out
