"""Edit distance up to a threshold: banded and bit-parallel, after Hyyro (2003)."""

from __future__ import annotations

_ALL = (1 << 64) - 1
_TOP, _NEXT = 1 << 63, 1 << 62


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without the prefix and the suffix that they share."""
    if a == b:
        return "", ""
    lo, hi = 0, min(len(a), len(b))
    most = hi
    while lo < hi:  # longest shared prefix by bisection: comparing slices is fast
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b, most = a[lo:], b[lo:], most - lo
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    return a[: len(a) - lo], b[: len(b) - lo]


def distance_within(a: str, b: str, most: int) -> int | None:
    """The edit distance of a and b if it is at most ``most`` (< 32), else None."""
    if abs(len(a) - len(b)) > most:
        return None
    a, b = trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    if not m:
        return n
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    if n <= 2 * most:  # the band would be wider than the strings
        vp, vn, d, last = (1 << n) - 1, 0, n, 1 << (n - 1)
        full = (1 << n) - 1
        for c in b:
            x = where.get(c, 0) | vn
            d0 = ((((x & vp) + vp) ^ vp) | x) & full
            hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
            if hp & last:
                d += 1
            elif hn & last:
                d -= 1
            hp = (hp << 1 | 1) & full
            vp, vn = ((hn << 1) | ~(d0 | hp)) & full, hp & d0
        return d if d <= most else None
    # a window of 64 rows slides down the diagonal; its top bits are the band
    vp, vn, d = _ALL << (64 - most - 1) & _ALL, 0, most
    at, limit, across = most + 1 - 64, 2 * most + m - n, _NEXT
    for j, c in enumerate(b):
        rows = where.get(c, 0)
        x = (rows >> at if at >= 0 else rows << -at) & _ALL
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & _ALL
        hp, hn = (vn | ~(d0 | vp)) & _ALL, d0 & vp
        if j < n - most:
            if not d0 & _TOP:
                d += 1
        else:
            if hp & across:
                d += 1
            elif hn & across:
                d -= 1
            across >>= 1
        if d > limit:
            return None
        vp, vn = (hn | ~((d0 >> 1) | hp)) & _ALL, (d0 >> 1) & hp
        at += 1
    return d if d <= most else None
