"""Suffix arrays by induced sorting and permuted common prefixes.

Suffixes are classified, leftmost-smaller substrings are sorted by induction and named, the string of their names is sorted by
the same method, and its order induces that of all suffixes. Induction walks the suffix array bucket by bucket. With few
buckets (bytes) what one bucket holds is handled in waves, each a few array operations: a wave's members put the suffixes that
begin one place earlier into their buckets, and those that fall into the same bucket are the next wave. With many buckets
(names) the array is walked place by place, which is linear whatever the buckets are.
"""

from __future__ import annotations

import numpy as np

#: Buckets up to which induction goes in waves.
FEW_BUCKETS = 1024


def types(s: np.ndarray) -> np.ndarray:
    """True for S-type places (the suffix is less than the next one). The last is L-type: the end is less than any character."""
    n = len(s)
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    smaller = np.zeros(len(ends), bool)
    smaller[:-1] = s[ends[:-1]] < s[ends[:-1] + 1]
    return np.repeat(smaller, np.diff(ends, prepend=-1))


def _spread(values: np.ndarray, chars: np.ndarray, place: np.ndarray, into: np.ndarray, step: int) -> None:
    """Append values to their characters' buckets, in order; place holds where each bucket goes on."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.diff(c, prepend=-1))
    size = np.diff(np.append(first, len(c)))
    into[place[c] + step * (np.arange(len(c)) - np.repeat(first, size))] = values[order]
    place[c[first]] += step * size


def _by_place(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """_induce, place by place."""
    n = len(s)
    head = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
    order = np.argsort(s[lms], kind="stable")
    chars = s[lms[order]]
    # LMS places stand at the ends of their buckets.
    above = np.searchsorted(chars, chars, "right") - np.arange(len(chars))
    start = np.full(n, -1, np.int64)
    start[head[chars + 1] - above] = lms[order]
    # For each place the character before it if that is L-type, or S-type, else -1; the last entry is that of no place.
    before_l, before_s = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    before_l[1:n] = np.where(small[:-1], -1, s[:-1])
    before_s[1:n] = np.where(small[:-1], s[:-1], -1)
    sa, place, last = start.tolist(), head[:-1].tolist(), int(s[n - 1])
    sa[place[last]] = n - 1
    place[last] += 1
    chars = before_l.tolist()
    for j in sa:
        c = chars[j]
        if c >= 0:
            p = place[c]
            sa[p] = j - 1
            place[c] = p + 1
    place, chars = (head[1:] - 1).tolist(), before_s.tolist()
    for j in reversed(sa):
        c = chars[j]
        if c >= 0:
            p = place[c]
            sa[p] = j - 1
            place[c] = p - 1
    return np.array(sa, np.int64)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array from the LMS places, given in order within each bucket."""
    if size > FEW_BUCKETS:
        return _by_place(s, small, lms, size)
    n = len(s)
    chars = s.astype(np.uint8 if size <= 256 else np.uint16 if size <= 65536 else np.int64)
    counts = np.bincount(s, minlength=size)
    head = np.concatenate([[0], np.cumsum(counts)])
    n_l = np.bincount(s[~small], minlength=size)
    sa = np.full(n, -1, np.int64)
    used = np.flatnonzero(counts)
    lms_of = np.argsort(chars[lms], kind="stable")
    lms = lms[lms_of]
    lms_at = np.concatenate([[0], np.cumsum(np.bincount(s[lms], minlength=size))])
    # L-type suffixes, buckets ascending.
    place = head[:-1].copy()
    _spread(np.array([n - 1]), chars[n - 1 :], place, sa, 1)
    for c in used.tolist():
        done = head[c]
        while done < place[c]:
            wave = sa[done : place[c]]
            done = int(place[c])
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(before, chars[before], place, sa, 1)
        wave = lms[lms_at[c] : lms_at[c + 1]]
        if len(wave):
            before = wave - 1
            _spread(before, chars[before], place, sa, 1)
    # S-type suffixes, buckets descending.
    place = head[1:] - 1
    for c in used[::-1].tolist():
        done = head[c + 1] - 1
        while done > place[c]:
            wave = sa[place[c] + 1 : done + 1][::-1]
            done = int(place[c])
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(before, chars[before], place, sa, -1)
        wave = sa[head[c] : head[c] + n_l[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            _spread(before, chars[before], place, sa, -1)
    return sa


def names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The rank, from 0, of each leftmost-smaller substring: from one LMS place up to the next, which is part of it.

    Characters are told apart by type as well (L-type first), so that no substring is the beginning of another; the last one
    runs to the end of the string, which is less than any character. Several characters make one key; what is still equal
    is sorted by the next ones.
    """
    bits = (2 * size).bit_length()
    per = 63 // bits
    code = np.append(s * 2 + small + 1, 0)
    end = np.append(lms[1:], len(s) - 1)
    rank, live, off = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(live):
        at, stop = lms[live] + off, end[live]
        key = np.zeros(len(live), np.int64)
        for k in range(per):
            key = (key << bits) | np.where(at + k <= stop, code[np.minimum(at + k, len(s))], 0)
        order = np.lexsort((key, rank[live])) if off else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        group = rank[live]
        place = np.arange(len(live))
        first_of_group = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, place, 0))
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[live] = group + first - first_of_group
        off += per
        alone = new & np.append(new[1:], True)
        live = live[~alone]
        # Equal ones end together, but for the last one, which stays until it is alone.
        live = live[(lms[live] + off <= end[live]) | (live == len(lms) - 1)]
        if len(live) == 1:
            break
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The places of s in order of the suffixes that begin there. s: integers from 0."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64) if s.dtype.itemsize < 8 else s
    size = int(s.max()) + 1
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(s, small, lms, size)
    number = names(s, small, lms, size)
    order = lms[suffix_array(number)] if number.max() < len(lms) - 1 else lms[np.argsort(number)]
    return _induce(s, small, order, size)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, stop: int = 0) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in the suffix array, up to the first character stop.

    Only irreducible values (the characters before the two suffixes differ) are compared; any other is one less than that of
    the place before.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = (phi <= 0) | (at == 0)
    rest = np.flatnonzero(~known)
    known[rest] = (s[rest - 1] != s[phi[rest] - 1]) | (s[rest - 1] == stop)
    irreducible = np.flatnonzero(known)
    value = np.zeros(len(irreducible), np.int64)
    live = np.flatnonzero(phi[irreducible] >= 0)
    a, b = irreducible, phi[irreducible]
    off = 0
    while len(live):
        live = live[np.maximum(a[live], b[live]) + off < n]
        x = s[a[live] + off]
        live = live[(x == s[b[live] + off]) & (x != stop)]
        value[live] += 1
        off += 1
    last = np.cumsum(known) - 1
    return value[last] - (at - irreducible[last])
