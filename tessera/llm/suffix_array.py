"""Suffix arrays by two-stage sorting, and adjacent common prefixes, of one bounded piece of bytes.

Only suffixes that are smaller than their successors are sorted directly; all others follow from them by scans of the
buckets of first bytes. Everything is in whole arrays: a bucket is a few operations, not a step a suffix.
"""

from __future__ import annotations

import numpy as np

#: Ends each string of a piece; no UTF-8 text has this byte.
END = 0xFF


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the one that starts a byte later (the last isn't: what follows is empty)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=bool)
    change = np.flatnonzero(data[1:] != data[:-1])  # the last byte of each run of equal ones
    grows = np.append(data[change] < data[change + 1], False)
    return np.repeat(grows, np.diff(np.concatenate([[-1], change, [n - 1]])))


def first_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts as they do (zeros beyond the end)."""
    x = np.concatenate([data, np.zeros(7, dtype=np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return x


class _Buckets:
    """What the scans of a piece need in every round: where the suffixes of each first byte stand."""

    def __init__(self, data: np.ndarray, small: np.ndarray):
        self.data, self.small, n = data, small, len(data)
        self.sizes = np.bincount(data, minlength=256)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n_small = np.bincount(data[small], minlength=256)
        self.used = np.flatnonzero(self.sizes).tolist()
        self.n = n

    def induce(self, direct: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and where a class of suffixes that are not told apart yet begins.

        direct: the smaller suffixes in order; new: where a class begins among them. A suffix that isn't smaller than
        its successor stands, among those of its first byte, in the order of the successors, before the smaller ones; so
        each bucket is complete when the scan comes to it, but for the runs of its own byte, which are added a length at
        a time. Two of them are of one class if their first bytes and their successors' classes are equal.
        """
        data, small, n = self.data, self.small, self.n
        order, begins = np.empty(n, dtype=np.int32), np.zeros(n, dtype=bool)
        mark = np.full(n + 1, -1, dtype=np.int32)  # a number of each placed suffix's class
        fill = self.starts[:-1].copy()
        ends = np.cumsum(self.n_small)
        count = 1
        mark[n] = 0

        def put(byte: int, at: np.ndarray) -> None:
            nonlocal count
            place, after = fill[byte], mark[at + 1]
            fresh = np.empty(len(at), dtype=bool)
            fresh[0] = True
            np.not_equal(after[1:], after[:-1], out=fresh[1:])
            order[place : place + len(at)] = at
            begins[place : place + len(at)] = fresh
            mark[at] = np.cumsum(fresh) + (count - 1)
            count += int(np.count_nonzero(fresh))
            fill[byte] = place + len(at)

        put(int(data[n - 1]), np.array([n - 1], dtype=np.int32))
        for c in self.used:
            seen = self.starts[c]
            while seen < fill[c]:  # predecessors in the same bucket: runs of c, one longer each time
                before = order[seen : fill[c]] - 1
                seen = fill[c]
                before = before[before >= 0]
                before = before[(data[before] == c)]
                if len(before):
                    put(c, before)
            k = self.n_small[c]
            if k:
                place, own = fill[c], slice(ends[c] - k, ends[c])
                order[place : place + k] = direct[own]
                fresh = new[own].copy()
                fresh[0] = True
                begins[place : place + k] = fresh
                mark[direct[own]] = np.cumsum(fresh) + (count - 1)
                count += int(np.count_nonzero(fresh))
                fill[c] = place + k
            before = order[self.starts[c] : fill[c]] - 1
            before = before[before >= 0]
            byte = data[before]
            over = byte > c
            before, byte = before[over], byte[over]
            if len(before):
                dealt = np.argsort(byte, kind="stable")
                before, byte = before[dealt], byte[dealt]
                cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(before)], strict=True):
                    put(int(byte[a]), before[a:b])
        return order, begins


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The starts of all suffixes of `data` in the order of their first `depth` bytes at least.

    The smaller suffixes are sorted by eight bytes; the scans give every suffix a class; then the smaller ones are sorted
    by their own class and the class behind the bytes it stands for, which doubles what is compared, until all differ or
    `depth` is reached.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    small = smaller_than_next(data)
    buckets = _Buckets(data, small)
    direct = np.flatnonzero(small).astype(np.int32)
    key = first_words(data)[direct]
    seen = 8
    while True:
        by = np.argsort(key)
        direct, key = direct[by], key[by]
        new = np.ones(len(direct), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        order, begins = buckets.induce(direct, new)
        if seen >= depth or begins.all():
            return order
        rank = np.zeros(n + seen + 1, dtype=np.uint64)  # nothing follows the end: the least class
        rank[order] = np.cumsum(begins).astype(np.uint64)
        key = (rank[direct] << np.uint64(32)) | rank[np.minimum(direct + seen, n)]
        seen *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each start the length of the common prefix of its suffix and the one before in order, up to the first END.

    Where the predecessor of the next start is the next of the predecessor, the length is one less; only the other
    starts are compared byte by byte, eight at a time.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, dtype=bool)
    follows[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1)
    follows[1:] &= (data[before[:-1]] == data[:-1]) & (data[:-1] != END)
    first = np.flatnonzero(~follows & (before >= 0))
    words = np.concatenate([first_words(data), np.zeros(8, dtype=np.uint64)])
    at, other, length = first.copy(), before[first], np.zeros(len(first), dtype=np.int64)
    live = np.arange(len(first))
    ends = np.flatnonzero(data == END)
    ends = np.append(ends, n)
    most = np.minimum(ends[np.searchsorted(ends, first)] - first, ends[np.searchsorted(ends, other)] - other)
    while len(live):
        a, b = words[at[live] + length[live]], words[other[live] + length[live]]
        same = a == b
        done = live[~same]
        if len(done):
            x = (a ^ b)[~same]
            zeros = np.zeros(len(x), dtype=np.int64)
            for size in (32, 16, 8):
                high = (x >> np.uint64(64 - size)) == 0
                zeros[high] += size // 8
                x[high] = x[high] << np.uint64(size)
            length[done] += zeros
        live = live[same]
        length[live] += 8
        live = live[length[live] < most[live]]
    lcp = np.zeros(n, dtype=np.int64)
    lcp[first] = np.minimum(length, most)
    anchor = np.maximum.accumulate(np.where(follows, -1, np.arange(n)))
    anchor = np.maximum(anchor, 0)
    return np.where(follows, np.maximum(lcp[anchor] - (np.arange(n) - anchor), 0), lcp)


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string a mark at each start of `length` bytes that also start anywhere else in the strings."""
    joined = np.frombuffer(bytes([END]).join([*strings, b""]), dtype=np.uint8)
    order = suffix_array(joined, length)
    lcp = common_prefixes(joined, order)
    with_before = lcp[order] >= length
    mark = np.zeros(len(joined), dtype=bool)
    mark[order] = with_before | np.append(with_before[1:], False)
    out, at = [], 0
    for s in strings:
        out.append(mark[at : at + max(0, len(s) - length + 1)])
        at += len(s) + 1
    return out
