"""Bit-sliced Hamming comparison.

The signatures of a block stand vertically: plane b holds bit b of 64 members in
each 64-bit word. XOR with a query's bit gives one difference bit for 64 members
at once, carry-save adders add up eight planes into ones, twos, fours and an
eight, and the eights ripple into the upper counters. Rows (a query against one
word of members) are given up as soon as every member in them is beyond the
radius, which the upper counters alone can tell.
"""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ROWS = 1 << 15


def planes_of(sigs: np.ndarray, lanes: np.ndarray, words: int) -> np.ndarray:
    """Bit planes of signatures (n, w) whose member i is put at lane lanes[i]."""
    bits = sigs.shape[1] * 64
    out = np.empty((bits, words), dtype=np.uint64)
    lane = np.zeros(words * 64, dtype=np.uint8)
    for b in range(bits):
        lane[lanes] = ((sigs[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(lane, bitorder="little").view(np.uint64)
    return out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (carry, sum) of three bit vectors."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _above(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter (least bit first) exceeds limit."""
    over = np.zeros_like(counter[0])
    same = np.full_like(counter[0], ALL)
    for k in reversed(range(len(counter))):
        if (limit >> k) & 1:
            same &= counter[k]
        else:
            over |= same & counter[k]
            same &= ~counter[k]
    return over


def within(planes: np.ndarray, query_bits: np.ndarray, words: np.ndarray, alive: np.ndarray, radius: int, check: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(rows, masks): the lanes of `alive` within the radius, for rows that have any.

    planes: (bits, words); query_bits: (rows, bits / 64) signatures of the row's
    query; words: the row's word; alive: lanes to look at.
    """
    bits = planes.shape[0]
    upper_bits = max(1, (bits // 8).bit_length())
    rows = np.arange(len(words))
    ones = twos = fours = None
    upper: list[np.ndarray] = []

    def start(n: int) -> None:
        nonlocal ones, twos, fours, upper
        ones, twos, fours = (np.zeros(n, np.uint64) for _ in range(3))
        upper = [np.zeros(n, np.uint64) for _ in range(upper_bits)]

    start(len(rows))
    for base in range(0, bits, 8):
        x = []
        for b in range(base, base + 8):
            flip = np.uint64(0) - ((query_bits[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1))
            x.append(planes[b][words] ^ flip)
        t1, ones = _add(ones, x[0], x[1])
        t2, ones = _add(ones, x[2], x[3])
        f1, twos = _add(twos, t1, t2)
        t1, ones = _add(ones, x[4], x[5])
        t2, ones = _add(ones, x[6], x[7])
        f2, twos = _add(twos, t1, t2)
        carry, fours = _add(fours, f1, f2)
        for k in range(upper_bits):
            upper[k], carry = upper[k] ^ carry, upper[k] & carry
        if (base + 8) % check == 0 and base + 8 > radius:
            alive = alive & ~_above(upper, radius >> 3)
            keep = alive != 0
            if not keep.all():
                rows, words, query_bits, alive, ones, twos, fours = (v[keep] for v in (rows, words, query_bits, alive, ones, twos, fours))
                upper = [v[keep] for v in upper]
                if not len(rows):
                    return rows, alive
    alive = alive & ~_above([ones, twos, fours, *upper], radius)
    keep = alive != 0
    return rows[keep], alive[keep]


def _pairs(rows: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane in word) of every set bit."""
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, lane = np.nonzero(bits)
    return rows[r], lane


def roots_of(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of each member's component under the edges (a, b)."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        la, lb = la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def block_roots(sigs: np.ndarray, counts: np.ndarray, radius: int) -> np.ndarray:
    """For consecutive blocks of members, the least member each is linked to.

    Two members of a block are linked when their signatures differ in at most
    `radius` bits; members are numbered over all blocks. Nothing is left out: in
    a block of over 512 members, lanes already in the query's component are not
    compared again, which cannot change the components.
    """
    total = len(sigs)
    starts = np.cumsum(counts) - counts
    label = np.arange(total)
    small = np.flatnonzero(counts <= 512)
    for lo, hi in _batches(counts[small] * ((counts[small] + 63) // 64)):
        chosen = small[lo:hi]
        n = counts[chosen]
        w = (n + 63) // 64
        word0 = np.cumsum(w) - w
        member = np.repeat(starts[chosen], n) + _within(n)
        lanes = np.repeat(word0 * 64, n) + _within(n)
        planes = planes_of(sigs[member], lanes, int(w.sum()))
        local, blk = _within(n), np.repeat(np.arange(len(n)), n)
        first = local >> 6
        many = w[blk] - first
        query = np.repeat(np.arange(len(member)), many)
        word_in = np.repeat(first, many) + _within(many)
        left = n[blk[query]] - word_in * 64
        alive = np.where(left >= 64, ALL, (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
        own = word_in == first[query]
        later = ALL << np.minimum((local[query] & 63) + 1, 63).astype(np.uint64)
        later = np.where((local[query] & 63) == 63, np.uint64(0), later)
        alive = np.where(own, alive & later, alive)
        rows, masks = within(planes, sigs[member][query], word0[blk[query]] + word_in, alive, radius)
        r, lane = _pairs(rows, masks)
        a = member[query[r]]
        b = starts[chosen][blk[query[r]]] + word_in[r] * 64 + lane
        label = roots_of(total, a, b, label)
    for k in np.flatnonzero(counts > 512):
        s = slice(starts[k], starts[k] + counts[k])
        label[s] = starts[k] + _large(sigs[s], radius)
    return label


def _large(sigs: np.ndarray, radius: int) -> np.ndarray:
    n = len(sigs)
    w = (n + 63) // 64
    planes = planes_of(sigs, np.arange(n), w)
    label = np.arange(n)
    full = np.full(w, ALL)
    if n & 63:
        full[-1] = (np.uint64(1) << np.uint64(n & 63)) - np.uint64(1)
    step = max(1, ROWS // w)
    at = 0
    while at < n and label.any():
        queries = np.arange(at, min(n, at + (1 if at == 0 else step)))
        at = queries[-1] + 1
        lanes = np.zeros((len(queries), w * 64), dtype=np.uint8)
        lanes[:, :n] = label[None, :] != label[queries][:, None]
        alive = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64) & full
        q, word = np.nonzero(alive)
        if not len(q):
            continue
        rows, masks = within(planes, sigs[queries][q], word, alive[q, word], radius)
        r, lane = _pairs(rows, masks)
        label = roots_of(n, queries[q[r]], word[r] * 64 + lane, label)
    return label


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _batches(sizes: np.ndarray):
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + ROWS, side="right")))
        yield at, stop
        at = stop
