"""Longest common subsequences of any two sequences of hashable items."""

from __future__ import annotations

from collections.abc import Sequence

#: Bytes that the items' bit masks and the kept rows may take; beyond, masks
#: are made when they are met and rows again from every n-th one.
MEMORY = 16 << 20


def lcs(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Positions, in ``x`` and in ``y``, of a longest common subsequence.

    Bit-parallel: a row of the alignment table is one long integer, whose zero
    bits are where the length steps up.  The result is the same however much
    memory the rows may take.
    """
    places: dict = {}
    shared = set(x).intersection(y)
    ys = []
    for j, v in enumerate(y):
        if v in shared:
            places.setdefault(v, []).append(len(ys))
            ys.append(j)
    xs = [i for i, v in enumerate(x) if v in shared]
    if not xs:
        return []
    full, bits = (1 << len(ys)) - 1, len(ys) // 8 + 1

    def mask(v) -> int:
        out = bytearray(bits)
        for j in places[v]:
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    if bits * len(places) <= MEMORY:
        mask = {v: mask(v) for v in places}.__getitem__

    def advance(row: int, i: int) -> int:
        met = row & mask(x[i])
        return ((row + met) | (row - met)) & full

    step = 1 if bits * len(xs) <= MEMORY else int(len(xs) ** 0.5) + 1
    marks, row = [full], full
    for n, i in enumerate(xs, 1):
        row = advance(row, i)
        if n % step == 0:
            marks.append(row)
    out, low, rows = [], len(xs), []
    i, j = len(xs), len(ys)
    while i and j:
        if i <= low:  # rows low .. low + step, of which i is the last one needed
            low = (i - 1) // step * step
            rows = [marks[low // step]]
            for n in range(low, i):
                rows.append(marks[n + 1] if step == 1 else advance(rows[-1], xs[n]))
        if rows[i - low] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1 - low] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out[::-1]
