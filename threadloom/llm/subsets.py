"""Subset sums over multiplicities in bounded memory: bitsets of reachable totals, traced by the first part that reached each."""

from __future__ import annotations

import numpy as np

#: Totals that one search covers; what lies above is filled with the largest sizes first.
SPAN = 1 << 22


def closest(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many things of each positive size to take so that their sum comes closest to ``target``; ties go below.

    Totals beyond SPAN are first filled with the largest sizes that still fit; the bitset then
    searches what is left, so memory is bounded by SPAN and not by the sizes or their number.
    """
    take: dict[int, int] = {}
    rest = target
    order = sorted((s for s in counts if s > 0), reverse=True)
    for s in order:
        if rest <= SPAN:
            break
        if n := min(counts[s], max(0, rest - SPAN // 2) // s):
            take[s], rest = n, rest - n * s
    if rest <= 0:
        return take
    most = min(2 * rest, rest + max(order, default=0))
    parts: list[tuple[int, int]] = []  # the binary parts of each size's multiplicity
    for s in order:
        c, power = min(counts[s] - take.get(s, 0), most // s), 1
        while c > 0:
            n = min(power, c)
            parts.append((s, n))
            c, power = c - n, power * 2
    mask, bits = (1 << (most + 1)) - 1, 1
    first = np.full(most + 1, -1, np.int32)
    for k, (s, n) in enumerate(parts):
        fresh = ((bits << (s * n)) & mask) & ~bits
        if fresh:
            raw = np.frombuffer(fresh.to_bytes(most // 8 + 1, "little"), np.uint8)
            at = np.flatnonzero(raw)
            first[(at[:, None] * 8 + np.arange(8))[np.unpackbits(raw[at], bitorder="little").reshape(-1, 8).astype(bool)]] = k
            bits |= fresh
            if bits >> rest & 1:
                break
    reach = next(t for d in range(most + 1) for t in (rest - d, rest + d) if 0 <= t <= most and bits >> t & 1)
    while reach:
        s, n = parts[first[reach]]
        take[s] = take.get(s, 0) + n
        reach -= s * n
    return take
