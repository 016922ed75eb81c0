"""Choosing combinations to run when there are too many: round-robin over strata, seeded."""

from __future__ import annotations

import random
from collections.abc import Hashable, Sequence

#: Products of distinct counts up to here may be held as a dense table, up to here as one 64-bit key, or neither.
REGIMES = (1 << 20, 1 << 64)


def stratum(families: Sequence[str], distinct: Sequence[int]) -> tuple[Hashable, ...]:
    """The type families of a combination, in order of name, and the regime of its product of distinct counts."""
    product = 1
    for d in distinct:
        product *= max(1, d)
    return (*sorted(families), sum(product > r for r in REGIMES))


def pick(combos: Sequence[tuple], families: dict, distinct: dict, most: int, seed: int = 0) -> list[tuple]:
    """At most ``most`` combinations, one from each stratum in turn; all of them, in order, where they are no more.

    ``families`` and ``distinct`` map the members of combinations to their type family and distinct count.
    """
    if most < 1:
        raise ValueError("most: at least 1")
    if len(combos) <= most:
        return list(combos)
    r = random.Random(seed)
    strata: dict[tuple, list[tuple]] = {}
    for c in combos:
        strata.setdefault(stratum([families[m] for m in c], [distinct[m] for m in c]), []).append(c)
    queues = [strata[k] for k in sorted(strata, key=repr)]
    for q in queues:
        r.shuffle(q)
    out: list[tuple] = []
    while len(out) < most:
        for q in queues:
            if q and len(out) < most:
                out.append(q.pop())
    place = {c: k for k, c in enumerate(combos)}
    return sorted(out, key=place.__getitem__)
