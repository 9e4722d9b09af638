"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np


def words8(buf: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the end."""
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.ndarray((len(buf) + 1,), ">u8", wide.data, 0, (1,))
    return (view[: len(buf)] if at is None else view[at]).astype(np.uint64)


#: Suffixes of a shard up to which ranks and positions fit one word together.
PACKED = 1 << 21


def _order(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Stable order by one key, or by two that are below ``PACKED``."""
    n = len(first)
    if second is None:
        if n > PACKED or n and int(first.max()) >> 42:
            return np.argsort(first, kind="stable")
        packed = first.astype(np.uint64) << np.uint64(21)
    elif n > PACKED or n and max(int(first.max()), int(second.max())) >= PACKED:
        return np.lexsort((second, first))
    else:
        packed = (first.astype(np.uint64) << np.uint64(42)) | (second.astype(np.uint64) << np.uint64(21))
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= np.uint64(PACKED - 1)
    return packed.astype(np.int32)


def suffix_array(keys: np.ndarray, span: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes, where ``keys[i]`` orders them by their first ``span`` symbols.

    Each round doubles the compared length by the rank of the suffix that starts where the compared part ends, and
    sorts only the suffixes whose rank is still shared.
    """
    n = len(keys)
    order = _order(keys)
    ordered = keys[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    small = np.int32 if n < 1 << 30 else np.int64
    rank = np.empty(n, small)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=small), small(0)))
    del keys, ordered
    places = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(places):
        at = order[places]
        first = rank[at]
        # A suffix that ends first comes first.
        second = np.where(at + span < n, rank[np.minimum(at + span, n - 1)] + span + 1, n - at)
        moved = _order(first, second)
        at, first, second = at[moved], first[moved], second[moved]
        order[places] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, places, 0)).astype(small)
        # A suffix is settled when its rank is its own.
        places = places[~fresh | np.append(~fresh[1:], False)]
        span *= 2
    return order, rank


def common_prefixes(buf: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it (0 for the first).

    Kasai's lemma: a suffix shares at least one byte less with its neighbour than the suffix one byte longer does with
    its own. Where the bytes before both are equal it is exactly one less, so only the others are compared, eight bytes
    at a time, and the rest follow by counting down.
    """
    n = len(buf)
    small = np.int32 if n < 1 << 30 else np.int64
    neighbour = np.full(n, -1, small)
    neighbour[order[1:]] = order[:-1]
    i = np.arange(n, dtype=small)
    fresh = (neighbour <= 0) | (i == 0)
    fresh[~fresh] = buf[i[~fresh] - 1] != buf[neighbour[~fresh] - 1]
    length = np.zeros(n, small)
    at = np.flatnonzero(fresh & (neighbour >= 0))
    step = 0
    word = words8(buf)
    while len(at):
        a, b = at + step, neighbour[at] + step
        inside = (a < n) & (b < n)
        at, a, b = at[inside], a[inside], b[inside]
        room = n - np.maximum(a, b)
        differ = word[a] ^ word[b]
        equal = np.full(len(at), 8)
        for k in range(7, -1, -1):
            equal[(differ >> np.uint64(8 * (7 - k))) & np.uint64(255) != 0] = k
        length[at] = step + np.minimum(equal, room)
        at = at[(equal == 8) & (room > 8)]
        step += 8
    last = np.maximum.accumulate(np.where(fresh, i, small(0)))
    length = np.maximum(0, length[last] + last - i)
    length[neighbour < 0] = 0
    return length[order]
