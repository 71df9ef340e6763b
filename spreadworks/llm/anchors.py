"""Content-defined anchors: the cut that lets equal windows of far-apart documents meet.

A window is ``width`` consecutive symbols (bytes or words).  Among the ``k``-symbol
grams inside a window the leftmost one with the smallest hash is its *anchor*.  The
choice depends on the window's content alone, so equal windows, wherever they occur,
have equal anchors at equal offsets.  Consecutive windows with one anchor form a
*block*: ``n_windows`` window starts and ``n_windows + width - 1`` symbols.  Every
window lies in exactly one block, and a repeated window can only be found between
blocks of one anchor gram.  Frequent grams (slots of a table that is the same for all
texts) are anchors of windows that have no other gram: else one passage of many
documents would be the anchor of what stands before and after it in each of them.  This
is plain numpy; Spark partitions and shuffles the blocks (see ``blocks.py``).
"""

from __future__ import annotations

import numpy as np

#: Odd 64-bit multipliers (golden ratio and the finaliser of a common 64-bit mixer).
GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Hash of each byte, as of any other symbol.
BYTES = mix64(np.arange(256, dtype=np.uint64) + GOLD)
#: Slots of a table of frequent grams: the leading bits of a hash.
SLOT_BITS = 22


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position (length n - k + 1), built by doubling."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    power, have = BYTES[symbols] if symbols.dtype == np.uint8 else mix64(symbols.astype(np.uint64) + GOLD), 1
    out, covered, done = None, 0, 0
    base = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        step = base
        rest = k
        while rest:
            if rest & 1:
                if out is None:
                    out, covered = power, have
                else:
                    m = min(len(out), len(power) - covered)
                    out = out[:m] * step + power[covered : covered + m]
                    covered += have
                done += have
            rest >>= 1
            if rest:
                m = len(power) - have
                power = power[:m] * step + power[have : have + m]
                step = step * step
                have *= 2
        return mix64(out[: n - k + 1])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cut(symbols: np.ndarray, ends: np.ndarray, width: int, k: int, frequent: np.ndarray | None = None):
    """Blocks of several documents laid end to end.

    symbols: one integer per symbol; ends[i]: the end of the document that symbol i
    is in; frequent: a mask over the slots.  Returns (start, n_windows, anchor hash) per block, starts ascending.
    The text of one call must stay under 2**24 symbols: the low bits of a key hold
    the position, which makes the leftmost of equal grams the smallest.
    """
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, np.zeros(0, np.uint64)
    bits = np.uint64((1 << 24) - 1)
    h = gram_hashes(symbols, k)
    keys = h if frequent is None else (h >> np.uint64(1)) | (frequent[slots(h)].astype(np.uint64) << np.uint64(63))
    keys = (keys & ~bits) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(keys, width - k + 1) & bits).astype(np.int64)  # anchor of each window
    inside = ends[: len(at)] - np.arange(len(at)) >= width
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    keep = inside[first]
    first, size = first[keep], size[keep]
    return first, size, h[at[first]]
