"""Static range asymmetric numeral coding of token ids, vectorised over lanes and blocks.

A state x in [2**31, 2**63) codes symbol s with frequency f and cumulative frequency c out of
2**SCALE as x -> (x // f << SCALE) + x % f + c, after moving its low 32 bits to the stream
where it would overflow. A block deals its tokens to LANES states round robin; every step
codes one token in each lane, and a step's words lie in lane order, so that a decoder takes
them back step by step. Blocks share nothing but the frequency table.
"""

from __future__ import annotations

import numpy as np

SCALE, LANES, STEPS = 18, 256, 256
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BITS = np.uint64(SCALE)
MASK = np.uint64((1 << SCALE) - 1)


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.float64)
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        out[0] = 1 << SCALE
        return out
    if len(seen) > 1 << SCALE:
        raise ValueError("more symbols than the table has slots")
    out[seen] = np.maximum(1, np.floor(counts[seen] / counts.sum() * (1 << SCALE)))
    spare = (1 << SCALE) - int(out.sum())
    order = seen[np.argsort(-counts[seen], kind="stable")]
    if spare >= 0:
        out[order[0]] += spare
    for s in order:  # take from the most frequent first
        if spare >= 0:
            break
        take = min(-spare, int(out[s]) // 2)
        out[s] -= take
        spare += take
    return out


class Table:
    """Frequencies, their sums, and the symbol of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.sums = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))
        self.common = int(np.argmax(self.freq))


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of equal length: ``ids`` (blocks, tokens) to final states (blocks, LANES), all
    blocks' words, and the number of words of each block."""
    blocks, tokens = ids.shape
    steps = -(-tokens // LANES)
    padded = np.full((blocks, steps * LANES), table.common, np.int64)
    padded[:, :tokens] = ids
    grid = padded.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words, owners = [], []
    shift = np.uint64(31 - SCALE + 32)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = table.freq[s]
        over = (x >> shift) >= f
        words.append(x[over].astype(np.uint32))
        owners.append(np.nonzero(over)[0])
        x = np.where(over, x >> WORD, x)
        q = x // f
        x = (q << BITS) + (x - q * f) + table.sums[s]
    words.reverse()
    owners.reverse()
    words, owners = np.concatenate(words), np.concatenate(owners)
    return x, words[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=blocks)


def decode(states: np.ndarray, words: np.ndarray, counts: np.ndarray, tokens: int, table: Table) -> np.ndarray:
    """The inverse of ``encode``: ids (blocks, tokens)."""
    blocks = len(states)
    steps = -(-tokens // LANES)
    x = states.astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)[:, None]
    out = np.empty((blocks, steps, LANES), np.uint32)
    for t in range(steps):
        slot = x & MASK
        s = table.symbol[slot.astype(np.int64)]
        out[:, t] = s
        x = table.freq[s] * (x >> BITS) + slot - table.sums[s]
        under = x < LOW
        place = np.cumsum(under, axis=1)
        if place[:, -1].any():
            x[under] = (x[under] << WORD) | words[(at + place - 1)[under]].astype(np.uint64)
            at = at + place[:, -1:]
    if not ((x == LOW).all() and np.array_equal(at[:, 0], np.cumsum(counts))):
        raise ValueError("a block does not end where it began")
    return out.reshape(blocks, -1)[:, :tokens]
