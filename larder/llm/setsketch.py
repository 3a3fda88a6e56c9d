"""SetSketch registers: mergeable, locality-sensitive sketches of sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from larder.llm.tokens import coded, words

#: Registers are floor(1 - log_B(minimum of exponentials of rate A)), cut to 0..Q+1.
B, A, Q = 1.001, 20.0, 65534
#: Bands of registers: a link of similarity 0.85 shares no band with probability
#: (1 - 0.85^ROWS)^BANDS, about 7e-10.
BANDS, ROWS = 44, 6
REGISTERS = BANDS * ROWS
SEED = 20240229

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    A text with fewer words has its whole sequence as one shingle; one without words
    has the empty set.
    """
    flat, counts = words(texts)
    codes, distinct = coded(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct), dtype=np.uint64, count=len(distinct))
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    rolled = np.full(max(0, len(h) - size + 1), size, dtype=np.uint64)
    for k in range(size):
        rolled = _mix(rolled ^ (h[k : len(h) - size + 1 + k] * _K[k % 3]))
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[end - n : end - size + 1]))
        elif n:
            short = np.full(1, n, dtype=np.uint64)
            for k in range(n):
                short = _mix(short ^ (h[end - n + k : end - n + k + 1] * _K[k % 3]))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


_MUL, _ADD = _multipliers()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers [sets, REGISTERS] as uint16; an empty set has zeros.

    The minimum of exponential variables -ln(u) / A comes from the largest u, and u from
    one multiply-add of the element's hash per register; the truncated logarithm is
    monotone, so it is taken of the minimum alone.
    """
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    sizes = np.array([len(sets[i]) for i in filled])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.concatenate([sets[i] for i in filled])
    x = x ^ (x >> np.uint64(32))
    largest = np.empty((REGISTERS, len(filled)), dtype=np.uint64)
    buffer = np.empty_like(x)
    for r in range(REGISTERS):
        np.multiply(x, _MUL[r], out=buffer)
        np.add(buffer, _ADD[r], out=buffer)
        largest[r] = np.maximum.reduceat(buffer, starts)
    low = -np.log1p(-((~largest).astype(np.float64) + 0.5) / 2.0**64) / A
    k = np.floor(1 - np.log(low) / np.log(B))
    out[filled] = np.clip(k, 0, Q + 1).astype(np.uint16).T
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's register values [sets, BANDS]."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _K[1], (len(regs), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key ^ (parts[:, :, r] * _K[0] + np.uint64(r)))
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, of the share of own elements."""
    return -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j: registers of u above and below those of v."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    a, b = _p(u - v * j), _p(v - u * j)
    same = REGISTERS - above - below
    return above * np.log(a) + below * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def may_reach(at: float, regs_u: np.ndarray, regs_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, deviations: float = 5.0) -> np.ndarray:
    """Whether the similarity may be ``at`` or more, by likelihood ratio.

    False only if the most likely similarity is below ``at`` and ``at`` is less likely
    by more than deviations^2 / 2 in logs.
    """
    above, below = (regs_u > regs_v).sum(axis=1), (regs_u < regs_v).sum(axis=1)
    n_u, n_v = n_u.astype(float), n_v.astype(float)
    most = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    low, high = np.zeros(len(most)), most.copy()
    for _ in range(26):
        third = (high - low) / 3
        left = log_likelihood(low + third, above, below, n_u, n_v) < log_likelihood(high - third, above, below, n_u, n_v)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    best = (low + high) / 2
    given = np.minimum(at, most)
    ratio = log_likelihood(best, above, below, n_u, n_v) - log_likelihood(given, above, below, n_u, n_v)
    return (most >= at) & ((best >= at) | (ratio <= deviations**2 / 2))
