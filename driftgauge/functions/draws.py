"""Reproducible draws from plain BIGINT arithmetic.

Keyed hashing instead of ``rand()``: a lost task recomputes the same draw, paired
designs share draws by sharing keys, and any SQL engine can reproduce them.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647
# Multiplier, offset and weight of a key's high part, one row per lane.
LANES = ((48_271, 69_621, 40_692), (39_373, 62_089, 52_774))
FINISH = 7

# P(X <= k) for X ~ Poisson(1), as integers on the scale of MODULUS.
POISSON_STEPS = [
    int(sum(exp(-1.0) / factorial(i) for i in range(k + 1)) * MODULUS) for k in range(11)
]


def _let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that using it twice computes it once."""
    return F.transform(F.array(value), body)[0]


def _mix(lane: int, h: Column, x: Column) -> Column:
    """One step of a lane. A key enters by its remainder and by its quotient, so all 64 bits of it count."""
    multiplier, offset, high = LANES[lane]
    x, m = x.cast("bigint"), F.lit(MODULUS)
    quotient = F.pmod(F.call_function("div", x, m), m)
    t = (h * F.lit(multiplier) + F.pmod(x, m) + quotient * F.lit(high) + F.lit(11)) % m
    return _let(t, lambda v: (v * (v + F.lit(offset))) % m)


def _lane(lane: int, seed: int, keys: tuple[Column, ...]) -> Column:
    h = F.lit(int(seed)).cast("bigint")
    for k in keys:
        h = _mix(lane, h, k)
    return h


def keyed_hash(seed: int, *keys: Column) -> Column:
    """BIGINT in [0, MODULUS), from two lanes: keys share draws only if they agree in both."""
    return _mix(0, _mix(0, _lane(0, seed, keys), _lane(1, seed, keys)), F.lit(FINISH))


def wide_hash(seed: int, *keys: Column) -> Column:
    """BIGINT in [0, MODULUS^2), about 62 bits: for targets in pools that 31 bits cannot reach."""
    first, second = (_mix(lane, _lane(lane, seed, keys), F.lit(FINISH)) for lane in (0, 1))
    return first * F.lit(MODULUS) + second


def _reduced(v):
    """``v % MODULUS`` for 0 <= v < 2^62: the modulus is 2^31 - 1, so shifts and additions do it."""
    v = (v & MODULUS) + (v >> 31)
    v = (v & MODULUS) + (v >> 31)
    return np.where(v >= MODULUS, v - MODULUS, v)


def _mix_np(lane: int, h, x):
    multiplier, offset, high = LANES[lane]
    x = np.asarray(x, dtype=np.int64)
    t = h * multiplier + 11
    if x.size and x.min() >= 0 and x.max() < MODULUS:  # no quotient to add
        t = t + x
    else:
        quotient = np.mod(np.where(x < 0, -(-x // MODULUS), x // MODULUS), MODULUS)
        t = t + np.mod(x, MODULUS) + quotient * high
    t = _reduced(t)
    return _reduced(t * (t + offset))


def _lane_np(lane: int, seed: int, keys):
    h = np.int64(seed)
    for k in keys:
        h = _mix_np(lane, h, k)
    return h


def keyed_hash_np(seed: int, *keys) -> np.ndarray:
    return _mix_np(0, _mix_np(0, _lane_np(0, seed, keys), _lane_np(1, seed, keys)), np.int64(FINISH))


def wide_hash_np(seed: int, *keys) -> np.ndarray:
    first, second = (_mix_np(lane, _lane_np(lane, seed, keys), np.int64(FINISH)) for lane in (0, 1))
    return first * MODULUS + second


class PoissonDraws:
    """Poisson(1) counts of the same ids for many replicates, the draws of ``keyed_hash(seed, rep, id)``.

    What depends on the ids alone is computed once (8 bytes an id). Values stay congruent, not reduced: a fold leaves at
    most 33 bits of a product and factors stay below 32, so nothing leaves 64 bits.
    """

    BLOCK = 16_384

    def __init__(self, seed: int, ids: np.ndarray):
        self.seed, self.size = int(seed), len(ids)
        self.own = [np.empty(self.size, np.uint32) for _ in LANES]
        for lo in range(0, self.size, self.BLOCK):
            x = ids[lo : lo + self.BLOCK].astype(np.int64)
            quotient = np.mod(np.where(x < 0, -(-x // MODULUS), x // MODULUS), MODULUS)
            for own, (_, _, high) in zip(self.own, LANES, strict=True):
                own[lo : lo + self.BLOCK] = _reduced(np.mod(x, MODULUS) + quotient * high + 11)

    def __call__(self, reps: np.ndarray) -> np.ndarray:
        """(reps, ids), one byte each: a count is eleven at most."""
        out = np.empty((len(reps), self.size), np.uint8)
        multiplier, offset, _ = LANES[0]
        starts = [_reduced(_mix_np(lane, np.int64(self.seed), reps) * LANES[lane][0])[:, None] - MODULUS for lane in (0, 1)]
        width = max(1, self.BLOCK // max(1, self.size))
        buffers = [np.empty(self.BLOCK, np.int64) for _ in range(3)]
        for at, lo in ((at, lo) for at in range(0, len(reps), width) for lo in range(0, self.size, self.BLOCK)):
            here = out[at : at + width, lo : lo + self.BLOCK]
            t, s, u = (b[: here.size].reshape(here.shape) for b in buffers)
            for v, own, start, (_, added, _) in zip((t, s), self.own, starts, LANES, strict=True):
                np.copyto(v, own[lo : lo + self.BLOCK])
                np.add(v, start[at : at + width], out=v)
                _squared(v, u, added)
            t *= multiplier
            t += s
            t += 11
            _folded(t, u)
            _squared(t, u, offset)
            t *= multiplier
            t += FINISH + 11
            _folded(t, u)
            _squared(t, u, offset)
            _folded(t, u)
            t += 1  # between 1 and MODULUS + 3; those past MODULUS stand for 0 to 2 and turn negative in 32 bits
            drawn = t.astype(np.int32)
            here[:] = drawn >= POISSON_STEPS[0] + 1
            for step in POISSON_STEPS[1:]:
                np.add(here, (drawn >= step + 1).view(np.uint8), out=here)
        return out

    def each(self, reps: np.ndarray):
        """The counts of one replicate after another, a block of them drawn at once."""
        width = max(1, self.BLOCK // max(1, self.size))
        for lo in range(0, len(reps), width):
            yield from self(reps[lo : lo + width])


def _folded(v: np.ndarray, spare: np.ndarray) -> None:
    """``v`` by something smaller with the same remainder, in place."""
    np.right_shift(v, 31, out=spare)
    np.bitwise_and(v, MODULUS, out=v)
    np.add(v, spare, out=v)


def _squared(v: np.ndarray, spare: np.ndarray, offset: int) -> None:
    """The last step of a lane in place, folded."""
    np.add(v, offset, out=spare)
    np.multiply(v, spare, out=v)
    _folded(v, spare)


def _mix_sql(lane: int, h: str, x: str) -> str:
    multiplier, offset, high = LANES[lane]
    t = f"(({h} * {multiplier} + ({x}) % {MODULUS} + (({x}) // {MODULUS} % {MODULUS}) * {high} + 11) % {MODULUS})"
    return f"(({t} * ({t} + {offset})) % {MODULUS})"


def _lane_sql(lane: int, seed: int, keys) -> str:
    h = f"CAST({int(seed)} AS BIGINT)"
    for k in keys:
        h = _mix_sql(lane, h, f"CAST({k} AS BIGINT)")
    return h


def keyed_hash_sql(seed: int, *keys: str) -> str:
    """The same hash as SQL text (non-negative BIGINT keys)."""
    multiplier, offset, _ = LANES[0]
    # the lanes are below MODULUS, so that the second has no quotient to add
    t = f"(({_lane_sql(0, seed, keys)} * {multiplier} + {_lane_sql(1, seed, keys)} + 11) % {MODULUS})"
    both = f"(({t} * ({t} + {offset})) % {MODULUS})"
    return _mix_sql(0, both, str(FINISH))


def wide_hash_sql(seed: int, *keys: str) -> str:
    first, second = (_mix_sql(lane, _lane_sql(lane, seed, keys), str(FINISH)) for lane in (0, 1))
    return f"({first} * {MODULUS} + {second})"


def poisson_weight(h: Column) -> Column:
    """Poisson(1) count for a hash value: number of CDF steps at or below it."""
    steps = F.array(*[F.lit(s) for s in POISSON_STEPS])
    return _let(h, lambda v: F.size(F.filter(steps, lambda s: v >= s))).cast("bigint")


def poisson_weight_sql(h: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {h} >= {s} THEN 1 ELSE 0 END" for s in POISSON_STEPS) + ")"
