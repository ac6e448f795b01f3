"""Integer voice-activity functions in fixed point: model likelihood, halving filter, tracked minimum."""

from __future__ import annotations

from bisect import insort_right
from collections import deque

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: log2(e) in Q12; the exponent from which a likelihood is 0; all-pass coefficients in Q13; smoothing
#: factors 0.2 and 0.99 in Q15; how many low values are kept, for how many frames, and the mean at the start.
LOG2_E_Q12, ZERO_FROM, ALL_PASS_Q13 = 5909, 22005, (5243, 1392)
DOWN_Q15, UP_Q15, KEPT, AGE, START = 6553, 32439, 16, 100, 1600


def gaussian_likelihood(x: Column, mean: Column, std: Column) -> Column:
    """struct(prob, delta): 1/s e^(-(x-m)^2 / 2s^2) in Q20 and (x-m)/s^2 in Q11 for x in Q4, m and s in Q7."""
    x, mean, std = (c.cast("bigint") for c in (x, mean, std))
    inverse = F.floor((F.lit(131072) + F.shiftright(std, 1)) / std)
    inverse_sq = F.shiftright(F.pow(F.shiftright(inverse, 2).cast("double"), 2.0).cast("bigint"), 2)
    distance = x * 8 - mean
    delta = F.pmod(F.shiftright(inverse_sq * distance, 10) + 32768, F.lit(65536)) - 32768  # kept to 16 bits
    exponent = F.shiftright(delta * distance, 9)
    power = F.shiftright(exponent * LOG2_E_Q12, 12)  # of two, in Q10: 2^-p is a mantissa in [1, 2) shifted right
    mantissa, halvings = F.pmod(-power, F.lit(1024)) + 1024, F.ceil(power / 1024)
    e = F.when(exponent < ZERO_FROM, F.floor(mantissa / F.pow(F.lit(2.0), halvings))).otherwise(0)
    return F.struct((inverse * e).cast("int").alias("prob"), delta.cast("int").alias("delta"))


def halve_rate(x: np.ndarray, state: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, tuple[int, int]]:
    """Every two samples become one: two all-pass branches, one on the even and one on the odd samples, are added."""
    out = np.zeros(len(x) // 2, np.int64)
    ends = []
    for branch, (coefficient, s) in enumerate(zip(ALL_PASS_Q13, state)):
        for n, v in enumerate(x[branch : 2 * len(out) : 2].tolist()):
            y = (s >> 1) + (coefficient * v >> 14)
            s = v - (coefficient * y >> 12)
            out[n] += y
        ends.append(s)
    return out, (ends[0], ends[1])


class TrackedMinimum:
    """Smoothed low value of a feature: the lowest values of the last AGE calls are kept in order; their third stands
    for the floor, which the mean follows quickly down and slowly up."""

    def __init__(self):
        self.low: list[int] = []
        self.born: deque[tuple[int, int]] = deque()
        self.calls, self.mean = 0, START

    def update(self, value: int, frame: int) -> int:
        self.calls += 1
        while self.born and self.born[0][0] <= self.calls - AGE:
            old = self.born.popleft()[1]
            if old in self.low:
                self.low.remove(old)
        insort_right(self.low, value)
        self.born.append((self.calls, value))
        del self.low[KEPT:]
        at = lambda i: self.low[i] if i < len(self.low) else 10_000
        floor = at(2) if frame > 2 else at(0) if frame else START
        a = 0 if not frame else DOWN_Q15 if floor < self.mean else UP_Q15
        self.mean = ((a + 1) * self.mean + (32767 - a) * floor + 16384) >> 15
        return self.mean
