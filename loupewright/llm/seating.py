"""Gibbs sampling of how many tables serve a dish of a Pitman-Yor restaurant.

Given the numbers of customers and tables everywhere else, the chance that n customers of a dish sit at
a tables is proportional to S(n, a), the number of seatings (a generalised Stirling number of the
restaurant's discount), times what a more tables cost in the restaurant and in the one above it. These
chances are computed for all a and one a is drawn; nothing is seated one by one. Beyond ``ROWS``
customers, S comes from its saddle point (ratios within 2 %, but for the last few tables before a = n,
where they are off by 1 / (2 (n - a))), and a is drawn from a window around the likeliest value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Customers up to which the numbers of seatings come from the exact recurrence.
ROWS = 512
#: Values of a in a window, and how many deviations it spans.
WINDOW, SPAN = 96, 12.0
#: Candidates that are compared at a time.
CELLS = 1 << 17
#: Points between which the saddle point is interpolated.
NODES = 1 << 13

#: (positions, tables) -> log of the factor that one more table at each position brings from elsewhere.
Elsewhere = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Seatings:
    """Ratios of the numbers of seatings S(n, a) of n customers at a tables, for one discount."""

    def __init__(self, discount: float):
        self.discount = discount
        log = np.full((ROWS + 2, ROWS + 3), -np.inf)
        log[1, 1] = 0.0
        for n in range(1, ROWS + 1):
            a = np.arange(1, n + 2)
            stay = np.where(a <= n, np.log(np.maximum(n - discount * a, 1e-300)) + log[n, 1 : n + 2], -np.inf)
            log[n + 1, 1 : n + 2] = np.logaddexp(log[n, : n + 1], stay)
        with np.errstate(invalid="ignore"):
            self._table = log[: ROWS + 1, 1:] - log[: ROWS + 1, :-1]
            self._customer = log[1:] - log[:-1]
        # The saddle point depends on customers per table alone: both sides along log(1 - x).
        t = -np.logspace(-6, np.log10(60 / (1 - discount)), NODES)
        per_table = discount * -np.expm1(t) * np.exp((discount - 1) * t) / -np.expm1(discount * t)
        self._excess, self._height = np.log(per_table - 1), np.log(-np.expm1(discount * t) / discount)
        a = np.arange(1, ROWS)
        self._scale = a / ROWS**discount
        self._error = self._table[ROWS, 1:ROWS] - self._saddle(np.full(len(a), float(ROWS)), a.astype(float))

    def _saddle(self, n: np.ndarray, a: np.ndarray) -> np.ndarray:
        """log S(n, a + 1) / S(n, a) from the saddle point: S(n, a) a! / n! is a coefficient of ((1 - (1 - x)^d) / d)^a."""
        return np.interp(np.log(n / (a + 0.5) - 1), self._excess, self._height) - np.log(a)

    def one_more_table(self, n: np.ndarray, a: np.ndarray) -> np.ndarray:
        """log S(n, a + 1) / S(n, a) for 0 <= a <= n."""
        out = np.empty(len(n))
        exact = n <= ROWS
        out[exact] = self._table[n[exact], a[exact]]
        big = np.flatnonzero(~exact)
        if len(big):
            customers, tables = n[big].astype(float), np.clip(a[big], 1, n[big] - 1).astype(float)
            # What the saddle point lacks is small where tables are many, and else depends on a / n^d alone.
            lacking = np.interp(tables / customers**self.discount, self._scale, self._error, right=0.0)
            found = self._saddle(customers, tables) + np.where(tables < ROWS, lacking, 0.0)
            out[big] = np.where(a[big] < 1, np.inf, np.where(a[big] >= n[big], -np.inf, found))
        return out

    def one_more_customer(self, n: np.ndarray, a: np.ndarray) -> np.ndarray:
        """log S(n + 1, a) / S(n, a) for 1 <= a <= n."""
        out = np.empty(len(n))
        exact = n <= ROWS
        out[exact] = self._customer[n[exact], a[exact]]
        big = ~exact
        if big.any():
            fewer = np.exp(-self.one_more_table(n[big], a[big] - 1))
            out[big] = np.log(n[big] - self.discount * a[big] + fewer)
        return out


@lru_cache(maxsize=3)
def seatings(discount: float) -> Seatings:
    """One table per discount in a worker; a sweep uses three."""
    return Seatings(discount)


def _pick(size: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each run of ``size`` weights (logs), the place within the run of one drawn by its weight."""
    first = np.cumsum(size) - size
    chance = np.exp(weight - np.repeat(np.maximum.reduceat(weight, first), size))
    upto = np.cumsum(chance)
    start = upto[first] - chance[first]
    last = first + size - 1
    wanted = start + (1 - rng.random(len(size))) * (upto[last] - start)
    return np.clip(np.searchsorted(upto, wanted), first, last) - first


def draw(n: np.ndarray, least: np.ndarray, own: Seatings, elsewhere: Elsewhere, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish with n customers, at least ``least``, drawn by their chances."""
    tables = np.minimum(np.maximum(least, 1), n)
    open_ = tables < n
    small = np.flatnonzero(open_ & (n <= ROWS))
    cut = np.searchsorted(np.cumsum((n - tables + 1)[small]), np.arange(CELLS, int((n - tables + 1)[small].sum()) + CELLS, CELLS), "right")
    for at in np.split(small, np.unique(cut)):
        if not len(at):
            continue
        size = (n - tables + 1)[at]
        first = np.cumsum(size) - size
        place = np.repeat(at, size)
        a = tables[place] + np.arange(len(place)) - np.repeat(first, size)
        step = np.zeros(len(place))
        more = a < n[place]
        step[more] = own.one_more_table(n[place[more]], a[more]) + elsewhere(place[more], a[more])
        total = np.cumsum(step) - step
        tables[at] += _pick(size, total - np.repeat(total[first], size), rng)
    big = np.flatnonzero(open_ & (n > ROWS))
    for at in np.split(big, range(CELLS // WINDOW, len(big), CELLS // WINDOW)):
        if len(at):
            tables[at] = _draw_near(at, n[at], tables[at], own, elsewhere, rng)
    return tables


def _draw_near(at: np.ndarray, n: np.ndarray, least: np.ndarray, own: Seatings, elsewhere: Elsewhere, rng: np.random.Generator) -> np.ndarray:
    """``draw`` from windows around the likeliest numbers; the chances have one peak."""

    def slope(a: np.ndarray) -> np.ndarray:
        return own.one_more_table(n, a) + elsewhere(at, a)

    low, high = least.copy(), n - 1  # the first a where one more table is less likely
    while (low < high).any():
        middle = (low + high) // 2
        rises = slope(middle) > 0
        low, high = np.where(rises, np.minimum(middle + 1, high), low), np.where(rises, high, middle)
    reach = np.maximum(1, np.minimum(low // 8, np.minimum(n - 1 - low, low - least)))
    bend = np.maximum((slope(np.maximum(low - reach, least)) - slope(np.minimum(low + reach, n - 1))) / (2 * reach), 1e-12)
    stride = np.maximum(1, np.ceil(SPAN / np.sqrt(bend) / WINDOW)).astype(np.int64)
    start = np.maximum(least, low - stride * (WINDOW // 2))
    size = np.minimum(WINDOW, (n - start) // stride + 1)
    place = np.repeat(np.arange(len(at)), size)
    first = np.cumsum(size) - size
    a = start[place] + (np.arange(len(place)) - np.repeat(first, size)) * stride[place]
    between = np.minimum(a + stride[place] // 2, n[place] - 1)
    step = stride[place] * (own.one_more_table(n[place], between) + elsewhere(at[place], between))
    total = np.cumsum(step) - step
    picked = start + stride * _pick(size, total - np.repeat(total[first], size), rng)
    return np.clip(picked + rng.integers(0, stride) - stride // 2, least, n)
