"""Hurwitz zeta and discrete power-law helpers on numpy arrays, used inside Spark tasks."""

from __future__ import annotations

import numpy as np

DIRECT_TERMS = 12
KS_CELLS = 1_000_000  # values of tails that are compared at a time
EXACT = 2.0**52
# Bernoulli numbers B2, B4, … B12 over their factorials.
BERNOULLI = (
    1 / 6 / 2,
    -1 / 30 / 24,
    1 / 42 / 720,
    -1 / 30 / 40320,
    5 / 66 / 3628800,
    -691 / 2730 / 479001600,
)


def scaled_hurwitz(s, a):
    """Sum of ``((a + i) / a) ** -s`` over i ≥ 0 (s > 1), by Euler–Maclaurin summation.

    It neither over- nor underflows, however large the exponent.
    """
    s, a = np.broadcast_arrays(np.asarray(s, float), np.asarray(a, float))
    total = np.zeros(s.shape)
    for i in range(DIRECT_TERMS):
        total += ((a + i) / a) ** -s
    end = a + DIRECT_TERMS
    last = (end / a) ** -s
    total += last * (end / (s - 1) + 0.5)
    rising = s.copy()
    for j, b in enumerate(BERNOULLI):
        total += b * rising * last * end ** (-2.0 * j - 1)
        rising = rising * (s + 2 * j + 1) * (s + 2 * j + 2)
    return total


def hurwitz(s, a):
    """Sum of ``(a + i) ** -s`` over i ≥ 0 (s > 1)."""
    return np.asarray(a, float) ** -np.asarray(s, float) * scaled_hurwitz(s, a)


def best_gamma(xmin, size, log_sum, low=1.0001, high=1000.0, rounds=70):
    """Exponents that maximise the likelihood of tails given by size and sum of ln x.

    Where the likelihood has no maximum between ``low`` and ``high``, as for a tail of one value,
    the exponent is NaN: there is no fit.
    """
    mean_log = np.asarray(log_sum, float) / np.asarray(size, float)

    def loss(g):
        return np.log(scaled_hurwitz(g, xmin)) + g * (mean_log - np.log(xmin))

    shrink = (np.sqrt(5) - 1) / 2
    left = np.full(mean_log.shape, low)
    right = np.full(mean_log.shape, high)
    for _ in range(rounds):  # the loss is convex in the exponent
        a = right - shrink * (right - left)
        b = left + shrink * (right - left)
        lower = loss(a) < loss(b)
        right = np.where(lower, b, right)
        left = np.where(lower, left, a)
    found = (left + right) / 2
    return np.where((found - low < 1e-4) | (high - found < 1e-4), np.nan, found)


def tail_sizes(values, counts):
    """Size and sum of logs of the tail that starts at each distinct value."""
    logs = counts * np.log(values)
    return np.cumsum(counts[::-1])[::-1], np.cumsum(logs[::-1])[::-1]


def ks_distances(values, counts, starts, gammas, cells=KS_CELLS):
    """Largest gap between data and model CDF over each tail ``values[start:]``.

    The tails are laid end to end, up to ``cells`` values (one tail at least) at a time.
    """
    starts, gammas = np.asarray(starts, int), np.asarray(gammas, float)
    upto, found, begin = np.cumsum(counts), np.empty(len(starts)), 0
    while begin < len(starts):
        ends = np.cumsum(len(values) - starts[begin:])
        end = begin + max(1, int(np.searchsorted(ends, cells, side="right")))
        start, gamma = starts[begin:end], gammas[begin:end]
        sizes = len(values) - start
        first = np.cumsum(sizes) - sizes

        def along(one):
            return np.repeat(one, sizes)  # noqa: B023

        place = np.arange(sizes.sum()) - along(first - start)
        before = upto[start] - counts[start]
        data = (upto[place] - along(before)) / along(upto[-1] - before)
        x, least, g = values[place], values[start], along(gamma)
        beyond = ((x + 1) / along(least)) ** -g * scaled_hurwitz(g, x + 1) / along(scaled_hurwitz(gamma, least))
        found[begin:end] = np.maximum.reduceat(np.abs(data - (1 - beyond)), first)
        begin = end
    return found


def draw(uniform, gamma, kmin):
    """Power-law integers ≥ kmin: the k with P(X ≥ k+1) < 1 − u ≤ P(X ≥ k).

    Beyond 2**52, where doubles are no longer all integers, the leading term of the tail is
    inverted instead; a draw beyond 64 bits is an error.
    """
    u = np.asarray(uniform, float)
    kmin = float(kmin)

    def tail(k):
        return (k / kmin) ** -gamma * scaled_hurwitz(gamma, k)

    target = (1 - u) * tail(kmin)
    low = np.full(u.shape, kmin)
    high = low * 2
    open_rows = tail(high) >= target
    while open_rows.any():
        low = np.where(open_rows, high, low)
        high = np.where(open_rows, high * 2, high)
        open_rows &= high < EXACT
        open_rows &= tail(high) >= target
    far = (high >= EXACT) & (tail(EXACT) >= target)
    high = np.where(far, low + 1, high)
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        above = tail(middle) >= target
        wide = high - low > 1
        low = np.where(wide & above, middle, low)
        high = np.where(wide & ~above, middle, high)
    if far.any():
        low[far] = np.exp((gamma * np.log(kmin) - np.log((gamma - 1) * target[far])) / (gamma - 1))
        if not (low[far] < 2.0**63).all():
            raise OverflowError("a draw lies beyond 64 bits; the exponent is too close to 1")
    return low.astype("int64")
