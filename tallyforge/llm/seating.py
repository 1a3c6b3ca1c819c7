"""How many tables the customers of a dish hold in a Pitman-Yor restaurant.

In the Chinese-restaurant seating of a restaurant with discount d and strength a, the dishes
are bound together by the number T of all its tables only.  Given a draw x ~ Gamma(a/d + T)
they are independent, and c customers of a dish sit at t tables with weight

    S(c, t) * theta^t,    theta = d * x * p(dish in the parent)

where S counts the seatings (generalised Stirling numbers of discount d).  Removing and
reseating the customers of the dish one at a time, for ever, ends in this law; ``draw_tables``
draws from it at once.  Up to ``EXACT`` customers it is tabulated; beyond, its mean and
variance are those of the compound Poisson process that the weights belong to (a table's size
is one of its jumps), and t - 1 is drawn from the binomial or normal law with them.

All draws come from hashes, so they don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np

from .common import mix

EXACT = 1024
_GRID = 256  # tables at most that are looked at one by one beyond EXACT


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key."""
    x = mix(mix(keys ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def gamma(shape: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """A Gamma variable for each key, shapes of 1 at least (squeezed normals, refused and drawn again)."""
    out = np.zeros(len(shape))
    todo = np.arange(len(shape))
    while len(todo):
        u1, u2, u3 = (uniform(keys[todo], 3 * salt + i) for i in range(3))
        salt += 1_000_003
        d = shape[todo] - 1 / 3
        z = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + z / np.sqrt(9 * d)) ** 3
        good = v > 0
        good[good] = np.log(u3[good]) < z[good] ** 2 / 2 + d[good] * (1 - v[good] + np.log(v[good]))
        out[todo[good]] = (d * v)[good]
        todo = todo[~good]
    return out


@functools.lru_cache(maxsize=4)
def log_seatings(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0
    for c in range(EXACT):
        old = np.log(np.maximum(c - discount * np.arange(c + 1), 1e-300)) + out[c, : c + 1]
        out[c + 1, 1 : c + 2] = np.logaddexp(np.append(old[1:], -np.inf), out[c, : c + 1]) if c else 0.0
    return out


def moments(count: np.ndarray, theta: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t - 1 for many customers, from the tilt at which the jumps of the
    process add up to ``count`` on average."""
    low, high = np.full(len(count), -200.0), np.full(len(count), -1e-12)
    for _ in range(70):
        y = (low + high) / 2
        more = np.log(theta) + np.log(-np.expm1(y)) + (discount - 1) * y > np.log(count)
        low, high = np.where(more, y, low), np.where(more, high, y)
    y = np.exp(high)
    mean = theta * -np.expm1(discount * high) / discount
    spread = count + theta * (1 - discount) * (1 - y) ** 2 * y ** (discount - 2)
    return mean, np.clip(mean - count**2 / spread, 1e-9, mean * (1 - 1e-9))


def _many(count: np.ndarray, theta: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    mean, var = moments(count.astype(np.float64), theta, discount)
    out = np.ones(len(count))
    wide = mean > _GRID / 4
    if wide.any():
        normal = NormalDist()
        out[wide] += np.rint(mean[wide] + np.sqrt(var[wide]) * np.array([normal.inv_cdf(x) for x in u[wide]]))
    small = np.flatnonzero(~wide)
    if len(small):
        m, v = mean[small][:, None], var[small][:, None]
        size = m * m / (m - v)  # of the binomial law with this mean and variance
        k = np.arange(_GRID)
        step = np.log(np.maximum(size - k, 1e-300)) - np.log(k + 1) + np.log(m / (size - m).clip(1e-12))
        weight = np.concatenate([np.zeros((len(small), 1)), np.cumsum(np.where(size > k, step, -np.inf), axis=1)], axis=1)
        total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        out[small] += (total < u[small][:, None] * total[:, -1:]).sum(axis=1)
    return np.clip(out, 1, count).astype(np.int64)


def draw_tables(count: np.ndarray, theta: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables of ``count`` customers of each dish (none for none, one for one)."""
    tables = (count > 0).astype(np.int64)
    live = np.flatnonzero(count > 1)
    if not len(live):
        return tables
    seatings = log_seatings(discount)
    live = live[np.argsort(count[live], kind="stable")]
    c = count[live]
    u, log_theta = uniform(keys[live], salt), np.log(theta[live])
    cut = np.flatnonzero(np.diff(c)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(c)], strict=True):
        n = int(c[a])
        if n > EXACT:
            tables[live[a:]] = _many(c[a:], theta[live[a:]], discount, u[a:])
            break
        t = np.arange(1, n + 1)
        for lo in range(a, b, max(1, 1_000_000 // n)):
            part = slice(lo, min(b, lo + max(1, 1_000_000 // n)))
            weight = seatings[n, 1 : n + 1] + log_theta[part, None] * t
            total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[live[part]] = 1 + (total < u[part, None] * total[:, -1:]).sum(axis=1)
    return tables


def mean_tables(count: int, theta: float, discount: float) -> tuple[float, float]:
    """Mean and standard deviation of the tabulated law."""
    t = np.arange(1, count + 1)
    w = log_seatings(discount)[count, 1 : count + 1] + t * math.log(theta)
    w = np.exp(w - w.max())
    m = (w * t).sum() / w.sum()
    return m, math.sqrt((w * t * t).sum() / w.sum() - m * m)
