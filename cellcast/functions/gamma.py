"""Numpy helpers for gamma fits, used inside Arrow batches only."""

from __future__ import annotations

import math

import numpy as np


def _digamma(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of positive numbers: recurrence up to 8, then the asymptotic series."""
    a = np.array(a, float)
    low, slope = np.zeros_like(a), np.zeros_like(a)
    while (small := a < 8).any():
        low[small] -= 1 / a[small]
        slope[small] += 1 / (a[small] * a[small])
        a[small] += 1
    r = 1 / (a * a)
    psi = np.log(a) - 0.5 / a - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
    tri = (1 / a) * (1 + 0.5 / a + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30))))
    return low + psi, slope + tri


def _profile(x: np.ndarray, starts: np.ndarray, loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood, shape and scale of the best gamma of each sample at a given location.

    ``x`` holds all samples one after the other, ``starts`` where each begins. Shapes follow by Newton steps, all samples
    at once; a sample that has settled keeps its shape.
    """
    counts = np.diff(np.append(starts, len(x)))
    y = x - np.repeat(loc, counts)
    mean = np.add.reduceat(y, starts) / counts
    logs = np.add.reduceat(np.log(y), starts) / counts
    gap = np.log(mean) - logs
    score, shape = np.full(len(starts), -np.inf), np.full(len(starts), np.nan)
    known = gap > 0
    g = gap[known]
    a = (3 - g + np.sqrt((g - 3) ** 2 + 24 * g)) / (12 * g)
    going = np.arange(len(a))
    for _ in range(60):
        if not len(going):
            break
        now = a[going]
        psi, tri = _digamma(now)
        step = (np.log(now) - psi - g[going]) / (1 / now - tri)
        fresh = np.where(step < now, now - step, now / 2)
        a[going] = fresh
        going = going[np.abs(fresh - now) > 1e-13 * now]
    shape[known] = a
    scale = mean / shape
    score[known] = (a - 1) * logs[known] - a - a * np.log(scale[known]) - _each(math.lgamma, a)
    return score, shape, scale


#: Search range of the location: this many sample ranges below the minimum, at least and at most.
NEAREST, FARTHEST = 1e-6, 30.0


def fit_profiles(x: np.ndarray, starts: np.ndarray):
    """Three-parameter gamma of many samples by maximum likelihood: (shape, location, scale, inner), NaN for degenerate samples.

    ``x`` holds the finite values of all samples, ``starts`` where each begins (none is empty). At a fixed location shape and
    scale follow from the sums of x and log x by Newton steps, which leaves one dimension: a grid over the logarithm of
    the distance to the minimum, then golden sections to machine precision, all samples in step. Shapes below one are
    left out, as the likelihood grows without bound there. Samples skewed to the left have no inner maximum (``inner`` is false);
    the far end is almost a normal distribution.
    """
    x, starts = np.asarray(x, float), np.asarray(starts, np.int64)
    counts = np.diff(np.append(starts, len(x)))
    out = np.full((3, len(starts)), np.nan)
    inner = np.zeros(len(starts), bool)
    low = np.minimum.reduceat(x, starts) if len(x) else np.empty(0)
    width = (np.maximum.reduceat(x, starts) if len(x) else low) - low
    fit = (counts >= 3) & (width > 0)
    if not fit.any():
        return (*out, inner)
    x, low, width = x[np.repeat(fit, counts)], low[fit], width[fit]
    starts = np.append(0, np.cumsum(counts[fit])[:-1])
    at = lambda u: _profile(x, starts, low - width * np.exp(u))
    grid = np.linspace(math.log(NEAREST), math.log(FARTHEST), 60)
    scores = np.empty((len(grid), len(starts)))
    for k, u in enumerate(grid):
        score, shape, _ = at(np.full(len(starts), u))
        scores[k] = np.where(shape >= 1, score, -np.inf)
    best = scores.argmax(0)
    found = scores.max(0) > -np.inf
    left, right = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    c, d = right - golden * (right - left), left + golden * (right - left)
    fc, fd = at(c)[0], at(d)[0]
    while (right - left).max() > 1e-8:
        lower = fc > fd
        left, right = np.where(lower, left, c), np.where(lower, d, right)
        probe = np.where(lower, right - golden * (right - left), left + golden * (right - left))
        value = at(probe)[0]
        c, d = np.where(lower, probe, d), np.where(lower, c, probe)
        fc, fd = np.where(lower, value, fd), np.where(lower, fc, value)
    u = (left + right) / 2
    _, shape, scale = at(u)
    edge = (u > grid[0] + 1e-6) & (u < grid[-1] - 1e-6) & (shape >= 1) & found
    out[:, fit] = np.where(found, np.stack([shape, low - width * np.exp(u), scale]), np.nan)
    inner[fit] = edge
    return (*out, inner)


def fit_profile(x: np.ndarray):
    """Parameters of one sample by ``fit_profiles``, and whether the maximum is an inner one; None for a degenerate sample."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return None, False
    shape, loc, scale, inner = (v[0] for v in fit_profiles(x, np.zeros(1, np.int64)))
    return (None, False) if math.isnan(shape) else ((float(shape), float(loc), float(scale)), bool(inner))


def fit_mle(x: np.ndarray):
    """Shape, location and scale of ``fit_profile``, or None."""
    return fit_profile(x)[0]


def fit_thom(x: np.ndarray):
    """Closed-form two-parameter fit of the positive values (Thom 1958)."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x) & (x > 0)]
    if len(x) < 3 or np.ptp(x) == 0:
        return None
    gap = math.log(x.mean()) - np.log(x).mean()
    shape = (1 + math.sqrt(1 + 4 * gap / 3)) / (4 * gap)
    return float(shape), 0.0, float(x.mean() / shape)


def cdf(x: np.ndarray, shape, loc, scale) -> np.ndarray:
    """Gamma distribution function, elementwise; NaN where an input is NaN."""
    x, a, loc, scale = np.broadcast_arrays(
        *[np.asarray(v, float) for v in (x, shape, loc, scale)]
    )
    with np.errstate(all="ignore"):
        z = (x - loc) / scale
    out = np.full(z.shape, np.nan)
    known = np.isfinite(z) & np.isfinite(a)
    out[known & (z <= 0)] = 0.0
    large = known & (z > 0) & (a >= LARGE_SHAPE)
    out[large] = _quadrature(a[large], z[large])
    low = known & (z > 0) & (z < a + 1) & ~large
    out[low] = _lower_series(a[low], z[low])
    high = known & (z > 0) & (z >= a + 1) & ~large
    out[high] = 1.0 - _upper_fraction(a[high], z[high])
    return out


# Coefficients of Acklam's rational approximation to the normal quantile.
_MIDDLE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_MIDDLE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                  6.680131188771972e01, -1.328068155288572e01, 1.0]
_TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
                3.754408661907416e00, 1.0]


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile, about 1e-9 relative; infinite at 0 and 1, NaN for NaN."""
    p = np.asarray(p, float)
    with np.errstate(all="ignore"):
        q = p - 0.5
        r = q * q
        middle = np.polyval(_MIDDLE_TOP, r) * q / np.polyval(_MIDDLE_BOTTOM, r)
        t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        tail = np.polyval(_TAIL_TOP, t) / np.polyval(_TAIL_BOTTOM, t)
        out = np.where(np.abs(q) <= 0.47575, middle, np.where(q < 0, tail, -tail))
    out = np.where(p <= 0, -np.inf, out)
    return np.where(p >= 1, np.inf, out)


def standard_score(x, shape, loc, scale, limit: float) -> np.ndarray:
    """Normal quantile of the gamma probability, bounded to +-limit."""
    return np.clip(normal_quantile(cdf(x, shape, loc, scale)), -limit, limit)


def _each(fn, values) -> np.ndarray:
    """Scalar math function over an array (module-level ufuncs would not pickle)."""
    return np.fromiter((fn(v) for v in values), float, len(values))


def _front(a, z):
    values, index = np.unique(a, return_inverse=True)
    return np.exp(a * np.log(z) - z - _each(math.lgamma, values)[index]) if len(a) else a


#: From this shape on the integral is summed over fixed nodes, as series and fraction take a number of steps that grows with its root.
LARGE_SHAPE = 100.0
_NODES = 32


def _quadrature(a, z):
    """Distribution function for large shapes: Gauss-Legendre nodes from ``z`` outwards, to where the density has vanished."""
    peak, width = a - 1, np.sqrt(a - 1)
    above = z > peak
    end = np.where(
        above, np.maximum(peak + 11.5 * width, z + 6 * width), np.maximum(0.0, np.minimum(peak - 7.5 * width, z - 5 * width))
    )
    total = np.zeros_like(z)
    for node, weight in zip(*np.polynomial.legendre.leggauss(_NODES)):
        u = (z + (end - z) * (0.5 + 0.5 * node) - peak) / peak
        total += 0.5 * weight * np.exp(-peak * (u - np.log1p(u)))
    # Height of the density at its peak, by Stirling's series.
    r = 1 / peak
    height = np.exp(-r * (1 / 12 - r * r * (1 / 360 - r * r / 1260))) / (np.sqrt(2 * np.pi) * width)
    part = total * np.abs(end - z) * height
    return np.where(above, 1.0 - part, part)


#: Steps between two looks at which elements are settled.
_STEPS = 8


def _lower_series(a, z):
    """Power series of the regularised lower incomplete gamma function; settled elements are put aside."""
    out = np.full_like(z, np.nan)
    at, x, k = np.arange(len(z)), z, a.copy()
    term = 1.0 / a
    total = term.copy()
    for step in range(1, 100001):
        if not len(at):
            break
        k = k + 1
        term = term * x / k
        total = total + term
        if step % _STEPS:
            continue
        done = np.abs(term) <= np.abs(total) * 1e-16
        out[at[done]] = total[done]
        at, x, k, term, total = (v[~done] for v in (at, x, k, term, total))
    return out * _front(a, z)


def _upper_fraction(a, z):
    """Continued fraction of the regularised upper function (modified Lentz); settled elements are put aside."""
    tiny = 1e-300
    out = np.full_like(z, np.nan)
    at, shape = np.arange(len(z)), a
    b = z + 1 - a
    c = np.full_like(z, 1 / tiny)
    d = 1 / np.where(b == 0, tiny, b)
    h = d.copy()
    for i in range(1, 100000):
        if not len(at):
            break
        an = -i * (i - shape)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        delta = d * c
        h = h * delta
        if i % _STEPS:
            continue
        done = np.abs(delta - 1) < 1e-15
        out[at[done]] = h[done]
        at, shape, b, c, d, h = (v[~done] for v in (at, shape, b, c, d, h))
    return out * _front(a, z)
