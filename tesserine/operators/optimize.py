"""Roots and minima of scalar functions; the function may run a Spark aggregate."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np


class NoConvergence(RuntimeError):
    pass


def brentq(f: Callable[[float], float], a: float, b: float, xtol: float = 2e-12, rtol: float = 8.881784197001252e-16, maxiter: int = 100) -> float:
    """A root inside a bracket: inverse quadratic steps where they pay, bisection where they don't."""
    fa, fb = f(a), f(b)
    if fa == 0:
        return a
    if fb == 0:
        return b
    if (fa > 0) == (fb > 0):
        raise ValueError("the ends have one sign")
    c, fc, d = a, fa, b - a
    e = d
    for _ in range(maxiter):
        if (fb > 0) == (fc > 0):
            c, fc, d = a, fa, b - a
            e = d
        if abs(fc) < abs(fb):
            a, b, c, fa, fb, fc = b, c, b, fb, fc, fb
        tol, half = (xtol + rtol * abs(b)) / 2, (c - b) / 2
        if abs(half) <= tol or fb == 0:
            return b
        if abs(e) >= tol and abs(fa) > abs(fb):
            s = fb / fa
            if a == c:
                p, q = 2 * half * s, 1 - s
            else:
                q, r = fa / fc, fb / fc
                p, q = s * (2 * half * q * (q - r) - (b - a) * (r - 1)), (q - 1) * (r - 1) * (s - 1)
            p, q = (abs(p), -q if p > 0 else q)
            if 2 * p < min(3 * half * q - abs(tol * q), abs(e * q)):
                e, d = d, p / q
            else:
                d = e = half
        else:
            d = e = half
        a, fa = b, fb
        b += d if abs(d) > tol else math.copysign(tol, half)
        fb = f(b)
    raise NoConvergence(f"no root after {maxiter} steps")


def newton(f: Callable[[float], float], x0: float, fprime: Callable[[float], float] | None = None, tol: float = 1.48e-8, maxiter: int = 50) -> float:
    """Newton's steps, or the secant's without a derivative."""
    x = x0
    if fprime is not None:
        for _ in range(maxiter):
            slope = fprime(x)
            if slope == 0:
                raise NoConvergence("the slope is 0")
            new = x - f(x) / slope
            if abs(new - x) <= tol:
                return new
            x = new
        raise NoConvergence(f"no root after {maxiter} steps")
    y = x0 * (1 + 1e-4) + (1e-4 if x0 >= 0 else -1e-4)
    fx, fy = f(x), f(y)
    for _ in range(maxiter):
        if fy == fx:
            if y != x:
                raise NoConvergence("the secant is flat")
            return y
        new = y - fy * (y - x) / (fy - fx)
        if abs(new - y) <= tol:
            return new
        x, fx, y = y, fy, new
        fy = f(y)
    raise NoConvergence(f"no root after {maxiter} steps")


def root_scalar(f, method: str = "brentq", bracket: tuple[float, float] | None = None, x0: float | None = None, fprime=None, **options) -> float:
    if method == "brentq":
        return brentq(f, *bracket, **options)
    return newton(f, x0, fprime if method == "newton" else None, **options)


def nelder_mead(f: Callable[[np.ndarray], float], x0, xatol: float = 1e-4, fatol: float = 1e-4, maxiter: int | None = None) -> tuple[np.ndarray, float, int]:
    """(minimum, value, steps) by a simplex that reflects, stretches and shrinks."""
    x0 = np.asarray(x0, float)
    n = len(x0)
    simplex = [x0] + [x0 + np.eye(n)[k] * (0.05 * x0[k] if x0[k] else 0.00025) for k in range(n)]
    points = sorted(((f(p), k, p) for k, p in enumerate(simplex)), key=lambda t: t[:2])
    points = [(v, p) for v, _, p in points]
    for step in range(maxiter or 200 * n):
        if max(np.abs(p - points[0][1]).max() for _, p in points) <= xatol and points[-1][0] - points[0][0] <= fatol:
            return points[0][1], points[0][0], step
        centre, worst = np.mean([p for _, p in points[:-1]], axis=0), points[-1]
        mirrored = 2 * centre - worst[1]
        fm = f(mirrored)
        if fm < points[0][0]:
            far = 3 * centre - 2 * worst[1]
            ff = f(far)
            points[-1] = (ff, far) if ff < fm else (fm, mirrored)
        elif fm < points[-2][0]:
            points[-1] = (fm, mirrored)
        else:
            near = centre + 0.5 * ((mirrored if fm < worst[0] else worst[1]) - centre)
            fn = f(near)
            if fn < min(fm, worst[0]):
                points[-1] = (fn, near)
            else:
                best = points[0][1]
                points = [points[0]] + [(f(q), q) for q in (best + 0.5 * (p - best) for _, p in points[1:])]
        points.sort(key=lambda t: t[0])
    return points[0][1], points[0][0], maxiter or 200 * n


def lbfgs(f, x0, jac=None, m: int = 10, gtol: float = 1e-5, ftol: float = 1e-12, maxiter: int = 500) -> tuple[np.ndarray, float, int]:
    """(minimum, value, steps) by limited-memory quasi-Newton steps; ``f`` alone returns (value, gradient) without ``jac``."""
    both = (lambda x: (f(x), np.asarray(jac(x), float))) if jac is not None else f
    x = np.asarray(x0, float)
    v, g = both(x)
    kept: deque = deque(maxlen=m)
    for step in range(maxiter):
        if np.abs(g).max() <= gtol:
            return x, v, step
        q, alphas = g.copy(), []
        for s, y, r in reversed(kept):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if kept:
            s, y, _ = kept[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(kept, reversed(alphas)):
            q += s * (a - r * (y @ q))
        if g @ q <= 0:
            q, kept = g.copy(), deque(maxlen=m)
        t = 1.0 if kept else min(1.0, 1 / np.abs(g).sum())
        while True:
            new = x - t * q
            nv, ng = both(new)
            if nv <= v - 1e-4 * t * (g @ q) or t < 1e-16:
                break
            t /= 2
        s, y = new - x, ng - g
        if s @ y > 1e-12:
            kept.append((s, y, 1 / (s @ y)))
        done = abs(v - nv) <= ftol * max(abs(v), abs(nv), 1)
        x, v, g = new, nv, ng
        if done:
            return x, v, step + 1
    return x, v, maxiter


def minimize(f, x0, method: str = "nelderMead", jac=None, **options):
    return nelder_mead(f, x0, **options) if method == "nelderMead" else lbfgs(f, x0, jac, **options)


nelderMead = nelder_mead
