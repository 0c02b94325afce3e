"""Exact polynomials over the rationals, the lowest coefficient first."""

from __future__ import annotations

import math
from fractions import Fraction


class RationalPoly:
    def __init__(self, coefficients):
        c = [Fraction(x) for x in coefficients]
        while c and c[-1] == 0:
            c.pop()
        self.c = tuple(c)

    @property
    def degree(self) -> int:
        return len(self.c) - 1

    @staticmethod
    def monomial(a, d: int) -> RationalPoly:
        return RationalPoly([0] * d + [a])

    def __eq__(self, o):
        return isinstance(o, RationalPoly) and self.c == o.c

    def __hash__(self):
        return hash(self.c)

    def __add__(self, o):
        n = max(len(self.c), len(o.c))
        at = lambda c, k: c[k] if k < len(c) else 0
        return RationalPoly([at(self.c, k) + at(o.c, k) for k in range(n)])

    def __neg__(self):
        return RationalPoly([-x for x in self.c])

    def __sub__(self, o):
        return self + -o

    def __mul__(self, o):
        if not isinstance(o, RationalPoly):
            return RationalPoly([x * Fraction(o) for x in self.c])
        out = [Fraction(0)] * max(len(self.c) + len(o.c) - 1, 0)
        for i, a in enumerate(self.c):
            for j, b in enumerate(o.c):
                out[i + j] += a * b
        return RationalPoly(out)

    def divmod(self, o) -> tuple[RationalPoly, RationalPoly]:
        if not o.c:
            raise ZeroDivisionError("division by the zero polynomial")
        rest, q = list(self.c), [Fraction(0)] * max(len(self.c) - len(o.c) + 1, 0)
        for k in range(len(q) - 1, -1, -1):
            q[k] = rest[k + len(o.c) - 1] / o.c[-1]
            for j, b in enumerate(o.c):
                rest[k + j] -= q[k] * b
        return RationalPoly(q), RationalPoly(rest)

    def __floordiv__(self, o):
        return self.divmod(o)[0]

    def __mod__(self, o):
        return self.divmod(o)[1]

    def __pow__(self, n: int):
        out = RationalPoly([1])
        for _ in range(n):
            out = out * self
        return out

    def monic(self):
        return self * (1 / self.c[-1]) if self.c else self

    def gcd(self, o):
        a, b = self, o
        while b.c:
            a, b = b, a % b
        return a.monic()

    def derivative(self):
        return RationalPoly([k * x for k, x in enumerate(self.c)][1:])

    def integral(self):
        return RationalPoly([0] + [x / (k + 1) for k, x in enumerate(self.c)])

    def __call__(self, x):
        out = 0 if not self.c else self.c[-1]
        for a in reversed(self.c[:-1]):
            out = out * x + a
        return out

    def compose(self, o):
        out = RationalPoly([])
        for a in reversed(self.c):
            out = out * o + RationalPoly([a])
        return out

    def resultant(self, o) -> Fraction:
        """By Euclid's remainders."""
        if not self.c or not o.c:
            return Fraction(0)
        if o.degree == 0:
            return o.c[0] ** self.degree
        if self.degree < o.degree:
            return (-1) ** (self.degree * o.degree) * o.resultant(self)
        r = self % o
        if not r.c:
            return Fraction(0)
        return (-1) ** (self.degree * o.degree) * o.c[-1] ** (self.degree - r.degree) * o.resultant(r)

    def rational_roots(self) -> list[Fraction]:
        if not self.c:
            return []
        scale = math.lcm(*(x.denominator for x in self.c))
        whole = [int(x * scale) for x in self.c]
        zeros = next(k for k, x in enumerate(whole) if x)
        divisors = lambda n: [d for d in range(1, math.isqrt(abs(n)) + 1) if n % d == 0]
        full = lambda n: {e for d in divisors(n) for e in (d, abs(n) // d)}
        tried = {Fraction(s * p, q) for p in full(whole[zeros]) for q in full(whole[-1]) for s in (1, -1)}
        return sorted([Fraction(0)] * bool(zeros) + [r for r in tried if self(r) == 0])

    def factor(self) -> list[tuple[RationalPoly, int]]:
        """Linear factors of the rational roots with their powers, and what is left, split by repeated parts."""
        rest, out = self, []
        for r in self.rational_roots():
            line, k = RationalPoly([-r, 1]), 0
            while rest.c and rest(r) == 0:
                rest, k = rest // line, k + 1
            out.append((line, k))
        if rest.degree >= 1:
            out.append((rest, 1))
        elif rest.c and rest.c[0] != 1:
            out.append((rest, 1))
        return out

    @staticmethod
    def legendre(n: int):
        a, b, x = RationalPoly([1]), RationalPoly([0, 1]), RationalPoly([0, 1])
        for k in range(1, n):
            a, b = b, (x * b * (2 * k + 1) - a * k) * Fraction(1, k + 1)
        return a if n == 0 else b

    @staticmethod
    def laguerre(n: int):
        a, b = RationalPoly([1]), RationalPoly([1, -1])
        for k in range(1, n):
            a, b = b, (RationalPoly([2 * k + 1, -1]) * b - a * k) * Fraction(1, k + 1)
        return a if n == 0 else b

    def exp_series(self, n: int):
        """exp of a polynomial without constant term, up to x ** (n - 1)."""
        if self.c and self.c[0] != 0:
            raise ValueError("the constant term is not 0")
        d, out = self.derivative().c, [Fraction(1)]
        for k in range(1, n):
            out.append(sum((d[j] * out[k - 1 - j] for j in range(min(k, len(d)))), Fraction(0)) / k)
        return RationalPoly(out)

    def log_series(self, n: int):
        """log of a polynomial with constant term 1, up to x ** (n - 1)."""
        if not self.c or self.c[0] != 1:
            raise ValueError("the constant term is not 1")
        at, out = lambda k: self.c[k] if k < len(self.c) else Fraction(0), [Fraction(0)]
        for k in range(1, n):
            out.append(at(k) - sum((j * out[j] * at(k - j) for j in range(1, k)), Fraction(0)) / k)
        return RationalPoly(out)

    def expr(self, name: str = "x"):
        from .symbolic import ZERO, Expr

        out = ZERO
        for k, a in enumerate(self.c):
            out = out + Expr.of(a) * Expr.symbol(name) ** k
        return out
