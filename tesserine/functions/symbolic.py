"""Symbolic expressions: exact on the driver, Columns on the cluster.

Numbers are exact rationals unless they are floats. An expression is built once,
simplified, derived or solved on the driver, and compiled into one Column that
Catalyst generates code for.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from fractions import Fraction
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.array import SparkArray
from . import ufuncs

#: Functions of one argument: Column, number, and derivative as an expression.
FUNCTIONS: dict[str, tuple[Callable, Callable | None, Callable | None]] = {
    "sin": (ufuncs.sin, math.sin, lambda x: cos(x)), "cos": (ufuncs.cos, math.cos, lambda x: -sin(x)), "tan": (ufuncs.tan, math.tan, lambda x: 1 + tan(x) ** 2),
    "asin": (ufuncs.asin, math.asin, lambda x: 1 / sqrt(1 - x**2)), "acos": (ufuncs.acos, math.acos, lambda x: -1 / sqrt(1 - x**2)),
    "atan": (ufuncs.atan, math.atan, lambda x: 1 / (1 + x**2)), "sinh": (ufuncs.sinh, math.sinh, lambda x: cosh(x)), "cosh": (ufuncs.cosh, math.cosh, lambda x: sinh(x)),
    "tanh": (ufuncs.tanh, math.tanh, lambda x: 1 - tanh(x) ** 2), "asinh": (ufuncs.asinh, math.asinh, lambda x: 1 / sqrt(x**2 + 1)),
    "acosh": (ufuncs.acosh, math.acosh, lambda x: 1 / sqrt(x**2 - 1)), "atanh": (ufuncs.atanh, math.atanh, lambda x: 1 / (1 - x**2)),
    "exp": (ufuncs.exp, math.exp, lambda x: exp(x)), "log": (ufuncs.log, math.log, lambda x: 1 / x), "sqrt": (ufuncs.sqrt, math.sqrt, lambda x: 1 / (2 * sqrt(x))),
    "cbrt": (ufuncs.cbrt, math.cbrt, lambda x: 1 / (3 * cbrt(x) ** 2)), "abs": (ufuncs.abs, abs, None), "floor": (ufuncs.floor, math.floor, None), "ceil": (ufuncs.ceil, math.ceil, None),
    "csc": (ufuncs.csc, lambda x: 1 / math.sin(x), lambda x: -csc(x) * cot(x)), "sec": (ufuncs.sec, lambda x: 1 / math.cos(x), lambda x: sec(x) * tan(x)),
    "cot": (ufuncs.cot, lambda x: 1 / math.tan(x), lambda x: -(csc(x) ** 2)), "erf": (ufuncs.erf, math.erf, lambda x: 2 / sqrt(Expr.real(math.pi)) * exp(-(x**2))),
    "erfc": (ufuncs.erfc, math.erfc, lambda x: -2 / sqrt(Expr.real(math.pi)) * exp(-(x**2))), "gamma": (ufuncs.gamma, math.gamma, None),
    "lambertw": (ufuncs.lambertw, None, lambda x: call("lambertw", x) / (x * (1 + call("lambertw", x)))), "zeta": (ufuncs.zeta, None, None),
}


class Expr:
    """A number, a symbol, a sum, a product, a power or a function."""

    __slots__ = ("kind", "args")

    def __init__(self, kind: str, *args):
        self.kind, self.args = kind, args

    @staticmethod
    def of(x) -> Expr:
        if isinstance(x, Expr):
            return x
        if isinstance(x, bool):
            raise TypeError("a boolean is no number")
        if isinstance(x, (int, Fraction)):
            return Expr("num", Fraction(x))
        if isinstance(x, float):
            return Expr("num", x)
        if isinstance(x, str):
            return Expr("sym", x)
        raise TypeError(f"{type(x)} is no expression")

    integer = of

    @staticmethod
    def rational(p: int, q: int) -> Expr:
        return Expr("num", Fraction(p, q))

    @staticmethod
    def real(x: float) -> Expr:
        return Expr("num", float(x))

    @staticmethod
    def symbol(name: str) -> Expr:
        return Expr("sym", name)

    @staticmethod
    def parse(text: str) -> Expr:
        """A formula in usual notation; ^ and ** are powers."""

        def walk(n) -> Expr:
            if isinstance(n, ast.Expression):
                return walk(n.body)
            if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
                return Expr.of(n.value)
            if isinstance(n, ast.Name):
                return Expr.real(math.pi) if n.id == "pi" else Expr.symbol(n.id)
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
                return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
            if isinstance(n, ast.BinOp):
                a, b = walk(n.left), walk(n.right)
                for op, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: a / b), (ast.Pow, lambda: a**b)):
                    if isinstance(n.op, op):
                        return f()
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and len(n.args) == 1:
                return call(n.func.id, walk(n.args[0]))
            raise ValueError(f"not a formula: {text}")

        return walk(ast.parse(text.replace("^", "**"), mode="eval"))

    # arithmetic keeps sums and products flat, ordered and without repeated terms
    def __add__(self, o):
        terms: dict[Expr, object] = {}
        for t in (*_parts(self, "add"), *_parts(Expr.of(o), "add")):
            c, rest = _scaled(t)
            terms[rest] = terms.get(rest, Fraction(0)) + c
        out = [rest if c == 1 else Expr("num", c) if rest == ONE else Expr("mul", Expr("num", c), *_parts(rest, "mul")) for rest, c in sorted(terms.items(), key=lambda kv: kv[0].key()) if c != 0]
        return ZERO if not out else out[0] if len(out) == 1 else Expr("add", *out)

    def __mul__(self, o):
        number, powers = Fraction(1), {}
        for t in (*_parts(self, "mul"), *_parts(Expr.of(o), "mul")):
            if t.kind == "num":
                number = number * t.args[0]
                continue
            base, e = t.args if t.kind == "pow" else (t, ONE)
            powers[base] = powers.get(base, ZERO) + e
        if number == 0:
            return ZERO
        out = []
        for base, e in sorted(powers.items(), key=lambda kv: kv[0].key()):
            p = base**e
            if p.kind == "num":
                number = number * p.args[0]
            else:
                out.append(p)
        if number != 1 or not out:
            out.insert(0, Expr("num", number))
        return out[0] if len(out) == 1 else Expr("mul", *out)

    def __pow__(self, o):
        o = Expr.of(o)
        if o == ZERO:
            return ONE
        if o == ONE or self == ONE:
            return self
        if self.kind == "num" and o.kind == "num":
            b, e = self.args[0], o.args[0]
            if isinstance(e, Fraction) and e.denominator == 1 and (b != 0 or e > 0):
                return Expr("num", b ** int(e))
            if isinstance(b, float) or isinstance(e, float):
                return Expr("num", float(b) ** float(e))
        if self.kind == "pow" and o.kind == "num" and isinstance(o.args[0], Fraction) and o.args[0].denominator == 1:
            return self.args[0] ** (self.args[1] * o)
        return Expr("pow", self, o)

    pow = __pow__

    def __neg__(self):
        return self * -1

    def __sub__(self, o):
        return self + -Expr.of(o)

    def __truediv__(self, o):
        return self * Expr.of(o) ** -1

    def __radd__(self, o):
        return Expr.of(o) + self

    def __rmul__(self, o):
        return Expr.of(o) * self

    def __rsub__(self, o):
        return Expr.of(o) - self

    def __rtruediv__(self, o):
        return Expr.of(o) / self

    def __eq__(self, o):
        return isinstance(o, Expr) and self.kind == o.kind and self.args == o.args

    def __hash__(self):
        return hash((self.kind, self.args))

    def key(self) -> str:
        return self.kind + "(" + ",".join(a.key() if isinstance(a, Expr) else str(a) for a in self.args) + ")"

    # analysis
    def symbols(self) -> set[str]:
        return {self.args[0]} if self.kind == "sym" else set().union(*(a.symbols() for a in self.args if isinstance(a, Expr)), set())

    def has_symbol(self, name: str) -> bool:
        return name in self.symbols()

    def subs(self, values: dict) -> Expr:
        if self.kind == "sym":
            return Expr.of(values[self.args[0]]) if self.args[0] in values else self
        if self.kind == "num":
            return self
        if self.kind == "fn":
            return call(self.args[0], self.args[1].subs(values))
        a = [x.subs(values) for x in self.args]
        return a[0] ** a[1] if self.kind == "pow" else fold(lambda x, y: x + y if self.kind == "add" else x * y, a)

    def expand(self) -> Expr:
        if self.kind in ("num", "sym"):
            return self
        if self.kind == "fn":
            return call(self.args[0], self.args[1].expand())
        if self.kind == "add":
            return fold(lambda x, y: x + y, (a.expand() for a in self.args))
        if self.kind == "pow":
            b, e = self.args[0].expand(), self.args[1].expand()
            if b.kind == "add" and e.kind == "num" and isinstance(e.args[0], Fraction) and e.args[0].denominator == 1 and e.args[0] > 0:
                return fold(_distributed, [b] * int(e.args[0]))
            return b**e
        return fold(_distributed, (a.expand() for a in self.args))

    def diff(self, name: str) -> Expr:
        if self.kind == "num" or not self.has_symbol(name):
            return ZERO
        if self.kind == "sym":
            return ONE
        if self.kind == "add":
            return fold(lambda x, y: x + y, (a.diff(name) for a in self.args))
        if self.kind == "mul":
            parts = [fold(lambda x, y: x * y, (b.diff(name) if j == k else b for j, b in enumerate(self.args))) for k in range(len(self.args))]
            return fold(lambda x, y: x + y, parts)
        if self.kind == "pow":
            b, e = self.args
            if not e.has_symbol(name):
                return e * b ** (e - 1) * b.diff(name)
            return self * (e.diff(name) * call("log", b) + e * b.diff(name) / b)
        d = FUNCTIONS[self.args[0]][2]
        if d is None:
            raise ValueError(f"{self.args[0]} has no derivative here")
        return d(self.args[1]) * self.args[1].diff(name)

    def numer_denom(self) -> tuple[Expr, Expr]:
        n, d = ONE, ONE
        for t in _parts(self, "mul"):
            if t.kind == "num" and isinstance(t.args[0], Fraction):
                n, d = n * t.args[0].numerator, d * t.args[0].denominator
            elif t.kind == "pow" and t.args[1].kind == "num" and t.args[1].args[0] < 0:
                d = d * t ** -1
            else:
                n = n * t
        return n, d

    def coefficients(self, name: str) -> list[Expr]:
        """Of the powers of a symbol, the lowest first."""
        out: dict[int, Expr] = {}
        for t in _parts(self.expand(), "add"):
            c, k = ONE, 0
            for f in _parts(t, "mul"):
                base, e = f.args if f.kind == "pow" else (f, ONE)
                if base == Expr.symbol(name):
                    if e.kind != "num" or e.args[0] != int(e.args[0]) or e.args[0] < 0:
                        raise ValueError("not a polynomial")
                    k += int(e.args[0])
                elif f.has_symbol(name):
                    raise ValueError("not a polynomial")
                else:
                    c = c * f
            out[k] = out.get(k, ZERO) + c
        return [out.get(k, ZERO) for k in range(max(out, default=0) + 1)]

    def solve(self, name: str) -> list[Expr]:
        """Exact roots of a polynomial of degree one or two, and rational ones of higher degree."""
        c = self.coefficients(name)
        if len(c) == 2:
            return [-c[0] / c[1]]
        if len(c) == 3:
            root = sqrt(c[1] ** 2 - 4 * c[0] * c[2])
            return list(dict.fromkeys([(-c[1] + root) / (2 * c[2]), (-c[1] - root) / (2 * c[2])]))
        from .rational import RationalPoly

        return [Expr.of(r) for r in RationalPoly([x.args[0] for x in c]).rational_roots()]

    # compilation and printing
    def column(self, names: dict[str, Column] | None = None) -> Column:
        if self.kind == "num":
            return F.lit(float(self.args[0]))
        if self.kind == "sym":
            return (names or {}).get(self.args[0], F.col(self.args[0])) if not names or self.args[0] in names else F.col(self.args[0])
        if self.kind == "fn":
            return FUNCTIONS[self.args[0]][0](self.args[1].column(names))
        a = [x.column(names) for x in self.args]
        if self.kind == "pow":
            e = self.args[1]
            if e.kind == "num" and e.args[0] < 0:
                return ufuncs.divide(F.lit(1.0), (self.args[0] ** -e).column(names))
            return a[0] * a[0] if e == Expr.of(2) else F.pow(a[0].cast("double"), a[1])
        return fold(lambda x, y: x + y if self.kind == "add" else x * y, a)

    def evaluate(self, values: dict[str, float] | None = None) -> float:
        if self.kind == "num":
            return float(self.args[0])
        if self.kind == "sym":
            return float((values or {})[self.args[0]])
        if self.kind == "fn":
            return float(FUNCTIONS[self.args[0]][1](self.args[1].evaluate(values)))
        a = [x.evaluate(values) for x in self.args]
        return a[0] ** a[1] if self.kind == "pow" else math.fsum(a) if self.kind == "add" else math.prod(a)

    def code(self, power: str = "pow({0}, {1})", prefix: str = "") -> str:
        if self.kind == "num":
            x = self.args[0]
            return repr(x) if isinstance(x, float) else str(x) if x.denominator == 1 else f"{x.numerator}.0/{x.denominator}.0"
        if self.kind == "sym":
            return self.args[0]
        if self.kind == "fn":
            return f"{prefix}{self.args[0]}({self.args[1].code(power, prefix)})"
        if self.kind == "pow":
            return prefix + power.format(self.args[0].code(power, prefix), self.args[1].code(power, prefix))
        return (" + " if self.kind == "add" else "*").join(f"({a.code(power, prefix)})" if a.kind == "add" or a.kind == "num" and a.args[0] < 0 else a.code(power, prefix) for a in self.args)

    def c_code(self) -> str:
        return self.code()

    def js_code(self) -> str:
        return self.code(prefix="Math.")

    def latex(self) -> str:
        if self.kind == "num":
            x = self.args[0]
            return str(x) if isinstance(x, float) or x.denominator == 1 else rf"\frac{{{x.numerator}}}{{{x.denominator}}}"
        if self.kind == "sym":
            return self.args[0]
        if self.kind == "fn":
            return rf"\sqrt{{{self.args[1].latex()}}}" if self.args[0] == "sqrt" else rf"\{self.args[0]}\left({self.args[1].latex()}\right)"
        wrap = lambda e: rf"\left({e.latex()}\right)" if e.kind in ("add", "mul") else e.latex()
        if self.kind == "pow":
            return f"{{{wrap(self.args[0])}}}^{{{self.args[1].latex()}}}"
        return " + ".join(a.latex() for a in self.args) if self.kind == "add" else " ".join(wrap(a) if a.kind == "add" else a.latex() for a in self.args)

    def mathml(self) -> str:
        if self.kind in ("num", "sym"):
            tag = "cn" if self.kind == "num" else "ci"
            return f"<{tag}>{self.args[0]}</{tag}>"
        op = {"add": "plus", "mul": "times", "pow": "power"}.get(self.kind, self.args[0])
        return f"<apply><{op}/>" + "".join(a.mathml() for a in self.args if isinstance(a, Expr)) + "</apply>"

    __repr__ = code


ZERO, ONE = Expr("num", Fraction(0)), Expr("num", Fraction(1))


def _parts(e: Expr, kind: str) -> tuple[Expr, ...]:
    return e.args if e.kind == kind else (e,)


def _scaled(t: Expr):
    if t.kind == "num":
        return t.args[0], ONE
    if t.kind == "mul" and t.args[0].kind == "num":
        rest = t.args[1:]
        return t.args[0].args[0], rest[0] if len(rest) == 1 else Expr("mul", *rest)
    return Fraction(1), t


def _distributed(a: Expr, b: Expr) -> Expr:
    return fold(lambda x, y: x + y, (x * y for x in _parts(a, "add") for y in _parts(b, "add")))


def call(name: str, x) -> Expr:
    x = Expr.of(x)
    if x.kind == "num" and x.args[0] == 0 and name in ("sin", "tan", "asin", "atan", "sinh", "tanh", "asinh", "atanh", "sqrt", "cbrt", "abs", "erf"):
        return ZERO
    if x.kind == "num" and isinstance(x.args[0], Fraction) and name in ("sqrt", "cbrt") and x.args[0] > 0:
        k = 2 if name == "sqrt" else 3
        p, q = (round(v ** (1 / k)) for v in (x.args[0].numerator, x.args[0].denominator))
        if Fraction(p, q) ** k == x.args[0]:
            return Expr.rational(p, q)
    return Expr("fn", name, x)


def _named(name: str):
    return lambda x: call(name, x)


sin, cos, tan, sinh, cosh, tanh, exp, log, sqrt, cbrt, csc, sec, cot = map(_named, ("sin", "cos", "tan", "sinh", "cosh", "tanh", "exp", "log", "sqrt", "cbrt", "csc", "sec", "cot"))


def lambdify(exprs, names: list[str]) -> Callable:
    """A function of columns, arrays or numbers, in the order of ``names``."""
    single = isinstance(exprs, Expr)
    todo = [exprs] if single else list(exprs)

    def run(*args):
        if all(isinstance(a, (int, float)) for a in args):
            out = [e.evaluate(dict(zip(names, args))) for e in todo]
        elif any(isinstance(a, SparkArray) for a in args):
            out = [evaluate(e, dict(zip(names, args))) for e in todo]
        else:
            out = [e.column({n: ufuncs.col(a) for n, a in zip(names, args)}) for e in todo]
        return out[0] if single else out

    return run


def evaluate(e: Expr, arrays: dict[str, SparkArray]) -> SparkArray:
    """An expression over arrays, under broadcasting: one join for each array, then one Column."""
    items = [(n, a) for n, a in arrays.items() if isinstance(a, SparkArray)]
    name, both = items[0][0], items[0][1].map(lambda v: F.struct(v.alias(items[0][0])))
    for n, a in items[1:]:
        both = both.binary(a, lambda s, v, n=n: s.withField(n, v), "float64")
    fixed = {n: F.lit(v) for n, v in arrays.items() if not isinstance(v, SparkArray)}
    del name
    return both.map(lambda s: e.column({**{n: s[n] for n, _ in items}, **fixed}), "float64")


def map_symbolic(a: SparkArray, e: Expr) -> SparkArray:
    (name,) = e.symbols()
    return a.map(lambda v: e.column({name: v}), "float64")


def with_expression(df: DataFrame, out: str, formula: str) -> DataFrame:
    return df.withColumn(out, Expr.parse(formula).column())


class SymbolicMatrix:
    def __init__(self, rows):
        self.rows = [[Expr.of(x) for x in r] for r in rows]

    @property
    def shape(self):
        return len(self.rows), len(self.rows[0]) if self.rows else 0

    @staticmethod
    def eye(n: int):
        return SymbolicMatrix([[int(i == j) for j in range(n)] for i in range(n)])

    def _each(self, f):
        return SymbolicMatrix([[f(x) for x in r] for r in self.rows])

    def __add__(self, o):
        return SymbolicMatrix([[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(self.rows, o.rows, strict=True)])

    def __neg__(self):
        return self._each(lambda x: -x)

    def __sub__(self, o):
        return self + -o

    def __mul__(self, o):
        if not isinstance(o, SymbolicMatrix):
            return self._each(lambda x: x * o)
        cols = list(zip(*o.rows))
        return SymbolicMatrix([[fold(lambda s, t: s + t, (a * b for a, b in zip(r, c, strict=True))) for c in cols] for r in self.rows])

    def __eq__(self, o):
        return isinstance(o, SymbolicMatrix) and self.rows == o.rows

    def transpose(self):
        return SymbolicMatrix(list(zip(*self.rows)))

    def _minor(self, i: int, j: int):
        return SymbolicMatrix([[x for k, x in enumerate(r) if k != j] for m, r in enumerate(self.rows) if m != i])

    def det(self) -> Expr:
        if len(self.rows) == 1:
            return self.rows[0][0]
        return fold(lambda s, t: s + t, ((-1) ** j * x * self._minor(0, j).det() for j, x in enumerate(self.rows[0]))).expand()

    def inv(self):
        d, n = self.det(), len(self.rows)
        if d == ZERO:
            raise ValueError("the matrix is singular")
        return SymbolicMatrix([[(-1) ** (i + j) * (self._minor(j, i).det() if n > 1 else ONE) / d for j in range(n)] for i in range(n)])

    def solve(self, b):
        return (self.inv() * b)._each(Expr.expand)

    def diff(self, name: str):
        return self._each(lambda x: x.diff(name))

    def subs(self, values: dict):
        return self._each(lambda x: x.subs(values))

    def numpy(self):
        return [[x.evaluate() for x in r] for r in self.rows]

    def latex(self) -> str:
        return r"\begin{pmatrix}" + r" \\ ".join(" & ".join(x.latex() for x in r) for r in self.rows) + r"\end{pmatrix}"


def jacobian(exprs: list[Expr], names: list[str]) -> SymbolicMatrix:
    return SymbolicMatrix([[e.diff(n) for n in names] for e in exprs])


def solve_newton(exprs: list[Expr], names: list[str], start: list[float], tol: float = 1e-10, maxiter: int = 50) -> dict[str, float]:
    """A root of a system by Newton's steps with the exact Jacobian."""
    import numpy as np

    j, x = jacobian(exprs, names), np.asarray(start, float)
    for _ in range(maxiter):
        at = dict(zip(names, x))
        step = np.linalg.solve([[e.evaluate(at) for e in r] for r in j.rows], [e.evaluate(at) for e in exprs])
        x = x - step
        if np.abs(step).max() < tol:
            return dict(zip(names, map(float, x)))
    raise RuntimeError("no root")


def minimize_gradient(e: Expr, names: list[str], start: list[float], rate: float = 0.1, tol: float = 1e-8, maxiter: int = 10_000) -> dict[str, float]:
    g, x = [e.diff(n) for n in names], list(start)
    for _ in range(maxiter):
        step = [rate * d.evaluate(dict(zip(names, x))) for d in g]
        x = [a - s for a, s in zip(x, step)]
        if max(map(abs, step)) < tol:
            break
    return dict(zip(names, x))
