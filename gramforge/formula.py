"""R-style formulas compiled to Spark column expressions.

    formula := response "~" term (("+" | "-") term)*
    term    := factor ((":" | "*") factor)*
    factor  := name | number | call | "(" ... ")" ;  call in C, I, log, exp, sqrt, poly, bs
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.errors import FormulaError, InvalidOperation
from gramforge.util import col, require

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_.][\w.]*)|(?P<op>\*\*|[~+\-*:()^,=/]))")
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Factor:
    """kind: col, C, pow, log, exp, sqrt, poly, bs."""

    kind: str
    name: str
    args: tuple[float, ...] = ()


@dataclass
class Formula:
    response: str
    terms: list[tuple[Factor, ...]]
    intercept: bool = True
    text: str = field(default="", compare=False)

    @staticmethod
    def parse(text: str) -> Formula:
        return _Parser(text).formula()

    def design(self, df: DataFrame) -> tuple[Column, dict[str, Column]]:
        """The response and the named design columns, in order; levels and knots come from `df`."""
        require(df, self.response)
        out: dict[str, Column] = {"const": F.lit(1.0)} if self.intercept else {}
        for term in self.terms:
            parts = [{"": F.lit(1.0)}]
            for f in term:
                made = self._factor(df, f)
                parts = [{(f"{a}:{b}" if a else b): x * y for p in parts for a, x in p.items() for b, y in made.items()}]
            for n, e in parts[0].items():
                out[n] = e
        return col(self.response).cast("double"), out

    def _factor(self, df: DataFrame, f: Factor) -> dict[str, Column]:
        require(df, f.name)
        c = col(f.name)
        x = c.cast("double")
        if f.kind == "col":
            return {f.name: x}
        if f.kind == "pow":
            return {f"I({f.name}^{int(f.args[0])})": F.pow(x, F.lit(f.args[0]))}
        if f.kind in ("log", "exp", "sqrt"):
            return {f"{f.kind}({f.name})": getattr(F, {"log": "ln"}.get(f.kind, f.kind))(x)}
        if f.kind == "poly":
            return {f"poly({f.name}, {p})": F.pow(x, F.lit(float(p))) for p in range(1, int(f.args[0]) + 1)}
        if f.kind == "bs":
            return bspline_columns(df, f.name, int(f.args[0]), int(f.args[1]) if len(f.args) > 1 else 3)
        levels = [r[0] for r in df.select(c).where(c.isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise InvalidOperation(f"{f.name} has over {MAX_LEVELS} levels")
        if len(levels) < 2:
            raise FormulaError(f"C({f.name}) needs two levels")
        return {f"{f.name}={lv}": F.when(c == F.lit(lv), 1.0).otherwise(0.0) for lv in sorted(levels)[1:]}

    def names(self, df: DataFrame) -> list[str]:
        return list(self.design(df)[1])


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        body = text.rstrip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise FormulaError(f"cannot read {body[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] == "op" and self.items[self.at][1] in ops

    def take(self, kind: str, value: str | None = None) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != kind or value not in (None, self.items[self.at][1]):
            raise FormulaError(f"expected {value or kind} in {self.text!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def formula(self) -> Formula:
        if not self.items:
            raise FormulaError("empty formula")
        out = Formula(self.take("name"), [], True, self.text)
        self.take("op", "~")
        sign = "+"
        if self.peek("-", "+"):
            sign = self.take("op")
        while True:
            if self.at < len(self.items) and self.items[self.at][0] == "num":
                n = self.take("num")
                if n not in ("0", "1"):
                    raise FormulaError(f"a term cannot be the number {n}")
                out.intercept = (n == "1") == (sign == "+")
            elif sign == "-":
                raise FormulaError("only an intercept can be removed")
            else:
                out.terms += self.term()
            if self.at == len(self.items):
                return out
            if not self.peek("+", "-"):
                raise FormulaError(f"unexpected {self.items[self.at][1]!r} in {self.text!r}")
            sign = self.take("op")

    def term(self) -> list[tuple[Factor, ...]]:
        terms: list[tuple[Factor, ...]] = [(self.factor(),)]
        while self.peek("*", ":"):
            star = self.take("op") == "*"
            f = self.factor()
            crossed = [(*t, f) for t in terms]
            terms = [*terms, (f,), *crossed] if star else crossed
        return terms

    def factor(self) -> Factor:
        name = self.take("name")
        if not self.peek("("):
            return Factor("col", name)
        self.take("op", "(")
        arg = self.take("name")
        if name == "I":
            self.take("op", "**" if self.peek("**") else "^")
            power = int(self.take("num"))
            self.take("op", ")")
            return Factor("pow", arg, (float(power),))
        args = []
        while self.peek(","):
            self.take("op")
            if self.at < len(self.items) and self.items[self.at][0] == "name":
                self.take("name")
                self.take("op", "=")
            args.append(float(self.take("num")))
        self.take("op", ")")
        if name not in ("C", "log", "exp", "sqrt", "poly", "bs"):
            raise FormulaError(f"unknown function {name}")
        if name in ("poly", "bs") and not args:
            raise FormulaError(f"{name} needs a second argument")
        return Factor(name, arg, tuple(args))


def bspline_columns(df: DataFrame, name: str, n_basis: int, degree: int = 3) -> dict[str, Column]:
    """Clamped B-spline basis as nested expressions: equally spaced inner knots, ends 1 % outside the range."""
    if n_basis <= degree:
        raise FormulaError("bs needs more columns than its degree")
    x = col(name).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    pad = 0.01 * (hi - lo) or 0.01
    lo, hi = lo - pad, hi + pad
    inner = np.linspace(lo, hi, n_basis - degree + 1)
    knots = [lo] * degree + [float(k) for k in inner] + [hi] * degree
    basis = [F.when((x >= knots[i]) & (x < knots[i + 1]), 1.0).otherwise(0.0) if knots[i + 1] > knots[i] else F.lit(0.0) for i in range(len(knots) - 1)]
    for d in range(1, degree + 1):
        nxt = []
        for i in range(len(knots) - 1 - d):
            a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            e = (x - knots[i]) / a * basis[i] if a > 0 else F.lit(0.0)
            nxt.append(e + ((knots[i + d + 1] - x) / b * basis[i + 1] if b > 0 else F.lit(0.0)))
        basis = nxt
    return {f"bs({name}, {i + 1})": b for i, b in enumerate(basis)}
