"""Basis forms for per-group equation fitting (survey M, F13).

Each form is ``(name, complexity of f, Spark builder, SQL builder, text)``.
The equation search is re-aimed from an evolutionary solver to a closed-form
least-squares fit of every form ``y = a*f(x) [+ b]`` per group. Domain guards
return null outside a function's domain (the form is then invalid for the
group). Callers can add forms with :func:`extend`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Form:
    name: str
    complexity: int  # node count of f(x) alone
    spark: Callable[[Column], Column]
    sql: Callable[[str], str]
    text: str  # printf pattern with {x}


def _pos(c: Column, fn):
    return F.when(c > 0, fn(c))


# Unary operator set of the reference's search (sin, square, tan, cos, cube,
# tanh, sqrt, abs, log, exp, cos^2, x^4, 1/x) plus the identity.
FORMS: list[Form] = [
    Form("x", 1, lambda x: x, lambda x: f"{x}", "{x}"),
    Form("inv", 1, lambda x: F.when(x != 0, F.lit(1.0) / x), lambda x: f"CASE WHEN {x} <> 0 THEN 1.0 / {x} END",
         "1/{x}"),
    Form("square", 2, lambda x: x * x, lambda x: f"({x} * {x})", "square({x})"),
    Form("cube", 2, lambda x: x * x * x, lambda x: f"({x} * {x} * {x})", "cube({x})"),
    Form("quart", 2, lambda x: x * x * x * x, lambda x: f"({x} * {x} * {x} * {x})", "quart({x})"),
    Form("sqrt", 2, lambda x: F.when(x >= 0, F.sqrt(x)), lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END",
         "sqrt({x})"),
    Form("log", 2, lambda x: _pos(x, F.ln), lambda x: f"CASE WHEN {x} > 0 THEN ln({x}) END", "log({x})"),
    Form("exp", 2, lambda x: F.when(x < 700, F.exp(x)), lambda x: f"CASE WHEN {x} < 700 THEN exp({x}) END",
         "exp({x})"),
    Form("abs", 2, lambda x: F.abs(x), lambda x: f"abs({x})", "abs({x})"),
    Form("sin", 2, lambda x: F.sin(x), lambda x: f"sin({x})", "sin({x})"),
    Form("cos", 2, lambda x: F.cos(x), lambda x: f"cos({x})", "cos({x})"),
    Form("tan", 2, lambda x: F.tan(x), lambda x: f"tan({x})", "tan({x})"),
    Form("tanh", 2, lambda x: F.tanh(x), lambda x: f"tanh({x})", "tanh({x})"),
    Form("cos2", 2, lambda x: F.cos(x) * F.cos(x), lambda x: f"(cos({x}) * cos({x}))", "cos2({x})"),
]


def extend(name: str, complexity: int, spark_fn: Callable[[Column], Column], sql_fn: Callable[[str], str] | None = None,
           text: str | None = None) -> list[Form]:
    """A library with one extra caller-defined form (2.O custom operators)."""
    return FORMS + [Form(name, complexity, spark_fn, sql_fn or (lambda x: "NULL"), text or f"{name}({{x}})")]
