"""Linear mixed models with a random intercept per group, fitted from
sufficient statistics (survey J1-J5, J12, J13; formula F4).

One Spark pass builds ``X'X, X'y, y'y`` and, per distinct group size n,
``S_n = sum (X_i'1)(1'X_i)``, ``t_n``, ``u_n`` and the number of groups.
With ``lambda = s_u^2 / s_e^2``,
``X'V^-1X = (X'X - sum_n lambda/(1+n lambda) S_n) / s_e^2`` and
``log|V| = N log s_e^2 + sum_i log(1 + n_i lambda)``, so the driver only holds
p x p matrices and runs a 1-D profile search. Group rows never leave Spark.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import tails


# ------------------------------------------------------------------ design
@dataclass
class Design:
    """Named fixed-effect design columns (treatment coding, statsmodels-style names)."""

    terms: list[tuple[str, Column]] = field(default_factory=list)

    def names(self) -> list[str]:
        return [n for n, _ in self.terms]


def _interaction(names: Sequence[str], cols: Mapping[str, list[tuple[str, Column]]]) -> list[tuple[str, Column]]:
    """Products of one coded column of every named variable, in order;
    any number of numeric variables and factors."""
    out = []
    for parts in itertools.product(*[cols[n] for n in names]):
        value = parts[0][1]
        for _, c in parts[1:]:
            value = value * c
        out.append((":".join(n for n, _ in parts), value))
    return out


def full_crossing(names: Sequence[str]) -> list[tuple[str, ...]]:
    """All interactions of two and more of the variables (``a * b * c``)."""
    return [c for k in range(2, len(names) + 1) for c in itertools.combinations(names, k)]


def treatment_design(numeric: Sequence[str] = (), factors: Mapping[str, Sequence] | None = None,
                     interactions: Sequence[Sequence[str]] = (), intercept: bool = True) -> Design:
    """Intercept, numeric columns, treatment-coded factors (first
    listed level is the reference) and interactions of any of them."""
    factors = dict(factors or {})
    terms: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))] if intercept else []
    cols: dict[str, list[tuple[str, Column]]] = {x: [(x, F.col(x).cast("double"))] for x in numeric}
    for f, levels in factors.items():
        cols[f] = [(f"C({f})[T.{lv}]", (F.col(f) == F.lit(lv)).cast("double")) for lv in list(levels)[1:]]
        terms += cols[f]
    for x in numeric:
        terms += cols[x]
    for names in interactions:
        terms += _interaction(names, cols)
    return Design(terms)


def sum_design(numeric: Sequence[str] = (), factors: Mapping[str, Sequence] | None = None,
               interactions: Sequence[Sequence[str]] = (), intercept: bool = True) -> tuple[Design, dict]:
    """Sum-to-zero coded factors (indicator(level) - indicator(last
    level)) and interactions of any variables; returns the design and the
    term -> columns map used by type III tests."""
    factors = dict(factors or {})
    terms: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))] if intercept else []
    cols: dict[str, list[tuple[str, Column]]] = {x: [(x, F.col(x).cast("double"))] for x in numeric}
    for f, levels in factors.items():
        lv = list(levels)
        last = (F.col(f) == F.lit(lv[-1])).cast("double")
        cols[f] = [(f"C({f}, Sum)[S.{x}]", (F.col(f) == F.lit(x)).cast("double") - last) for x in lv[:-1]]
    groups: dict[str, list[str]] = {}
    for name in [*numeric, *factors]:
        terms += cols[name]
        groups[name] = [n for n, _ in cols[name]]
    for names in interactions:
        made = _interaction(names, cols)
        terms += made
        groups[":".join(names)] = [n for n, _ in made]
    return Design(terms), groups


# ------------------------------------------------------------------ sufficient statistics
@dataclass
class GroupStats:
    names: list[str]
    N: int
    n_groups: int
    XtX: np.ndarray
    Xty: np.ndarray
    yty: float
    sizes: np.ndarray  # distinct group sizes
    counts: np.ndarray  # groups per size
    S: np.ndarray  # (k, p, p)
    t: np.ndarray  # (k, p)
    u: np.ndarray  # (k,)


def group_stats(df: DataFrame, y: str, design: Design, group: str) -> GroupStats:
    """One aggregate per level: per-group sums (distributed, map-side
    combined), collapsed by group size; plus the global cross-products."""
    p = len(design.terms)
    xs = [c.alias(f"__x{j}") for j, (_, c) in enumerate(design.terms)]
    base = df.select(F.col(group).alias("__g"), F.col(y).cast("double").alias("__y"), *xs).na.drop()
    glob_aggs = [F.count(F.lit(1)).alias("N"), F.sum(F.col("__y") * F.col("__y")).alias("yty")]
    glob_aggs += [F.sum(F.col(f"__x{j}") * F.col("__y")).alias(f"xy{j}") for j in range(p)]
    glob_aggs += [F.sum(F.col(f"__x{j}") * F.col(f"__x{k}")).alias(f"xx{j}_{k}") for j in range(p) for k in range(j, p)]
    g = base.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("sy"),
                                *[F.sum(f"__x{j}").alias(f"sx{j}") for j in range(p)])
    byn_aggs = [F.count(F.lit(1)).alias("groups"), F.sum(F.col("sy") * F.col("sy")).alias("u")]
    byn_aggs += [F.sum(F.col(f"sx{j}") * F.col("sy")).alias(f"t{j}") for j in range(p)]
    byn_aggs += [F.sum(F.col(f"sx{j}") * F.col(f"sx{k}")).alias(f"S{j}_{k}") for j in range(p) for k in range(j, p)]
    byn = g.groupBy("n").agg(*byn_aggs).orderBy("n").collect()  # one row per distinct group size
    gl = base.agg(*glob_aggs).first()
    XtX = np.zeros((p, p))
    for j in range(p):
        for k in range(j, p):
            XtX[j, k] = XtX[k, j] = gl[f"xx{j}_{k}"]
    Xty = np.array([gl[f"xy{j}"] for j in range(p)], dtype=float)
    K = len(byn)
    S = np.zeros((K, p, p))
    t = np.zeros((K, p))
    for i, r in enumerate(byn):
        for j in range(p):
            t[i, j] = r[f"t{j}"]
            for k in range(j, p):
                S[i, j, k] = S[i, k, j] = r[f"S{j}_{k}"]
    return GroupStats(design.names(), int(gl["N"]), int(sum(r["groups"] for r in byn)), XtX, Xty, float(gl["yty"]),
                      np.array([r["n"] for r in byn], dtype=float), np.array([r["groups"] for r in byn], dtype=float),
                      S, t, np.array([r["u"] for r in byn], dtype=float))


# ------------------------------------------------------------------ fit
@dataclass
class MixedFit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2_e: float
    sigma2_u: float
    loglik: float
    N: int
    n_groups: int
    reml: bool

    @property
    def p(self) -> int:
        return len(self.beta)

    @property
    def k(self) -> int:  # fixed effects + group variance + residual variance
        return self.p + 2


def _profile(st: GroupStats, lam: float, reml: bool):
    c = lam / (1.0 + st.sizes * lam)
    A = st.XtX - np.einsum("k,kij->ij", c * 1.0, st.S)
    b = st.Xty - np.einsum("k,kj->j", c, st.t)
    q = st.yty - float(np.dot(c, st.u))
    beta = np.linalg.solve(A, b)
    rss = q - float(b @ beta)
    logdet = float(np.dot(st.counts, np.log1p(st.sizes * lam)))
    N, p = st.N, len(b)
    if reml:
        s2 = rss / (N - p)
        sign, ld = np.linalg.slogdet(A)
        ll = -0.5 * ((N - p) * math.log(2 * math.pi) + (N - p) * math.log(s2) + logdet + ld + (N - p))
    else:
        s2 = rss / N
        ll = -0.5 * (N * math.log(2 * math.pi) + N * math.log(s2) + logdet + N)
    return ll, beta, s2, A


def fit_random_intercept(st: GroupStats, reml: bool = False) -> MixedFit:
    """Maximise the profile likelihood over ``theta = log lambda`` (grid,
    then golden-section refinement), with the ``lambda = 0`` boundary."""
    f = lambda th: _profile(st, math.exp(th), reml)[0]
    grid = np.linspace(-18.0, 10.0, 141)
    vals = [f(t) for t in grid]
    i = int(np.argmax(vals))
    lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c1, c2 = b - g * (b - a), a + g * (b - a)
    f1, f2 = f(c1), f(c2)
    for _ in range(100):
        if f1 > f2:
            b, c2, f2 = c2, c1, f1
            c1 = b - g * (b - a)
            f1 = f(c1)
        else:
            a, c1, f1 = c1, c2, f2
            c2 = a + g * (b - a)
            f2 = f(c2)
        if b - a < 1e-10:
            break
    th = (a + b) / 2
    lam = math.exp(th)
    ll, beta, s2, A = _profile(st, lam, reml)
    ll0, beta0, s20, A0 = _profile(st, 0.0, reml)
    if ll0 > ll:
        lam, ll, beta, s2, A = 0.0, ll0, beta0, s20, A0
    cov = s2 * np.linalg.inv(A)
    return MixedFit(st.names, beta, cov, s2, lam * s2, ll, st.N, st.n_groups, reml)


def fit(df: DataFrame, y: str, design: Design, group: str, reml: bool = False) -> MixedFit:
    return fit_random_intercept(group_stats(df, y, design, group), reml)


# ------------------------------------------------------------------ result tables
def fixed_effects(spark, fit_: MixedFit, level: float = 0.95) -> DataFrame:
    """Term, estimate, std_err, z, ci_lower, ci_upper, p_value (variance row dropped)."""
    zq = tails.normal_quantile(0.5 + level / 2)
    rows = []
    for j, name in enumerate(fit_.names):
        est, se = float(fit_.beta[j]), float(math.sqrt(fit_.cov[j, j]))
        z = est / se if se > 0 else float("nan")
        rows.append((name, est, se, z, est - zq * se, est + zq * se, tails.normal_two_sided(z)))
    return spark.createDataFrame(rows, "term string, estimate double, std_err double, z double, ci_lower double, "
                                       "ci_upper double, p_value double")


def compare(spark, fits: Mapping[str, MixedFit]) -> DataFrame:
    """logL, AIC, BIC, df_resid, n_params; LR, d_df and chi-square p
    against the previous (nested) model in the given order."""
    rows, prev = [], None
    for name, f in fits.items():
        aic = -2 * f.loglik + 2 * f.k
        bic = -2 * f.loglik + f.k * math.log(f.N)
        lr = d_df = p = None
        if prev is not None:
            lr = 2 * (f.loglik - prev.loglik)
            d_df = f.p - prev.p
            p = tails.chi2_upper(lr, max(d_df, 1))
        rows.append((name, f.loglik, aic, bic, f.N - f.p, f.k - 1, lr, d_df, p))
        prev = f
    return spark.createDataFrame(rows, "model string, logL double, AIC double, BIC double, df_resid int, "
                                       "n_params int, LR_vs_prev double, d_df int, p_LR double")


def icc(spark, fit_: MixedFit) -> DataFrame:
    """Between-group variance, residual variance, ICC."""
    tot = fit_.sigma2_u + fit_.sigma2_e
    return spark.createDataFrame([(fit_.sigma2_u, fit_.sigma2_e, fit_.sigma2_u / tot if tot > 0 else float("nan"))],
                                 "between_participant_var double, residual_var double, ICC double")


def _dot(design: Design, coef: Sequence[float]) -> Column:
    expr = F.lit(0.0)
    for (_, c), b in zip(design.terms, coef):
        expr = expr + c * F.lit(float(b))
    return expr


def _quad(design: Design, cov: np.ndarray) -> Column:
    cols = [c for _, c in design.terms]
    expr = F.lit(0.0)
    for j in range(len(cols)):
        for k in range(len(cols)):
            if cov[j, k] != 0:
                expr = expr + cols[j] * cols[k] * F.lit(float(cov[j, k]))
    return expr


def marginal_grid(df: DataFrame, fit_: MixedFit, design: Design, x: str, cells: Sequence[str], points: int = 60,
                  x_from: str | None = None, interval: bool = False, level: float = 0.95) -> DataFrame:
    """J5 (+J13 when ``interval``): fixed-part predictions on a ``points`` grid
    of ``x`` (between its observed min and max) for every observed cell;
    optional normal prediction interval with fixed-effect, group and
    residual variance."""
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    cell_t = df.select(*cells).distinct()
    steps = df.sparkSession.range(points).withColumnRenamed("id", "__i")
    g = (steps.crossJoin(F.broadcast(rng))
         .select("__i", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / (points - 1)).alias(x)))
    grid = g.crossJoin(cell_t)  # points x cells rows: a bounded grid
    out = grid.withColumn("prediction", _dot(design, fit_.beta))
    if interval:
        zq = tails.normal_quantile(0.5 + level / 2)
        var = _quad(design, fit_.cov) + F.lit(fit_.sigma2_u + fit_.sigma2_e)
        out = out.withColumn("lower", F.col("prediction") - zq * F.sqrt(var)).withColumn(
            "upper", F.col("prediction") + zq * F.sqrt(var))
    return out.drop("__i")


def ols_band(df: DataFrame, y: str, x: str, lo: int, hi: int, with_band: bool = True, level: float = 0.95) -> DataFrame:
    """Least-squares line from ``regr_*`` aggregates, evaluated on the
    integer grid ``lo..hi`` with the standard error of the fit and (optional)
    t-based confidence band."""
    s = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"),
               F.regr_count(y, x).alias("n"), F.avg(x).alias("xbar"),
               ((F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / (F.regr_count(y, x) - 2)).alias("s2"))
    grid = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("double").alias("x"))
    j = grid.crossJoin(F.broadcast(s))
    fit_ = F.col("a") + F.col("b") * F.col("x")
    se = F.sqrt(F.col("s2") * (1.0 / F.col("n") + (F.col("x") - F.col("xbar")) ** 2 / F.col("sxx")))
    out = j.select("x", F.round(fit_, 6).alias("fit"), F.round(se, 6).alias("se_fit"), "n")
    if with_band:
        q = tails.q_t(F.lit(0.5 + level / 2), F.col("n") - 2)
        out = out.withColumn("lower", F.col("fit") - q * F.col("se_fit")).withColumn(
            "upper", F.col("fit") + q * F.col("se_fit"))
    return out.drop("n")
