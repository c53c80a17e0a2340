"""Rank-based factorial ANOVA (aligned rank transform), Kruskal-Wallis / Dunn
with Holm, Brown-Forsythe, careless-response screening and effect tables
(survey J8-J11, J14-J16, F5, F6).

Data-size work is grouped aggregates and one distributed rank (F3); the
driver only receives result tables.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import tails
from panelkit.operators import ranks
from panelkit.session import materialize

#: Distinct (cell, response, answer) up to which their ranks are sent to every task.
LOOKUP_ROWS = 500_000


def _subsets(xs: Sequence[str]):
    for k in range(len(xs) + 1):
        yield from itertools.combinations(xs, k)


def _effect_name(e: Sequence[str]) -> str:
    return ":".join(e)


def _cell_offsets(cells: DataFrame, factors: Sequence[str], effects: Sequence[Sequence[str]]) -> DataFrame:
    """Per design cell and response: the array of every effect's estimate less
    the cell mean. ``cells``: factors, __dv, __s, __c."""
    total = {t: F.sum("__s").over(Window.partitionBy("__dv", *t)) / F.sum("__c").over(Window.partitionBy("__dv", *t)) for t in _subsets(factors)}
    whole = tuple(factors)
    named = {t: f"__m{i}" for i, t in enumerate(total)}
    means = cells.select("*", *[total[t].alias(named[t]) for t in total])
    estimates = []
    for e in effects:
        est = F.lit(0.0)
        for t in _subsets(e):
            est = est + F.col(named[t]) * ((-1) ** (len(e) - len(t)))
        estimates.append(est - F.col(named[whole]))
    return means.select(*factors, "__dv", F.array(*estimates).alias("__offsets"))


def art_anova(df: DataFrame, y: str | Sequence[str], between: Sequence[str], within: Sequence[str], subject: str,
              digits: int = 9, complete_only: bool = False) -> DataFrame:
    """Aligned rank transform ANOVA (Wobbrock et al. 2011) for a split-plot
    design: ``between`` factors, at most one ``within`` factor, one observation
    per (subject, within level). ``y`` may list any number of responses, which
    share every pass; the result then has a column ``dv``.

    Per effect: align (residual from the full-cell mean + estimated effect),
    round to ``digits`` so float noise does not split ties, rank all rows
    (exact distributed average rank), and read that effect's F from the
    ANOVA on ranks with the subject (between) or within-by-subject error
    stratum. Rows enter the alignment and the ranking counted per (design cell,
    response, answer), so that (effect, answer) copies are made of the counts
    and not of the rows; the rows only look their ranks up, for the sums per
    subject. Returns one row per effect: effect, df_effect, df_error,
    ss_effect, ss_error, F, p, eta2_partial. Design cells stay in Spark: the
    driver receives sums per (response, effect, subset of the factors).
    """
    if len(within) > 1:
        raise ValueError("at most one within-subject factor is supported")
    ys = [y] if isinstance(y, str) else list(y)
    factors = list(between) + list(within)
    base = df.select(subject, *factors, *[F.col(c).cast("double").alias(f"__y{i}") for i, c in enumerate(ys)]) \
        .where(F.coalesce(*[F.col(f"__y{i}") for i in range(len(ys))]).isNotNull())
    if complete_only and within:
        n_w = base.select(*within).distinct().count()
        full = base.groupBy(subject).agg(F.count_distinct(*within).alias("__k")).where(F.col("__k") == n_w)
        base = base.join(full.select(subject), subject, "left_semi")
    base = base.cache()  # reused by the checks, the counts and the sums per subject
    # balance precondition: one row per (subject, within level), one between cell per subject
    chk = base.groupBy(subject, *within).agg(F.count(F.lit(1)).alias("__n"),
                                             *[(F.min(b) < F.max(b)).alias(f"__d_{b}") for b in between])
    several = [F.coalesce(F.col(f"__d_{b}"), F.lit(False)) for b in between]
    bad = chk.where(functools.reduce(operator.or_, several, F.col("__n") != 1))
    if not bad.isEmpty():
        raise ValueError("ART needs one observation per subject and within level, and one between cell per subject")

    # rows of a design cell with one answer are aligned alike: they are counted, and their ranks read by (cell, answer)
    values = F.array(*[F.struct(F.lit(i).alias("__dv"), F.col(f"__y{i}").alias("__y")) for i in range(len(ys))])
    cell = [*factors, "__dv", "__y"]
    counts = materialize(base.select(*factors, F.inline(values)).where("__y IS NOT NULL").groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")))
    cells = counts.groupBy(*factors, "__dv").agg(F.sum(F.col("__y") * F.col("__n")).alias("__s"), F.sum("__n").alias("__c"))
    effects = [e for e in _subsets(factors) if e]
    names = F.array(*[F.lit(_effect_name(e)) for e in effects])
    aligned = counts.join(_cell_offsets(cells, factors, effects), [*factors, "__dv"], "inner")
    long = aligned.select(*cell, "__n", F.explode(F.arrays_zip(names.alias("__effect"), F.col("__offsets").alias("a"))).alias("__t")) \
        .select(*cell, "__n", "__t.__effect", F.round(F.col("__y") + F.col("__t.a"), digits).alias("__v"))
    one = ["__dv", "__effect"]
    ranked = materialize(ranks.average_rank(long, "__v", out="__r", by=one, weight="__n"))

    # sums on ranks: per response and effect, over the levels of every subset of the factors
    at = {_effect_name(e): f"__r{i}" for i, e in enumerate(effects)}
    looked = materialize(ranked.groupBy(*cell).agg(*[F.max(F.when(F.col("__effect") == e, F.col("__r"))).alias(c) for e, c in at.items()]))
    few = looked.count() <= LOOKUP_ROWS
    rows = base.repartition(subject) if few else base  # a subject's wide rows meet once; answers are looked up beside them
    rows = rows.select(subject, *factors, F.inline(values)).where("__y IS NOT NULL").join(F.broadcast(looked) if few else looked, cell, "inner")
    per_subject = rows.groupBy(subject, "__dv").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in at.values()])
    each = F.inline(F.array(*[F.struct(F.lit(e).alias("__effect"), F.col(c).alias("__s")) for e, c in at.items()]))
    subj = per_subject.select("__dv", "__n", each).groupBy(*one).agg(F.sum(F.col("__s") * F.col("__s") / F.col("__n")).alias("ss_subj"),
                                                                     F.count(F.lit(1)).alias("n_subjects"))
    tot = ranked.groupBy(*one).agg(F.sum(F.col("__r") * F.col("__r") * F.col("__n")).alias("ss_rows"))
    per = {(r["__dv"], r["__effect"]): r for r in subj.join(tot, one).collect()}
    cell_r = ranked.groupBy(*one, *factors).agg(F.sum(F.col("__r") * F.col("__n")).alias("__sr"), F.sum("__n").alias("__n"))
    margins = cell_r.groupingSets([[*one, *t] for t in _subsets(factors)], *one, *factors) \
        .agg(F.sum("__sr").alias("__sr"), F.sum("__n").alias("__n"), F.grouping_id().alias("left_out")) \
        .groupBy(*one, "left_out").agg(F.sum(F.col("__sr") * F.col("__sr") / F.col("__n")).alias("ss"), F.count(F.lit(1)).alias("cells")).collect()
    found = {(r["__dv"], r["__effect"], r["left_out"]): r for r in margins}
    base.unpersist()

    def margin(dv, e, t):  # sum over the cells of t of n * mean^2, and the number of cells
        return found[dv, e, sum(1 << (len(factors) - 1 - i) for i, c in enumerate(factors) if c not in t)]

    rows = []
    for dv in sorted({k[0] for k in per}):
        for e in effects:
            name = _effect_name(e)
            ss = lambda t: float(margin(dv, name, t)["ss"])  # noqa: B023, E731
            levels = lambda t: int(margin(dv, name, t)["cells"])  # noqa: B023, E731
            ss_e = sum((-1) ** (len(e) - len(t)) * ss(t) for t in _subsets(e))
            df_e = 1
            for c in e:
                df_e *= levels((c,)) - 1
            n_s, n_b = int(per[dv, name]["n_subjects"]), levels(tuple(between))
            ss_subj, ss_rows = float(per[dv, name]["ss_subj"]), float(per[dv, name]["ss_rows"])
            if any(c in within for c in e):
                w = within[0]
                ss_err = (ss_rows - ss_subj) - (ss((*between, w)) - ss(tuple(between)))
                df_err = (n_s - n_b) * (levels((w,)) - 1)
            else:
                ss_err = ss_subj - ss(tuple(between))
                df_err = n_s - n_b
            f = (ss_e / df_e) / (ss_err / df_err) if df_err > 0 and ss_err > 0 and df_e > 0 else float("nan")
            lo, hi = tails.eta2_partial_ci(f, df_e, df_err)
            rows.append((ys[dv], name, int(df_e), int(df_err), float(ss_e), float(ss_err), float(f),
                         float(tails.f_upper(f, df_e, df_err)),
                         float(ss_e / (ss_e + ss_err)) if (ss_e + ss_err) > 0 else float("nan"), float(lo), float(hi)))
    schema = ("dv string, effect string, df_effect int, df_error int, ss_effect double, ss_error double, F double, "
              "p double, eta2_partial double, eta2_CI_low double, eta2_CI_high double")
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.drop("dv") if isinstance(y, str) else out


def kruskal_dunn(df: DataFrame, y: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Kruskal-Wallis H (tie-corrected) and Dunn pairwise z with
    two-sided p and Holm adjustment. Returns (h_table, pairs). When all values
    tie, H, z and the p values are null."""
    base = df.select(group, F.col(y).cast("double").alias("__y")).where(F.col("__y").isNotNull())
    ranked = ranks.average_rank(base, "__y", out="__r")
    g = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("__r").alias("mean_rank"))
    ties = (base.groupBy("__y").agg(F.count(F.lit(1)).alias("t"))
            .agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_sum"), F.sum("t").alias("__N")))
    gt = g.crossJoin(ties)
    big_n = F.col("__N")
    h = gt.groupBy("__N", "tie_sum").agg(
        (F.lit(12.0) / (big_n * (big_n + 1)) * F.sum(F.col("n") * (F.col("mean_rank") - (big_n + 1) / 2) ** 2))
        .alias("__h0"), F.count(F.lit(1)).alias("k"))
    h = h.select(F.try_divide("__h0", 1 - F.try_divide("tie_sum", big_n ** 3 - big_n)).alias("H"),
                 (F.col("k") - 1).alias("df"), big_n.alias("n"))
    h = h.withColumn("p", F.when(F.col("H").isNotNull(), tails.p_chi2(F.col("H"), F.col("df"))))
    a = gt.select(F.col(group).alias("level_a"), F.col("n").alias("n_a"), F.col("mean_rank").alias("rank_a"),
                  "__N", "tie_sum")
    b = g.select(F.col(group).alias("level_b"), F.col("n").alias("n_b"), F.col("mean_rank").alias("rank_b"))
    pairs = a.join(b, F.col("level_a") < F.col("level_b"))  # C5: triangular theta join on the level table
    s2 = (big_n * (big_n + 1) / 12 - F.try_divide(F.col("tie_sum"), 12 * (big_n - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    pairs = pairs.select("level_a", "level_b", F.try_divide(F.col("rank_a") - F.col("rank_b"), F.sqrt(s2)).alias("z"))
    pairs = pairs.withColumn("p", F.when(F.col("z").isNotNull(), tails.p_normal_two_sided(F.col("z"))))
    pairs = ranks.holm(pairs, "p", out="p_holm", tiebreak=[F.col("level_a"), F.col("level_b")])
    return h, pairs


def brown_forsythe(df: DataFrame, y: str, factor: str) -> DataFrame:
    """Brown-Forsythe (median-centred Levene) test of equal spread across
    the levels of ``factor``: one-way ANOVA F on |y - median of its level|.
    F and p are null without spread inside the levels or with one level."""
    base = df.select(factor, F.col(y).cast("double").alias("__y")).where(F.col("__y").isNotNull())
    med = ranks.exact_percentile(base, "__y", [0.5], by=[factor]).select(factor, F.col("value").alias("__med"))
    d = base.join(med, factor).select(factor, F.abs(F.col("__y") - F.col("__med")).alias("__d"))
    lv = d.groupBy(factor).agg(F.count(F.lit(1)).alias("__n"), F.avg("__d").alias("__m"),
                               F.sum(F.col("__d") * F.col("__d")).alias("__ss"))
    g = d.agg(F.avg("__d").alias("__gm"))
    t = lv.crossJoin(g).agg(
        F.sum(F.col("__n") * (F.col("__m") - F.col("__gm")) ** 2).alias("ss_between"),
        F.sum(F.col("__ss") - F.col("__n") * F.col("__m") ** 2).alias("ss_within"),
        F.count(F.lit(1)).alias("k"), F.sum("__n").alias("n"))
    out = t.select(F.lit(factor).alias("factor"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"),
                   F.try_divide(F.try_divide("ss_between", F.col("k") - 1),
                                F.try_divide("ss_within", F.col("n") - F.col("k"))).alias("F"))
    return out.withColumn("p", F.when(F.col("F").isNotNull(), tails.p_f(F.col("F"), F.col("df1"), F.col("df2"))))


def residual_shape(df: DataFrame, y: str, cells: Sequence[str]) -> DataFrame:
    """Skewness, excess kurtosis and Jarque-Bera of cell residuals."""
    base = df.select(*cells, F.col(y).cast("double").alias("__y"))
    m = base.groupBy(*cells).agg(F.avg("__y").alias("__m"))
    r = base.join(m, list(cells)).select((F.col("__y") - F.col("__m")).alias("__e"))
    s = r.agg(F.count(F.lit(1)).alias("n"), F.skewness("__e").alias("skewness"),
              F.kurtosis("__e").alias("excess_kurtosis"))
    s = s.withColumn("jarque_bera", F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("excess_kurtosis") ** 2 / 4.0))
    return s.withColumn("p_jb", tails.p_chi2(F.col("jarque_bera"), F.lit(2.0)))


def ks_normal(df: DataFrame, y: str, cells: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov test of standardised cell residuals against
    N(0,1) with MLlib's distributed ``KolmogorovSmirnovTest``."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    base = df.select(*cells, F.col(y).cast("double").alias("__y"))
    m = base.groupBy(*cells).agg(F.avg("__y").alias("__m"))
    r = base.join(m, list(cells)).select((F.col("__y") - F.col("__m")).alias("__e"))
    sd = r.agg(F.stddev_samp("__e").alias("__sd"))
    z = r.crossJoin(sd).select((F.col("__e") / F.col("__sd")).alias("z"))
    return KolmogorovSmirnovTest.test(z, "z", "norm", 0.0, 1.0)


def response_entropy(df: DataFrame, subject: str, items: Sequence[str], out: str = "entropy") -> DataFrame:
    """J11 (our definition): Shannon entropy (bits) of the distribution of a
    respondent's answers over all listed items. Counts per (subject, answer)
    by one aggregate; entropy by a second."""
    arr = F.array(*[F.col(c).cast("double") for c in items])
    ans = df.select(subject, F.explode(arr).alias("__a")).where(F.col("__a").isNotNull())
    c = ans.groupBy(subject, "__a").agg(F.count(F.lit(1)).alias("__n"))
    tot = c.groupBy(subject).agg(F.sum("__n").alias("__t"))
    p = c.join(tot, subject).withColumn("__p", F.col("__n") / F.col("__t"))
    return p.groupBy(subject).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias(out),
                                  F.first("__t").alias("n_answers"))


def careless_flags(df: DataFrame, subject: str, items: Sequence[str], pct: float = 0.05,
                   flag: str = "Suspicious") -> DataFrame:
    """``flag`` = "Yes" for respondents whose entropy is at or below the
    ``pct`` percentile of all respondents' entropies, else "No"."""
    e = response_entropy(df, subject, items)
    thr = ranks.exact_percentile(e, "entropy", [pct]).select(F.col("value").alias("__thr"))
    return e.crossJoin(thr).select(subject, "entropy", "n_answers",
                                   F.when(F.col("entropy") <= F.col("__thr"), "Yes").otherwise("No").alias(flag))


def remove_careless(df: DataFrame, subject: str, items: Sequence[str], pct: float = 0.05) -> DataFrame:
    """Keep rows of respondents not flagged (``Suspicious != 'Yes'``)."""
    f = careless_flags(df, subject, items, pct).where(F.col("Suspicious") == "Yes").select(subject)
    return df.join(f, subject, "left_anti")


def art_as_effects(art: DataFrame, suffix: str = "_art") -> DataFrame:
    """ART rows in the shared effect-table vocabulary (term, NumDF, DenDF, F,
    p, ...); ``suffix`` tells their responses from those of another model."""
    dv = [F.concat("dv", F.lit(suffix)).alias("dv")] if "dv" in art.columns else []
    return art.select(*dv, F.col("effect").alias("term"), F.col("df_effect").alias("NumDF"),
                      F.col("df_error").cast("double").alias("DenDF"), "F", "p", "eta2_partial", "eta2_CI_low",
                      "eta2_CI_high", F.lit("aligned_rank").alias("random_structure"))


def effect_table(tables: dict[str, DataFrame] | Sequence[DataFrame], sizes: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Union the effect tables (G1; columns term, NumDF, DenDF, F, p,
    ...), given per response or with a column ``dv`` that names it, attach
    effect sizes by term (C4 left join, when given separately), tag the effect
    type (B29) and Holm-adjust within each response (E3)."""
    from panelkit.operators.encode import effect_type

    parts = [t.withColumn("dv", F.lit(dv)) for dv, t in tables.items()] if isinstance(tables, dict) else list(tables)
    u = parts[0]
    for p_ in parts[1:]:
        u = u.unionByName(p_, allowMissingColumns=True)
    if sizes is not None:
        u = u.join(sizes, ["dv", "term"], "left")
    u = u.withColumn("effect_type", effect_type("term"))
    u = ranks.holm(u, "p", by=["dv"], out="p_holm_within_dv", tiebreak=[F.col("term")])
    return u.withColumn("significant", F.col("p") < alpha)


def effect_sentences(effects: DataFrame, alpha: float = 0.05, dv: str = "dv") -> DataFrame:
    """One sentence per response listing its significant effects; when
    exactly two main effects are significant they are reported together."""
    sig = effects.where(F.col("p") < alpha)
    fmt = F.format_string("%s (F(%d, %.1f) = %.2f, p = %.3f)", F.col("term"), F.col("NumDF").cast("int"),
                          F.col("DenDF").cast("double"), F.col("F"), F.col("p"))
    per = sig.groupBy(dv).agg(
        F.sort_array(F.collect_list(F.struct(F.col("term"), fmt.alias("txt")))).alias("__e"),
        F.count_if(F.col("effect_type") == "main").alias("__main"), F.count(F.lit(1)).alias("__k"))
    txt = F.array_join(F.transform("__e", lambda s: s["txt"]), "; ")
    two_main = (F.col("__main") == 2) & (F.col("__k") == 2)
    sentence = F.when(two_main, F.format_string("For %s, both main effects were significant: %s.", F.col(dv),
                                                F.array_join(F.transform("__e", lambda s: s["txt"]), " and ")))
    sentence = sentence.otherwise(F.format_string("For %s, significant effects: %s.", F.col(dv), txt))
    return per.select(dv, sentence.alias("sentence"))


def posthoc_table(pairs: DataFrame, df: DataFrame, y: str, group: str, alpha: float = 0.05,
                  only_significant: bool = True) -> DataFrame:
    """Dunn pairs joined to per-level means and sds."""
    d1 = df.groupBy(group).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
    a = d1.select(F.col(group).alias("level_a"), F.col("mean").alias("mean_a"), F.col("sd").alias("sd_a"))
    b = d1.select(F.col(group).alias("level_b"), F.col("mean").alias("mean_b"), F.col("sd").alias("sd_b"))
    out = pairs.join(a, "level_a").join(b, "level_b")
    if only_significant:
        out = out.where(F.col("p_holm") < alpha)
    return out.select("level_a", "level_b", "mean_a", "sd_a", "mean_b", "sd_b", "z", "p", "p_holm")


__all__ = ["art_anova", "kruskal_dunn", "brown_forsythe", "residual_shape", "ks_normal", "response_entropy",
           "careless_flags", "remove_careless", "effect_table", "effect_sentences", "posthoc_table"]
