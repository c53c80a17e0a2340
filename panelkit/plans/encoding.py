"""Queries for cleaning, recoding and encoders (survey 2.B, E1, D3-D7, D23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions.random import uniform_sql
from panelkit.functions.vocab import CODE_LABELS, DISPLAY_NAMES
from panelkit.operators import clean, encode, groups, split
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx


def _r6(df):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _case(col: str, mapping: dict, keep: bool) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {col if keep else 'NULL'} END"


# ------------------------------------------------------------------ B1, B2
def missing_rows_report(spark, sf_dir):
    return clean.missing_report(fx.ratings(spark, sf_dir), ["age", "rating"])


register("missing_rows_report", "B1", fx.with_views("""
SELECT count(*) AS n_rows, CAST(count_if(age IS NOT NULL AND rating IS NOT NULL AND NOT isnan(rating)) AS BIGINT) AS n_kept,
       CAST(count_if(age IS NULL OR rating IS NULL OR isnan(rating)) AS BIGINT) AS n_dropped FROM ratings""", "ratings"))(missing_rows_report)


def complete_rows(spark, sf_dir):
    r = clean.drop_missing(fx.ratings(spark, sf_dir))
    return r.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("sum_age"))


register("complete_rows", "B2", fx.with_views("""
SELECT scenario, count(*) AS n, CAST(sum(age) AS BIGINT) AS sum_age FROM ratings
WHERE row_id IS NOT NULL AND participant IS NOT NULL AND introduction_raw IS NOT NULL AND scenario IS NOT NULL
  AND quality IS NOT NULL AND rating IS NOT NULL AND age IS NOT NULL AND gender IS NOT NULL
  AND education IS NOT NULL AND job IS NOT NULL AND line_no IS NOT NULL AND part_key IS NOT NULL
GROUP BY scenario""", "ratings"))(complete_rows)


# ------------------------------------------------------------------ B8, B11, B28
def recoded_labels(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    r = clean.to_string(r, ["age"])
    r = clean.recode(r, "gender", CODE_LABELS["Gender"], out="gender_label")
    r = clean.recode(r, "education", CODE_LABELS["Education"], out="education_label")
    r = r.withColumn("scenario_term", F.concat(F.lit("SCENARIO_"), F.col("scenario")))
    r = clean.recode(r, "scenario_term", DISPLAY_NAMES, out="scenario_display")
    return r.groupBy("gender_label", "education_label", "scenario_display").agg(
        F.count(F.lit(1)).alias("n"), F.max("age").alias("max_age_text"))


register("recoded_labels", "B8 B11 B28 C9", fx.with_views(f"""
SELECT {_case('gender', CODE_LABELS['Gender'], True)} AS gender_label,
       {_case('education', CODE_LABELS['Education'], True)} AS education_label,
       {_case("('SCENARIO_' || scenario)", DISPLAY_NAMES, True)} AS scenario_display,
       count(*) AS n, max(CAST(age AS VARCHAR)) AS max_age_text
FROM ratings GROUP BY 1, 2, 3""", "ratings"))(recoded_labels)


# ------------------------------------------------------------------ B9, B10
INTRO = {"ambiguous": "ambiguous", "ambigious": "ambiguous", "boasting": "boasting"}


def intro_encoding(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    r = clean.recode(r, "introduction_raw", INTRO, unmapped="null", lower=True, out="introduction")
    r = r.withColumn("intro_code", encode.intro_binary("introduction_raw"))
    return r.groupBy("introduction_raw", "introduction", "intro_code").agg(F.count(F.lit(1)).alias("n"))


register("intro_encoding", "B9 B10", fx.with_views("""
SELECT introduction_raw,
       CASE lower(introduction_raw) WHEN 'ambiguous' THEN 'ambiguous' WHEN 'ambigious' THEN 'ambiguous'
            WHEN 'boasting' THEN 'boasting' END AS introduction,
       CAST(CASE WHEN lower(trim(introduction_raw)) = 'boasting' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS intro_code,
       count(*) AS n
FROM ratings GROUP BY 1, 2, 3""", "ratings"))(intro_encoding)


# ------------------------------------------------------------------ H2 + B24
def group_split_sql(src: str, group: str, test: float = 0.2, seed: int = 42) -> str:
    """CTE text ``gsplit(<group>, split)`` mirroring ``split.group_split_table``."""
    u = uniform_sql(str(seed), group)
    return f"""
g_ AS (SELECT DISTINCT {group} FROM {src} WHERE {group} IS NOT NULL),
gn_ AS (SELECT {group}, row_number() OVER (ORDER BY {u}, {group}) AS rn, count(*) OVER () AS total FROM g_),
gsplit AS (SELECT {group}, CASE WHEN rn <= ceil(total * {test}) THEN 'test' ELSE 'train' END AS split FROM gn_)"""


def level_codes(spark, sf_dir):
    r = split.group_split(fx.ratings(spark, sf_dir), "participant")
    coded = encode.codes_by_join(r, "participant", r.where(F.col("split") == "train"), out="participant_code")
    return coded.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("participant_code") == -1).alias("n_unseen"),
                                      F.sum("participant_code").alias("sum_code"))


register("level_codes", "B24 H2 C3", fx.with_views(f"""
, {group_split_sql('ratings', 'participant').strip()},
lv AS (SELECT participant, CAST(row_number() OVER (ORDER BY participant) - 1 AS INT) AS code
       FROM gsplit WHERE split = 'train'),
r AS (SELECT ratings.*, gsplit.split FROM ratings LEFT JOIN gsplit USING (participant))
SELECT split, count(*) AS n, CAST(count_if(coalesce(code, -1) = -1) AS BIGINT) AS n_unseen, CAST(sum(coalesce(code, -1)) AS BIGINT) AS sum_code
FROM r LEFT JOIN lv USING (participant) GROUP BY split""", "ratings").replace("\n, g_ AS", ",\ng_ AS"))(level_codes)


# ------------------------------------------------------------------ B22, B23
ONE_HOT_COLS = ["gender", "education", "scenario"]


def one_hot_sums(spark, sf_dir):
    r = split.group_split(fx.ratings(spark, sf_dir), "participant")
    levels = encode.fit_levels(r.where(F.col("split") == "train"), ONE_HOT_COLS)
    dropped = encode.one_hot(r, levels, drop="first")
    full = encode.one_hot(r.select("row_id", "split", "scenario"), {"scenario": levels["scenario"]}, drop=None,
                          sep="__")
    cols = [c for c in dropped.columns if any(c.startswith(p + "_") for p in ONE_HOT_COLS)]
    a = dropped.groupBy("split").agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in cols])
    b = full.groupBy("split").agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in full.columns if "__" in c])
    return a.join(b, "split")


def _one_hot_sums_sql():
    gl = ["A2", "A3", "A4"]
    el = ["A2", "A3", "A4", "A5"]
    sl = ["NeueMitte", "Spielstrasse", "Ueberland"]
    full = ["3Spurig", "NeueMitte", "Spielstrasse", "Ueberland"]
    parts = ([f"sum(CAST(gender = '{x}' AS DOUBLE)) AS gender_{x}" for x in gl]
             + [f"sum(CAST(education = '{x}' AS DOUBLE)) AS education_{x}" for x in el]
             + [f"sum(CAST(scenario = '{x}' AS DOUBLE)) AS scenario_{x}" for x in sl]
             + [f"sum(CAST(scenario = '{x}' AS DOUBLE)) AS scenario__{x}" for x in full])
    return fx.with_views(f"""
, {group_split_sql('ratings', 'participant').strip()}
SELECT split, {", ".join(parts)}
FROM ratings LEFT JOIN gsplit USING (participant) GROUP BY split""", "ratings").replace("\n, g_ AS", ",\ng_ AS")


register("one_hot_sums", "B22 B23", _one_hot_sums_sql())(one_hot_sums)


# ------------------------------------------------------------------ B20, B21, B25, B10
WIDTHS = [("gender", 4), ("education", 5), ("job", 6)]


def fixed_vocab_vector(spark, sf_dir):
    r = fx.ratings(spark, sf_dir).withColumn("licence", F.when(F.col("part_key") % 2 == 0, "Y").otherwise("N"))
    r = r.select(
        "row_id",
        encode.fixed_one_hot("scenario", encode.SCENARIO_LEVELS, "scenario").alias("scenario_vec"),
        *[encode.fixed_code_one_hot(c, w).alias(f"{c}_vec") for c, w in WIDTHS],
        encode.intro_binary("introduction_raw").alias("intro"),
        encode.yes_flag("licence").alias("licence"),
    )
    vec = r.select(encode.assemble(r, ["intro", "scenario_vec", "licence", "gender_vec", "education_vec",
                                       "job_vec"]).alias("features"))
    # a fixed vocabulary has a fixed number of vectors: equal ones are counted before they are taken apart
    vec = vec.groupBy("features").agg(F.count(F.lit(1)).alias("n"))
    return (vec.select("n", F.posexplode("features").alias("pos", "x")).groupBy("pos")
            .agg(F.sum(F.col("x") * F.col("n")).alias("total"), F.sum("n").alias("n")))


def _fixed_vocab_sql():
    exprs = ["CASE WHEN lower(trim(introduction_raw)) = 'boasting' THEN 1.0 ELSE 0.0 END"]
    exprs += [f"CAST(trim(scenario) = '{x}' AS DOUBLE)" for x in encode.SCENARIO_LEVELS]
    exprs += ["CAST(part_key % 2 = 0 AS DOUBLE)"]
    for c, w in WIDTHS:
        exprs += [f"CAST(trim({c}) = 'A{i}' AS DOUBLE)" for i in range(1, w + 1)]
    sel = " UNION ALL ".join(f"SELECT {i} AS pos, CAST({e} AS DOUBLE) AS x FROM ratings" for i, e in enumerate(exprs))
    return fx.with_views(f"SELECT CAST(pos AS INT) AS pos, sum(x) AS total, count(*) AS n FROM ({sel}) t GROUP BY pos",
                         "ratings")


register("fixed_vocab_vector", "B20 B21 B25 B10", _fixed_vocab_sql())(fixed_vocab_vector)


# ------------------------------------------------------------------ B16-B19, B26
def label_modes(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    r, _ = encode.label(r, "rating", "floor", out="floor_label")
    r, classes = encode.label(r, "rating", "separate_fractional", out="observed_label")
    r = r.withColumn("high", encode.binary_target("rating")).withColumn(
        "observed_value", encode.class_value("observed_label", classes))
    return r.groupBy("rating", "floor_label", "observed_label", "observed_value", "high").agg(
        F.count(F.lit(1)).alias("n"))


register("label_modes", "B16 B17 B18 B19 B26", fx.with_views("""
, obs AS (SELECT rating, CAST(dense_rank() OVER (ORDER BY rating) - 1 AS INT) AS observed_label
          FROM (SELECT DISTINCT rating FROM ratings WHERE rating IS NOT NULL))
SELECT r.rating, CAST(least(5, greatest(1, floor(r.rating))) - 1 AS INT) AS floor_label, o.observed_label,
       o.rating AS observed_value, CAST(r.rating > 3 AS INT) AS high, count(*) AS n
FROM ratings r JOIN obs o ON r.rating = o.rating GROUP BY 1, 2, 3, 4, 5""", "ratings")
         .replace("\n, obs AS", ",\nobs AS"))(label_modes)


# ------------------------------------------------------------------ B13-B15
def centered_scaled(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    r = clean.center(r, "quality", "quality_c")
    r = clean.zscore(r, "rating", "rating_z")
    # min / max of the centred value are order-independent (no float sums)
    return _r6(r.groupBy("participant").agg(F.min("quality_c").alias("min_quality_c"),
                                            F.max("quality_c").alias("max_quality_c"),
                                            F.avg("rating_z").alias("mean_rating_z")))


register("centered_scaled", "B13 B14", fx.with_views("""
, s AS (SELECT avg(quality) AS mq, avg(rating) AS mr, stddev_samp(rating) AS sr FROM ratings)
SELECT participant, round(min(quality - mq), 6) AS min_quality_c, round(max(quality - mq), 6) AS max_quality_c,
       round(avg((rating - mr) / sr), 6) AS mean_rating_z
FROM ratings, s GROUP BY participant""", "ratings").replace("\n, s AS", ",\ns AS"))(centered_scaled)


def scaler_fit_apply(spark, sf_dir):
    r = split.group_split(fx.ratings(spark, sf_dir), "participant")
    stats = clean.fit_scaler(r.where(F.col("split") == "train"), ["quality", "rating"])
    test = clean.apply_scaler(r.where(F.col("split") == "test"), stats, ["quality", "rating"])
    return _r6(test.groupBy("scenario").agg(F.avg("quality").alias("mean_quality"),
                                            F.stddev_pop("rating").alias("sd_rating"), F.count(F.lit(1)).alias("n")))


register("scaler_fit_apply", "B15 H2 C3", fx.with_views(f"""
, {group_split_sql('ratings', 'participant').strip()},
r AS (SELECT ratings.*, split FROM ratings LEFT JOIN gsplit USING (participant)),
st AS (SELECT avg(quality) AS mq, stddev_pop(quality) AS sq, avg(rating) AS mr, stddev_pop(rating) AS sr
       FROM r WHERE split = 'train')
SELECT scenario, round(avg((quality - mq) / sq), 6) AS mean_quality, round(stddev_pop((rating - mr) / sr), 6) AS sd_rating,
       count(*) AS n
FROM r, st WHERE split = 'test' GROUP BY scenario""", "ratings").replace("\n, g_ AS", ",\ng_ AS"))(scaler_fit_apply)


# ------------------------------------------------------------------ B31-B33
def design_sums(spark, sf_dir):
    r = clean.center(fx.ratings(spark, sf_dir), "quality", "q")
    r = clean.recode(r, "introduction_raw", INTRO, unmapped="null", lower=True, out="introduction")
    trt = encode.treatment_columns("scenario", encode.SCENARIO_LEVELS[:1] + sorted(encode.SCENARIO_LEVELS[1:]),
                                   "3Spurig")
    sm = encode.sum_columns("introduction", ["ambiguous", "boasting"])
    d = r.select("rating", "q", *trt, *sm)
    left = ["q"]
    d = encode.interaction_columns(d, left, [c for c in d.columns if c.startswith("scenario[")])
    terms = [c for c in d.columns if c not in ("rating",)]
    arr = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("x")) for t in terms])
    long = d.select("rating", F.explode(arr).alias("t")).select("rating", "t.*")
    return _r6(long.groupBy("term").agg(F.sum(F.col("x") * F.col("x")).alias("sxx"),
                                        F.sum(F.col("x") * F.col("rating")).alias("sxy")))


def _design_sql():
    lv = ["NeueMitte", "Spielstrasse", "Ueberland"]
    terms = [("q", "q")]
    terms += [(f"scenario[T.{x}]", f"CAST(scenario = '{x}' AS DOUBLE)") for x in lv]
    terms += [("introduction[S.ambiguous]",
               "CAST(introduction = 'ambiguous' AS DOUBLE) - CAST(introduction = 'boasting' AS DOUBLE)")]
    terms += [(f"q:scenario[T.{x}]", f"q * CAST(scenario = '{x}' AS DOUBLE)") for x in lv]
    sel = " UNION ALL ".join(f"SELECT '{t}' AS term, {e} AS x, rating FROM d" for t, e in terms)
    return fx.with_views(f"""
, d AS (SELECT rating, scenario, quality - (SELECT avg(quality) FROM ratings) AS q,
               CASE lower(introduction_raw) WHEN 'ambiguous' THEN 'ambiguous' WHEN 'ambigious' THEN 'ambiguous'
                    WHEN 'boasting' THEN 'boasting' END AS introduction FROM ratings)
SELECT term, round(sum(x * x), 6) AS sxx, round(sum(x * rating), 6) AS sxy FROM ({sel}) t GROUP BY term""",
                         "ratings").replace("\n, d AS", ",\nd AS")


register("design_sums", "B31 B32 B33 B13", _design_sql())(design_sums)


# ------------------------------------------------------------------ B35, D21, F-7
def changed_cells(spark, sf_dir):
    r = fx.ratings(spark, sf_dir).select(
        "row_id", "gender", "job",
        F.when(F.col("part_key") % 3 == 0, F.lit("A1")).otherwise(F.col("gender")).alias("gender_cf"),
        F.when(F.col("line_no") > 4, F.lit("A6")).otherwise(F.col("job")).alias("job_cf"))
    ch = encode.changed_cells(r, ["row_id"], {"gender": "gender", "job": "job"},
                              {"gender": "gender_cf", "job": "job_cf"})
    return ch.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "feature")


register("changed_cells", "B35 D21 F-7", fx.with_views("""
SELECT feature, count(*) AS n FROM (
  SELECT 'gender' AS feature FROM ratings WHERE part_key % 3 = 0 AND gender IS DISTINCT FROM 'A1'
  UNION ALL SELECT 'job' FROM ratings WHERE line_no > 4 AND job IS DISTINCT FROM 'A6') t
GROUP BY feature ORDER BY n, feature""", "ratings"))(changed_cells)


# ------------------------------------------------------------------ B3, B6, B7
def cell_keys(spark, sf_dir):
    r = clean.recode(fx.ratings(spark, sf_dir), "introduction_raw", INTRO, unmapped="null", lower=True,
                     out="introduction")
    r = clean.where_all(r, introduction="boasting", scenario="NeueMitte")
    r = clean.composite_key(r.select("participant", "introduction", "scenario", "rating"),
                            ["participant", "introduction", "scenario"], "cell_key")
    return _r6(r.groupBy("cell_key").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating")))


register("cell_keys", "B3 B6 B7", fx.with_views("""
SELECT participant || '_boasting_' || scenario AS cell_key, count(*) AS n, round(avg(rating), 6) AS mean_rating
FROM ratings WHERE lower(introduction_raw) = 'boasting' AND scenario = 'NeueMitte' GROUP BY 1""",
                                             "ratings"))(cell_keys)


# ------------------------------------------------------------------ B4
def excluded_ids(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    listed = r.where((F.col("rating") == 5.0) & (F.col("quality") == 86.0)).select("participant")
    kept = clean.exclude_ids(r, "participant", listed)
    return kept.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"),
                                        F.count_distinct("participant").alias("n_participants"))


register("excluded_ids", "B4", fx.with_views("""
SELECT scenario, count(*) AS n, count(DISTINCT participant) AS n_participants FROM ratings
WHERE participant IS NULL OR participant NOT IN (SELECT participant FROM ratings WHERE rating = 5.0 AND quality = 86.0
                                                 AND participant IS NOT NULL)
GROUP BY scenario""", "ratings"))(excluded_ids)


# ------------------------------------------------------------------ B5
def min_group_rows(spark, sf_dir):
    r = clean.min_group_size(fx.ratings(spark, sf_dir), ["participant", "quality"], 30)
    return r.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_distinct("participant", "quality").alias("n_groups"))


register("min_group_rows", "B5", fx.with_views("""
, sz AS (SELECT participant, quality FROM ratings GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT scenario, count(*) AS n, count(DISTINCT (participant, quality)) AS n_groups
FROM ratings JOIN sz USING (participant, quality) GROUP BY scenario""", "ratings")
         .replace("\n, sz AS", ",\nsz AS"))(min_group_rows)


# ------------------------------------------------------------------ E1
def repeat_ids(spark, sf_dir):
    t = clean.tag_repeat_ids(fx.repeats(spark, sf_dir), "participant", ["combo"], "row_id", out="participant_adj")
    return t.groupBy("combo").agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(F.col("participant_adj").endswith("_a")).alias("n_suffixed"),
                                  F.count_distinct("participant_adj").alias("n_ids"))


register("repeat_ids", "E1", fx.with_views("""
, last_ AS (SELECT participant, arg_max(combo, row_id) AS last_combo FROM repeats GROUP BY participant),
t AS (SELECT r.combo, CASE WHEN r.combo = l.last_combo THEN r.participant ELSE r.participant || '_a' END AS pid
      FROM repeats r LEFT JOIN last_ l USING (participant))
SELECT combo, count(*) AS n, CAST(count_if(pid LIKE '%\\_a' ESCAPE '\\') AS BIGINT) AS n_suffixed,
       count(DISTINCT pid) AS n_ids
FROM t GROUP BY combo""", "repeats").replace("\n, last_ AS", ",\nlast_ AS"))(repeat_ids)


# ------------------------------------------------------------------ D3, D4, E5 on the straight fixture
def equal_response_events(spark, sf_dir):
    s = fx.straight(spark, sf_dir)
    return groups.equal_response_groups(s, ["participant", "cell"], "value")


register("equal_response_events", "D3 D4 E5", fx.with_views("""
, counts AS (SELECT participant, cell, value, count(*) AS n FROM straight GROUP BY 1, 2, 3),
marked AS (SELECT *, CASE WHEN n >= 7 AND n < 14 THEN n END AS mid FROM counts),
lagged AS (SELECT *, lag(mid) OVER (PARTITION BY participant, cell ORDER BY mid DESC NULLS LAST) AS prev FROM marked)
SELECT participant, cell,
       max(n) >= 14 OR bool_or(mid IS NOT NULL AND prev IS NOT NULL AND abs(prev - mid) <= 1) AS equal_response
FROM lagged GROUP BY 1, 2""", "straight").replace("\n, counts AS", ",\ncounts AS"))(equal_response_events)


def value_counts_events(spark, sf_dir):
    return groups.value_counts(fx.straight(spark, sf_dir), ["participant", "cell"], "value")


register("value_counts_events", "D3", fx.with_views(
    "SELECT participant, cell, value, count(*) AS n FROM straight GROUP BY 1, 2, 3", "straight"))(value_counts_events)


def straight_split_sizes(spark, sf_dir):
    s = fx.straight(spark, sf_dir)
    eq, other = groups.split_equal_response(s, ["participant", "cell"], "value")
    both = groups.union_all(eq.withColumn("part", F.lit("equal")), other.withColumn("part", F.lit("other")))
    return both.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"))


register("straight_split_sizes", "C1 C2 G1 D4", fx.with_views("""
, counts AS (SELECT participant, cell, value, count(*) AS n FROM straight GROUP BY 1, 2, 3),
marked AS (SELECT *, CASE WHEN n >= 7 AND n < 14 THEN n END AS mid FROM counts),
lagged AS (SELECT *, lag(mid) OVER (PARTITION BY participant, cell ORDER BY mid DESC NULLS LAST) AS prev FROM marked),
flags AS (SELECT participant, cell FROM lagged GROUP BY 1, 2
          HAVING max(n) >= 14 OR bool_or(mid IS NOT NULL AND prev IS NOT NULL AND abs(prev - mid) <= 1))
SELECT part, cell, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum_value FROM (
  SELECT 'equal' AS part, s.* FROM straight s SEMI JOIN flags f ON s.participant = f.participant AND s.cell = f.cell
  UNION ALL
  SELECT 'other' AS part, s.* FROM straight s ANTI JOIN flags f ON s.participant = f.participant AND s.cell = f.cell) t
GROUP BY 1, 2""", "straight").replace("\n, counts AS", ",\ncounts AS"))(straight_split_sizes)


# ------------------------------------------------------------------ D1, D2
def cell_means(spark, sf_dir):
    return _r6(groups.cell_summary(fx.panel(spark, sf_dir), ["scenario", "quality"], "rating"))


register("cell_means", "D1 D2", fx.with_views("""
SELECT scenario, quality, count(rating) AS n, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS sd
FROM panel GROUP BY 1, 2""", "panel"))(cell_means)


# ------------------------------------------------------------------ D5, D6, D23
def panel_shape(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    a = groups.panel_description(r, "participant")
    b = groups.distinct_count(r, "quality")
    c = groups.global_range(r, "rating")
    return _r6(a.crossJoin(b).crossJoin(c))


register("panel_shape", "D5 D6 D23", fx.with_views("""
, sz AS (SELECT participant, count(*) AS n FROM ratings GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, min(n) AS min_group, max(n) AS max_group,
       round(avg(n), 6) AS mean_group,
       (SELECT count(DISTINCT quality) FROM ratings) AS n_distinct_quality,
       (SELECT min(rating) FROM ratings) AS min, (SELECT max(rating) FROM ratings) AS max,
       (SELECT round(avg(rating), 6) FROM ratings) AS mean
FROM sz""", "ratings").replace("\n, sz AS", ",\nsz AS"))(panel_shape)


# ------------------------------------------------------------------ D7
def class_distribution(spark, sf_dir):
    r, _ = encode.label(fx.ratings(spark, sf_dir), "rating", "floor", out="cls")
    return _r6(groups.label_distribution(r, "cls", [0, 1, 2, 3, 4, 5]))


register("class_distribution", "D7", fx.with_views("""
, cl AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(cls)),
c AS (SELECT CAST(least(5, greatest(1, floor(rating))) - 1 AS INT) AS cls, count(*) AS n FROM ratings GROUP BY 1),
j AS (SELECT cl.cls, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM cl LEFT JOIN c USING (cls))
SELECT CAST(cls AS INT) AS cls, count, round(count / sum(count) OVER (), 6) AS share,
       round(CASE WHEN count > 0 THEN sum(count) OVER () / (count(*) OVER () * count) ELSE 0.0 END, 6) AS weight
FROM j""", "ratings").replace("\n, cl AS", ",\ncl AS"))(class_distribution)


# ------------------------------------------------------------------ C10
def group_outliers_removed(spark, sf_dir):
    r = fx.ratings(spark, sf_dir)
    kept = clean.remove_group_outliers(r, "participant", "rating", z=2.0, id_cols=["row_id"])
    return kept.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"))


register("group_outliers_removed", "C10 B4", fx.with_views("""
, med AS (SELECT participant, quantile_cont(rating, 0.5) AS md FROM ratings GROUP BY 1),
dev AS (SELECT r.row_id, r.participant, abs(r.rating - m.md) AS d FROM ratings r JOIN med m USING (participant)),
mad AS (SELECT participant, quantile_cont(d, 0.5) AS mad FROM dev GROUP BY 1),
bad AS (SELECT row_id FROM dev JOIN mad USING (participant) WHERE coalesce(d / (1.4826 * mad) > 2.0, false))
SELECT scenario, count(*) AS n, sum(rating) AS sum_rating FROM ratings
WHERE row_id NOT IN (SELECT row_id FROM bad) GROUP BY scenario""", "ratings").replace("\n, med AS", ",\nmed AS"))(
    group_outliers_removed)
