"""Remaining queries: product statistics, customer tests, ML, quality, chart data, sources and sinks."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from basketlens.functions.core import pround
from basketlens.functions.dist import norm_ppf
from basketlens.operators import charts, ltv, ml, profile, quality, stats
from basketlens.plans.oracle import mean, rnd
from basketlens.plans.q_anomaly import _PROFILE, _features
from basketlens.plans.q_customers import _CONV
from basketlens.plans.q_ltv import _DETAIL_COLS, _LTV
from basketlens.plans.registry import ORACLE, register
from basketlens.session import ensure_checkpoint_dir, saved
from basketlens.sources import retail, tables
from basketlens.sources.retail import AS_OF

# ------------------------------------------------------------------ products


def _pearson_sql(src: str, x: str, y: str, by: str | None = None, min_rows: int | None = None) -> str:
    r = f"covar_samp(x, y) / sqrt(var_samp(x) * var_samp(y))"
    t = f"({r}) * sqrt(CAST(count(*) - 2 AS DOUBLE) / (1 - ({r}) * ({r})))"
    key = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    having = f" HAVING count(*) > {min_rows}" if min_rows is not None else ""
    return f"""SELECT {key}'{x}' AS x, '{y}' AS y, count(*) AS rows, count(*) AS n, {rnd(r, 6)} AS r,
       {rnd(t, 6)} AS t, count(*) - 2 AS dof
FROM (SELECT {key}CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src}){grp}{having}"""


@register("h1_pearson_discount_orders_by_category_stats",
          _pearson_sql("v_products", "avg_discount_pct", "total_orders", "category", 3))
def h1_pearson_discount_orders_by_category_stats(spark, base):
    return stats.pearson_test(retail.products(spark, base), "avg_discount_pct", "total_orders", by=["category"],
                              min_rows=3).drop("p", "significant")


@register("h1_pearson_discount_orders_by_category")
def h1_pearson_discount_orders_by_category(spark, base):
    return stats.pearson_test(retail.products(spark, base), "avg_discount_pct", "total_orders", by=["category"],
                              min_rows=3)


@register("h7_bootstrap_corr_ci")
def h7_bootstrap_corr_ci(spark, base):
    return stats.bootstrap_corr_ci(retail.products(spark, base), "avg_discount_pct", "total_orders",
                                   by="category", key="product_id", reps=10000, seed=42)


@register("h7_uplift_scenarios")
def h7_uplift_scenarios(spark, base):
    p = retail.products(spark, base)
    ci = stats.bootstrap_corr_ci(p, "avg_discount_pct", "total_orders", by="category", key="product_id",
                                 reps=10000, seed=42)
    return stats.uplift_scenarios(ci, p, "category")


_ZSUM = norm_ppf(1 - 0.05 / 2) + norm_ppf(0.8)


@register("h8_ab_sample_size", f"""
SELECT category, count(total_orders) AS n, {rnd(mean('total_orders'), 6)} AS mean,
       {rnd('stddev_samp(CAST(total_orders AS DOUBLE))', 6)} AS std, CAST(0.5 AS DOUBLE) AS effect_size,
       CAST(ceil(2 * pow(CAST({_ZSUM!r} AS DOUBLE) / CAST(0.5 AS DOUBLE), 2)) AS BIGINT) AS required_per_group,
       count(total_orders) >= 2 * ceil(2 * pow(CAST({_ZSUM!r} AS DOUBLE) / CAST(0.5 AS DOUBLE), 2)) AS enough
FROM v_products GROUP BY category""")
def h8_ab_sample_size(spark, base):
    a = stats.ab_sample_size(retail.products(spark, base), "category", "total_orders", effect_size=0.5)
    return a.select("category", "n", pround("mean", 6).alias("mean"), pround("std", 6).alias("std"),
                    "effect_size", F.col("required_per_group").cast("bigint").alias("required_per_group"), "enough")


@register("p14_min_group_size", """
SELECT product_id, category FROM v_products
WHERE category IN (SELECT category FROM v_products GROUP BY category HAVING count(*) > 300)""")
def p14_min_group_size(spark, base):
    return profile.min_group_size(retail.products(spark, base), "category", 300).select("product_id", "category")


# ------------------------------------------------------------------ customers

_SAT = ["reviews_given", "avg_review_score", "returns_made"]


def _corr_sql(src: str, pairs, with_t: bool, digits: int = 6) -> str:
    parts = []
    for a, b in pairs:
        cond = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        xa, yb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        r = f"covar_samp({xa}, {yb}) / sqrt(var_samp({xa}) * var_samp({yb}))"
        extra = ""
        if with_t:
            t = f"({r}) * sqrt(CAST(count(*) - 2 AS DOUBLE) / (1 - ({r}) * ({r})))"
            extra = f", {rnd(t, 6)} AS t, count(*) - 2 AS dof"
        parts.append(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, {rnd(r, digits)} AS r{extra} "
                     f"FROM {src} WHERE {cond}")
    return "\nUNION ALL\n".join(parts)


@register("a27_satisfaction_correlation_matrix", _corr_sql("v_customers", [(a, b) for a in _SAT for b in _SAT],
                                                            False, 3))
def a27_satisfaction_correlation_matrix(spark, base):
    return stats.correlation_matrix(retail.customers(spark, base), _SAT)


@register("h1_satisfaction_pair_tests_stats", _corr_sql("v_customers", [(a, b) for i, a in enumerate(_SAT)
                                                                         for b in _SAT[i + 1:]], True))
def h1_satisfaction_pair_tests_stats(spark, base):
    return stats.pairwise_tests(retail.customers(spark, base), _SAT).drop("p", "significant")


@register("h1_satisfaction_pair_tests")
def h1_satisfaction_pair_tests(spark, base):
    return stats.pairwise_tests(retail.customers(spark, base), _SAT)


_ENG = ["reviews_given", "wishlist_items", "newsletter_subscribed"]
_PUR = ["total_orders", "total_spend_usd", "avg_order_value_usd"]


@register("h2_engagement_purchase_grid_stats", _corr_sql("v_customers", [(a, b) for a in _ENG for b in _PUR], True))
def h2_engagement_purchase_grid_stats(spark, base):
    return stats.correlation_grid(retail.customers(spark, base), _ENG, _PUR).drop("p", "significant")


@register("h2_engagement_purchase_grid")
def h2_engagement_purchase_grid(spark, base):
    return stats.correlation_grid(retail.customers(spark, base), _ENG, _PUR)


def _kw_sql(value: str, group: str, src: str) -> str:
    from basketlens.plans.q_orders import _kw_sql as k
    return k(value, group, src)


@register("h5_kruskal_channel_spend_stats", _kw_sql("total_spend_usd", "acquisition_channel", "v_customers"))
def h5_kruskal_channel_spend_stats(spark, base):
    return stats.kruskal_wallis(retail.customers(spark, base), "total_spend_usd", "acquisition_channel").drop(
        "p", "significant")


@register("h5_kruskal_channel_spend")
def h5_kruskal_channel_spend(spark, base):
    return stats.kruskal_wallis(retail.customers(spark, base), "total_spend_usd", "acquisition_channel")


def _chi_customers_sql() -> str:
    from basketlens.plans.q_orders import _chi_sql
    return _chi_sql(["acquisition_channel", "membership_tier"], "churned").replace("FROM v_lines", "FROM v_customers")


@register("h3_chi_square_churn_stats", _chi_customers_sql())
def h3_chi_square_churn_stats(spark, base):
    return stats.chi_square(retail.customers(spark, base), ["acquisition_channel", "membership_tier"],
                            "churned").drop("p", "significant")


@register("h3_chi_square_churn")
def h3_chi_square_churn(spark, base):
    return stats.chi_square(retail.customers(spark, base), ["acquisition_channel", "membership_tier"], "churned")


# ------------------------------------------------------------------ ML

_FEATS = ml.CHURN_FEATURES
_DROPNA = " AND ".join(f"{f} IS NOT NULL" for f in _FEATS + ["churned"])


@register("m1_standardize", f"""
WITH d AS (SELECT customer_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _FEATS)} FROM v_customers
           WHERE {_DROPNA})
SELECT customer_id, {', '.join(rnd(f'coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0.0)', 6) + f' AS z_{f}' for f in _FEATS)}
FROM d""")
def m1_standardize(spark, base):
    from basketlens.operators.forest import standardize
    c = retail.customers(spark, base).select("customer_id", "churned", *_FEATS).dropna()
    c = c.select("customer_id", *[F.col(f).cast("double").alias(f) for f in _FEATS])
    z = standardize(c, _FEATS, fill=None)
    return z.select("customer_id", *[pround(f"_z_{f}", 6).alias(f"z_{f}") for f in _FEATS])


_M2 = f"""
WITH c AS (SELECT customer_id, churned, {ml.split_hash_sql('customer_id', 42)} AS h FROM v_customers),
k AS (SELECT churned, count(*) AS nc FROM c GROUP BY churned),
t AS (SELECT *, CAST(ceil(sum(nc) OVER () * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t, CAST(sum(nc) OVER () AS BIGINT) AS n FROM k),
w AS (SELECT *, (t * nc) // n AS whole, (t * nc) % n AS rest FROM t),
s AS (SELECT churned, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, churned NULLS FIRST) <= t - sum(whole) OVER ()
                                   THEN 1 ELSE 0 END AS n_test FROM w),
m AS (SELECT customer_id, c.churned, row_number() OVER (PARTITION BY c.churned ORDER BY h, customer_id) <= n_test AS is_test
      FROM c JOIN s ON c.churned IS NOT DISTINCT FROM s.churned)"""


@register("m2_stratified_split", f"{_M2} SELECT churned, is_test, count(*) AS n FROM m GROUP BY churned, is_test")
def m2_stratified_split(spark, base):
    c = retail.customers(spark, base)
    s = ml.stratified_split(c, "churned", "customer_id", 0.2, 42)
    return s.groupBy("churned", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("m2_split_members", f"{_M2} SELECT customer_id, churned, is_test FROM m")
def m2_split_members(spark, base):
    """Which customers are test rows: the same integer hash in both engines."""
    return ml.stratified_split(retail.customers(spark, base).select("customer_id", "churned"), "churned", "customer_id", 0.2, 42)


def _model(spark, base):
    return ml.churn_model(retail.customers(spark, base), _FEATS, "churned", key="customer_id", seed=42)


@register("m3_churn_model_coefficients")
def m3_churn_model_coefficients(spark, base):
    return _model(spark, base)["coefficients"]


@register("m5_classification_report")
def m5_classification_report(spark, base):
    return _model(spark, base)["report"]


# ------------------------------------------------------------------ quality

# The driver tables' column types as Spark prints them (FIXTURES.md section 2).
QUALITY_TABLES = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
}
RELATIONS = [("orders", "o_custkey", "customer", "c_custkey"),
             ("lineitem", "l_orderkey", "orders", "o_orderkey"),
             ("lineitem", "l_partkey", "part", "p_partkey"),
             ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
             ("customer", "c_nationkey", "nation", "n_nationkey"),
             ("labels", "doc_id", "documents", "doc_id")]
_NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


#: All 14 driver tables, vectors and raw pages included.
ALL_TABLES = {**QUALITY_TABLES,
              "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
              "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")]}


def _quality_tables(spark, base, which=None):
    return {t: tables.load_table(spark, t, base) for t in which or QUALITY_TABLES}


def _each_table(spark, base, check, which=None):
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), [check(df, t) for t, df in _quality_tables(spark, base, which).items()])


def _q_nulls_sql(t: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", '{ty}' AS dtype, count(*) - count({c}) AS null_count,
       {rnd(f'CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*)')} AS null_pct,
       (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicates,
       count(*) AS row_count FROM {t}""" for c, ty in ALL_TABLES[t])


@register("a21_table_quality", "\nUNION ALL\n".join(_q_nulls_sql(t) for t in QUALITY_TABLES))
def a21_table_quality(spark, base):
    from functools import reduce
    frames = [quality.table_quality(df, t) for t, df in _quality_tables(spark, base).items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


@register("a22_duplicate_count", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))"
    f" AS duplicates" for t in QUALITY_TABLES))
def a22_duplicate_count(spark, base):
    from functools import reduce
    frames = [quality.duplicate_count(df).select(F.lit(t).alias("table"), "duplicates")
              for t, df in _quality_tables(spark, base).items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _strings(t: str) -> list[str]:
    return [c for c, ty in ALL_TABLES[t] if ty == "string"]


def _empty_sql(which=QUALITY_TABLES) -> str:
    parts = []
    for t in which:
        for c in _strings(t):
            parts.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", count(CASE WHEN {c} = '' THEN 1 END) AS empty_strings,
       {rnd(f"CAST(count(CASE WHEN {c} = '' THEN 1 END) AS DOUBLE) * 100 / count(*)")} AS pct FROM {t}""")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE empty_strings > 0"


@register("a23_empty_string_check", _empty_sql())
def a23_empty_string_check(spark, base):
    from functools import reduce
    frames = [quality.empty_string_check(df, t) for t, df in _quality_tables(spark, base).items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _numeric_sql(min_rate: float = 0.8, which=QUALITY_TABLES) -> str:
    parts = []
    for t in which:
        for c in _strings(t):
            ok = f"count(CASE WHEN regexp_full_match(trim({c}), '{_NUM_RE}') THEN 1 END)"
            parts.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", 'string' AS dtype, count({c}) AS nn, {ok} AS ok
FROM {t}""")
    return f"""SELECT "table", "column", dtype, {rnd('CAST(ok AS DOUBLE) / nn * 100', 1)} AS numeric_pct,
       'Likely numeric stored as text' AS flag
FROM ({' UNION ALL '.join(parts)}) WHERE nn > 0 AND ok > 0 AND CAST(ok AS DOUBLE) / nn > {min_rate}"""


@register("a24_numeric_text_check", _numeric_sql())
def a24_numeric_text_check(spark, base):
    from functools import reduce
    frames = [quality.numeric_text_check(df, t) for t, df in _quality_tables(spark, base).items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _orphan_sql() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS child, '{ck}' AS child_key, '{p}' AS parent, count(DISTINCT x.{ck}) AS orphaned
FROM {c} x LEFT JOIN (SELECT DISTINCT {pk} FROM {p}) y ON x.{ck} = y.{pk} WHERE y.{pk} IS NULL"""
        for c, ck, p, pk in RELATIONS)


@register("j2_orphans", _orphan_sql())
def j2_orphans(spark, base):
    from functools import reduce
    tb = _quality_tables(spark, base)
    frames = [quality.orphans(tb[c], tb[p], ck, pk).select(F.lit(c).alias("child"), F.lit(ck).alias("child_key"),
                                                           F.lit(p).alias("parent"), "orphaned")
              for c, ck, p, pk in RELATIONS]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _validate_sql(which=QUALITY_TABLES, relations=RELATIONS) -> str:
    nulls = "\nUNION ALL\n".join(
        f"""SELECT 'nulls' AS "check", '{t}' AS "table", '{c}' AS "column", CAST(count(*) - count({c}) AS DOUBLE) AS value,
       CASE WHEN count(*) - count({c}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {t}"""
        for t in which for c, _ in which[t])
    dups = "\nUNION ALL\n".join(
        f"""SELECT 'duplicates', '{t}', CAST(NULL AS VARCHAR), CAST(d AS DOUBLE), CASE WHEN d = 0 THEN 'PASS' ELSE 'FAIL' END
FROM (SELECT (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS d)"""
        for t in which)
    empt = f"""SELECT 'empty_strings', "table", "column", CAST(empty_strings AS DOUBLE), 'FAIL' FROM ({_empty_sql(which)})"""
    numt = f"""SELECT 'numeric_text', "table", "column", numeric_pct, 'WARN' FROM ({_numeric_sql(which=which)})"""
    orph = "\nUNION ALL\n".join(
        f"""SELECT 'orphans:{p}.{pk}', '{c}', '{ck}', CAST(count(DISTINCT x.{ck}) AS DOUBLE),
       CASE WHEN count(DISTINCT x.{ck}) = 0 THEN 'PASS' ELSE 'FAIL' END
FROM {c} x LEFT JOIN (SELECT DISTINCT {pk} FROM {p}) y ON x.{ck} = y.{pk} WHERE y.{pk} IS NULL"""
        for c, ck, p, pk in relations)
    return "\nUNION ALL\n".join([nulls, dups, empt, numt, orph])


@register("g1_validate_all", _validate_sql())
def g1_validate_all(spark, base):
    return quality.validate_all(_quality_tables(spark, base), RELATIONS)


#: Every key that refers to another table.
ALL_RELATIONS = [*RELATIONS, ("supplier", "s_nationkey", "nation", "n_nationkey"), ("events", "user_id", "customer", "c_custkey"),
                 ("nation", "n_regionkey", "region", "r_regionkey")]


@register("a21_table_quality_all", "\nUNION ALL\n".join(_q_nulls_sql(t) for t in ALL_TABLES))
def a21_table_quality_all(spark, base):
    """Null counts, duplicates and types of all 14 tables."""
    return _each_table(spark, base, quality.table_quality, ALL_TABLES)


@register("a22_duplicate_count_all", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))"
    f" AS duplicates" for t in ALL_TABLES))
def a22_duplicate_count_all(spark, base):
    return _each_table(spark, base, lambda df, t: quality.duplicate_count(df).select(F.lit(t).alias("table"), "duplicates"), ALL_TABLES)


@register("a22_duplicate_count_subset", """SELECT (SELECT count(*) FROM documents)
    - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates""")
def a22_duplicate_count_subset(spark, base):
    """Documents that repeat text and language: texts are hashed in the scan, never shuffled."""
    return quality.duplicate_count(tables.load_table(spark, "documents", base), ["text", "lang"])


@register("a23_empty_string_check_all", _empty_sql(ALL_TABLES))
def a23_empty_string_check_all(spark, base):
    return _each_table(spark, base, quality.empty_string_check, ALL_TABLES)


@register("a24_numeric_text_check_all", _numeric_sql(which=ALL_TABLES))
def a24_numeric_text_check_all(spark, base):
    return _each_table(spark, base, quality.numeric_text_check, ALL_TABLES)


@register("g1_validate_all_tables", _validate_sql(ALL_TABLES, ALL_RELATIONS))
def g1_validate_all_tables(spark, base):
    """Every check over all 14 tables and all nine relations."""
    return quality.validate_all(_quality_tables(spark, base, ALL_TABLES), ALL_RELATIONS)


@register("s6_coerce_numeric", f"""
SELECT o_orderkey,
       CASE WHEN regexp_full_match(trim(o_orderpriority), '{_NUM_RE}') THEN CAST(trim(o_orderpriority) AS DOUBLE) END
         AS o_orderpriority,
       CASE WHEN regexp_full_match(trim(split_part(o_orderpriority, '-', 1)), '{_NUM_RE}')
            THEN CAST(trim(split_part(o_orderpriority, '-', 1)) AS DOUBLE) END AS priority_rank
FROM orders""")
def s6_coerce_numeric(spark, base):
    o = tables.load_table(spark, "orders", base).select(
        "o_orderkey", "o_orderpriority", F.split("o_orderpriority", "-")[0].alias("priority_rank"))
    return tables.coerce_numeric(o, ["o_orderpriority", "priority_rank", "not_present"])


# ------------------------------------------------------------------ chart data

_HIST_BINS = 40


@register("v1_histogram_return_rate", f"""
WITH {_PROFILE},
rg AS (SELECT min(return_rate) AS lo, max(return_rate) AS hi FROM feat),
c AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((return_rate - lo) * (CAST({_HIST_BINS} AS DOUBLE) / (hi - lo))), {_HIST_BINS - 1}) END AS INTEGER) AS bin,
             count(*) AS n FROM feat, rg WHERE return_rate IS NOT NULL GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, lo + CAST(r.range AS INTEGER) * ((hi - lo) / {_HIST_BINS}) AS lower,
       lo + (CAST(r.range AS INTEGER) + 1) * ((hi - lo) / {_HIST_BINS}) AS upper, coalesce(c.n, 0) AS n
FROM range({_HIST_BINS}) r CROSS JOIN rg LEFT JOIN c ON CAST(r.range AS INTEGER) = c.bin""")
def v1_histogram_return_rate(spark, base):
    return charts.histogram(_features(spark, base), "return_rate", _HIST_BINS)


@register("v1_histogram_markers", f"""
WITH {_PROFILE}
SELECT {rnd(mean('return_rate'), 6)} AS mean, {rnd('quantile_cont(return_rate, 0.75)', 6)} AS p75,
       {rnd('quantile_cont(return_rate, 0.9)', 6)} AS p90, {rnd('quantile_cont(return_rate, 0.95)', 6)} AS p95 FROM feat""")
def v1_histogram_markers(spark, base):
    m = charts.markers(_features(spark, base), "return_rate")
    return m.select(*[pround(c, 6).alias(c) for c in m.columns])


def _conv_dec(spark, base):
    conv = profile.audience_conversion(retail.customers(spark, base))
    return conv.withColumn("total_spend", F.col("total_spend").cast("decimal(24,2)"))


@register("v2_concentration_heatmap", f"""
WITH {_CONV},
top AS (SELECT country FROM conv GROUP BY country ORDER BY sum(CAST(total_spend AS DECIMAL(24,2))) DESC, country LIMIT 8),
cells AS (SELECT country, age_group, sum(CAST(total_spend AS DECIMAL(24,2))) AS total_spend FROM conv
          WHERE country IN (SELECT country FROM top) GROUP BY country, age_group),
ages AS (SELECT * FROM (VALUES ('18-24', 0), ('25-31', 1), ('32-38', 2), ('39-45', 3), ('46-52', 4), ('53-59', 5),
                               ('60+', 6)) a(age_group, age_group_ord)),
g AS (SELECT r.country, a.age_group, a.age_group_ord, c.total_spend
      FROM (SELECT DISTINCT country FROM cells) r CROSS JOIN ages a
      LEFT JOIN cells c ON c.country = r.country AND c.age_group = a.age_group)
SELECT country, age_group, age_group_ord, CAST(total_spend AS DOUBLE) AS total_spend,
       CAST(total_spend AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(max(total_spend) OVER (PARTITION BY country) AS DOUBLE) AS "index"
FROM g""")
def v2_concentration_heatmap(spark, base):
    h = charts.concentration_heatmap(_conv_dec(spark, base), 8, "indexed")
    return h.withColumn("total_spend", F.col("total_spend").cast("double"))


@register("v3_country_profile_grid", f"""
WITH {_CONV},
one AS (SELECT age_group, gender, total_spend, avg_spend FROM conv WHERE country = 'NATION_1'),
g AS (SELECT * FROM (VALUES ('18-24', 0), ('25-31', 1), ('32-38', 2), ('39-45', 3), ('46-52', 4), ('53-59', 5),
                            ('60+', 6)) a(age_group, age_group_ord)
      CROSS JOIN (VALUES ('Female', 0), ('Male', 1), ('Other', 2)) s(gender, gender_ord))
SELECT g.age_group, g.gender, g.age_group_ord, g.gender_ord, coalesce(one.total_spend, 0.0) AS total_spend,
       coalesce(one.avg_spend, 0.0) AS avg_spend
FROM g LEFT JOIN one ON g.age_group = one.age_group AND g.gender = one.gender""")
def v3_country_profile_grid(spark, base):
    return charts.country_profile_grid(profile.audience_conversion(retail.customers(spark, base)), "NATION_1")


@register("v5_scatter_sample")
def v5_scatter_sample(spark, base):
    return charts.scatter_sample(retail.products(spark, base), ["avg_discount_pct", "total_orders", "category"],
                                 "product_id", n=2000)


@register("o4_top_segments", f"""
WITH {_CONV}
SELECT * FROM conv ORDER BY total_spend DESC, country, age_group, gender LIMIT 20""")
def o4_top_segments(spark, base):
    return profile.audience_conversion(retail.customers(spark, base)).limit(20)


@register("j3_keep_top_keys", """
WITH top AS (SELECT customer_id FROM v_lines GROUP BY customer_id
             ORDER BY sum(total_amount_usd) DESC, customer_id LIMIT 5)
SELECT order_id, line_number, customer_id, CAST(total_amount_usd AS DOUBLE) AS total_amount_usd
FROM v_lines WHERE customer_id IN (SELECT customer_id FROM top)""")
def j3_keep_top_keys(spark, base):
    t = charts.keep_top_keys(retail.lines(spark, base), "customer_id", "total_amount_usd", 5)
    return t.select("order_id", "line_number", "customer_id",
                    F.col("total_amount_usd").cast("double").alias("total_amount_usd"))


# ------------------------------------------------------------------ sources and sinks

@register("s2_load_table", "SELECT * FROM customer")
def s2_load_table(spark, base):
    return tables.load_table(spark, "customer", base)


_S3 = """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus"""


@register("s3_sql", _S3)
def s3_sql(spark, base):
    tables.register_tables(spark, base, ["lineitem"])
    return tables.sql(spark, _S3)


@register("s5_load_parts", "SELECT * FROM orders")
def s5_load_parts(spark, base):
    return tables.load_parts(spark, [tables.table_path(base, "orders")])


@register("s5_load_drifting_parts", """SELECT o_orderkey, o_custkey, o_orderdate,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def s5_load_drifting_parts(spark, base):
    """Three parts of orders as older exports would have them: columns missing, keys as int, text or bigint, prices as decimals."""
    out = _scratch(spark)
    o = tables.load_table(spark, "orders", base)
    parts = {
        "a": o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("int").alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_orderdate"),
        "b": o.where("o_orderkey % 3 = 1").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderdate",
                                                   F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")),
        "c": o.where("o_orderkey % 3 = 2"),
    }
    for name, df in parts.items():
        df.write.parquet(f"{out}/{name}")
    return tables.load_parts(spark, [f"{out}/{name}" for name in parts])


@register("u3_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def u3_distinct_rows(spark, base):
    return tables.load_table(spark, "lineitem", base).select("l_returnflag", "l_linestatus", "l_discount").distinct()


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketlens-out/{uuid.uuid4().hex}"


@register("s7_export_tables_csv")
def s7_export_tables_csv(spark, base):
    out = _scratch(spark)
    tbl = {"nation": tables.load_table(spark, "nation", base), "region": tables.load_table(spark, "region", base)}
    tables.export_tables(tbl, out, fmt="csv")
    return spark.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(
        f"{out}/nation")


@register("s8_export_tables_parquet")
def s8_export_tables_parquet(spark, base):
    out = _scratch(spark)
    tables.export_tables({"monthly_revenue": profile.temporal_by(retail.lines(spark, base), ["year", "month"])},
                         out, fmt="parquet")
    return spark.read.parquet(f"{out}/monthly_revenue")


@register("s9_export_ltv_snapshot")
def s9_export_ltv_snapshot(spark, base):
    out = _scratch(spark)
    detail = ltv.ltv_pipeline(retail.customers(spark, base), AS_OF)
    path = tables.export_snapshot(detail, ltv.ltv_aggregate(detail), out, "20010802_0000", detail_columns=_DETAIL_COLS)
    return tables.read_export(spark, path, "detail", _DETAIL_COLS)


_S9_DIMS = ("membership_tier", "country", "age_group")


@register("s9_export_by_dimension", f"""
WITH a AS ({ORACLE["a8_ltv_aggregate"]})
SELECT 'by_' || dimension AS output, segment, customer_count, avg_ltv, median_ltv, avg_projected_ltv FROM a""")
def s9_export_by_dimension(spark, base):
    """The three outputs by dimension of one export job, read back from their folders."""
    detail = ltv.ltv_pipeline(retail.customers(spark, base), AS_OF)
    path = tables.export_snapshot(detail, ltv.ltv_aggregate(detail), _scratch(spark), "20010802_0000", detail_columns=_DETAIL_COLS)
    cols = ["segment", "customer_count", "avg_ltv", "median_ltv", "avg_projected_ltv"]
    frames = [tables.read_export(spark, path, f"by_{d}", cols).withColumn("output", F.lit(f"by_{d}")) for d in _S9_DIMS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@register("s10_append_ltv_snapshot", f"""
SELECT d.snapshot_date, d.pipeline_version, count(*) AS rows
FROM customer, (VALUES (DATE '{AS_OF}', '1.0'), (DATE '{AS_OF}', '1.10'), (DATE '2001-09-01', '1.0')) AS d(snapshot_date, pipeline_version)
GROUP BY ALL""")
def s10_append_ltv_snapshot(spark, base):
    """Two versions of a date stay, a repeated run supersedes its own, a run that was never published is not seen."""
    from basketlens.streaming import snapshots
    out = _scratch(spark)
    detail = ltv.ltv_pipeline(retail.customers(spark, base), AS_OF)
    snapshots.append_snapshot(ltv.snapshot_rows(detail, AS_OF), out)
    snapshots.append_snapshot(ltv.snapshot_rows(detail, AS_OF, "1.10"), out)
    snapshots.append_snapshot(ltv.snapshot_rows(detail, "2001-09-01"), out)
    snapshots.append_snapshot(ltv.snapshot_rows(detail, AS_OF), out)
    snapshots.write_run(ltv.snapshot_rows(detail, "2001-10-01"), out)  # a run that fails before it publishes
    return snapshots.read_snapshots(spark, out).groupBy("snapshot_date", "pipeline_version").agg(F.count(F.lit(1)).alias("rows"))


def _ltv_at(day: str) -> str:
    return f"(WITH {_LTV.replace(AS_OF, day)} SELECT customer_id, ltv, projected_ltv, churn_probability FROM ltvd)"


@register("s11_snapshot_asof", f"""
SELECT b.customer_id, DATE '2002-08-02' AS snapshot_date, DATE '2001-08-02' AS previous_snapshot,
       b.projected_ltv, b.projected_ltv - a.projected_ltv AS projected_ltv_change, b.ltv - a.ltv AS ltv_change
FROM {_ltv_at("2002-08-02")} b JOIN {_ltv_at("2001-08-02")} a ON a.customer_id = b.customer_id""")
def s11_snapshot_asof(spark, base):
    """History since 2002 only: each customer's predecessor lies before the range and is still found."""
    from basketlens.streaming.snapshots import append_snapshot, read_snapshot_history
    out = _scratch(spark)
    c = retail.customers(spark, base)
    for day in ("2000-08-02", "2001-08-02", "2002-08-02"):
        append_snapshot(ltv.snapshot_rows(ltv.ltv_pipeline(c, day), day), out)
    h = read_snapshot_history(spark, out, since="2002-01-01")
    return h.select("customer_id", "snapshot_date", "previous_snapshot", "projected_ltv", "projected_ltv_change", "ltv_change")


@register("s11_snapshot_history")
def s11_snapshot_history(spark, base):
    from basketlens.streaming.snapshots import append_snapshot, read_snapshot_history
    out = _scratch(spark)
    c = retail.customers(spark, base)
    append_snapshot(ltv.snapshot_rows(ltv.ltv_pipeline(c, "2001-08-02"), "2001-08-02"), out)
    append_snapshot(ltv.snapshot_rows(ltv.ltv_pipeline(c, "2002-08-02"), "2002-08-02"), out)
    return read_snapshot_history(spark, out, since="2001-01-01")


# ------------------------------------------------------------------ ingestion and stage pipelines

@register("s1_ingest_tables")
def s1_ingest_tables(spark, base):
    """Raw CSV (written from the driver tables) -> declared schema -> Parquet, with row counts."""
    from pyspark.sql import types as T

    raw = _scratch(spark)
    for t in ("customer", "orders"):
        tables.load_table(spark, t, base).write.option("header", True).csv(f"{raw}/{t}.csv")
    schemas = {
        "customer": T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                                  T.StructField("c_nationkey", T.IntegerType()),
                                  T.StructField("c_acctbal", T.DoubleType()),
                                  T.StructField("c_mktsegment", T.StringType())]),
        "orders": T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                                T.StructField("o_orderstatus", T.StringType()),
                                T.StructField("o_totalprice", T.DoubleType()),
                                T.StructField("o_orderdate", T.TimestampNTZType()),
                                T.StructField("o_orderpriority", T.StringType())]),
        "supplier": T.StructType([T.StructField("s_suppkey", T.LongType())]),  # absent input: reported
    }
    return tables.ingest_tables(spark, raw, _scratch(spark), schemas)


def _exports(products, customers, orders):
    """The retail tables, the LTV detail and one frame per LTV dimension; the runner's writes are the export."""
    detail = saved(ltv.ltv_pipeline(customers, AS_OF), "ltv")
    aggregates = saved(ltv.ltv_aggregate(detail), "ltv_aggregates")
    out = {"product_summary": products, "customers": customers, "orders": orders,
           "monthly_revenue": profile.temporal_by(orders, ["year", "month"]),
           "ltv_customers": detail.select("customer_id", "country", "age_group", "gender", "membership_tier", "lifespan_years",
                                          "ltv", "annual_spend_rate", "churn_probability", "survival_probability",
                                          "projected_ltv")}
    for d in ("membership_tier", "country", "age_group"):
        out[f"ltv_by_{d}"] = aggregates.where(F.col("dimension") == d)
    return out


def _stage(spark, base, name):
    from basketlens.plans import reports

    views = {"products": lambda: retail.products(spark, base), "customers": lambda: retail.customers(spark, base),
             "orders": lambda: retail.stored_lines(spark, base, reports.NOT_IN_REPORTS)}
    if name is None:  # several stages read a view: each is written once, by the first, and lasts for the run
        views = {"products": lambda: saved(retail.products(spark, base), "products", scope=0),
                 "customers": lambda: saved(retail.customers(spark, base, stored=views["orders"]()), "customers", scope=0),
                 "orders": lambda: retail.stored_lines(spark, base, scope=0)}
        views = {k: lru_cache(maxsize=1)(view) for k, view in views.items()}
    stages = {
        "validate": lambda: {"checks": reports.validation(_quality_tables(spark, base, ALL_TABLES), ALL_RELATIONS)},
        "products": lambda: reports.product_analysis(views["products"](), "PROMO"),
        "customers": lambda: reports.customer_analysis(views["customers"](), cohort_floor=1997,
                                                       country="NATION_1"),
        "customers_extended": lambda: reports.customer_analysis_extended(views["customers"]()),
        "ltv": lambda: reports.ltv_analysis(views["customers"](), AS_OF),
        "orders": lambda: reports.order_analysis(views["orders"]()),
        "anomaly": lambda: reports.anomaly_reports(views["orders"]() if name is None else retail.lines(spark, base), retail.customer_attributes(spark, base)),
        "exports": lambda: _exports(*(views[k]() for k in ("products", "customers", "orders"))),
    }
    return stages if name is None else {name: stages[name]}


@register("g2_product_analysis")
def g2_product_analysis(spark, base):
    from basketlens.plans.reports import run_pipeline
    return run_pipeline(spark, _stage(spark, base, "products"))


@register("g3_customer_analysis")
def g3_customer_analysis(spark, base):
    from basketlens.plans.reports import run_pipeline
    return run_pipeline(spark, _stage(spark, base, "customers"))


@register("g4_customer_analysis_extended")
def g4_customer_analysis_extended(spark, base):
    from basketlens.plans.reports import run_pipeline
    return run_pipeline(spark, _stage(spark, base, "customers_extended"))


@register("g5_order_analysis")
def g5_order_analysis(spark, base):
    from basketlens.plans.reports import run_pipeline
    return run_pipeline(spark, _stage(spark, base, "orders"))


@register("g6_run_pipeline")
def g6_run_pipeline(spark, base):
    """Every stage in the reference's order, the exports last; each output is written."""
    from basketlens.plans.reports import run_pipeline
    return run_pipeline(spark, _stage(spark, base, None))
