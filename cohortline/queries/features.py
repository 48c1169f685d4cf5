"""Queries of scans, keys, feature blocks, states and target encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.masks import PRESETS
from ..functions.metrics import average_rank, quantiles
from ..operators import blocks as B
from ..operators import priors as P
from ..operators import states as S
from ..schema import Stages, staged
from ..sources.accounts import DUCK, accounts

QUERIES, ORACLES = {}, {}


def register(name: str, query, oracle: str | None = None, prefix: bool = True) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = (f"WITH {DUCK}" + (", " if oracle.lstrip().startswith("+") else " ") + oracle.lstrip().removeprefix("+")) if prefix else oracle


def duck(expression: str) -> str:
    """The dialect's differences: literals of doubles."""
    return expression.replace("1e0", "cast(1 AS DOUBLE)").replace("0e0", "cast(0 AS DOUBLE)")


def duck_stages(stages: Stages, source: str = "accounts") -> str:
    """Nested selects that add each stage's columns."""
    sql = f"SELECT * FROM {source}"
    for s in stages:
        sql = f"SELECT *, {', '.join(f'{duck(e)} AS {c}' for c, e in s.items())} FROM ({sql})"
    return sql


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint", "tinyint") else F.col(c) for c in columns])


DOUBLES = (
    "monthly_per_tenure annual_cycle_progress two_year_cycle_progress contract_cycle_progress support_share_of_addons monthly_per_active_service effective_monthly_charge "
    "current_vs_effective_monthly_delta current_vs_effective_monthly_ratio pclip_MonthlyCharges pclip_TotalCharges pclip_monthly_per_tenure pclip_total_per_tenure pclip_total_minus_monthly_tenure pclip_sum"
).split()
TEXTS = "tenure_bin tenure_x_contract payment_x_contract payment_x_internet techsupport_x_onlinesecurity annual_boundary_bin contract_boundary_bin contract_x_boundary_bin bundle_archetype support_signature streaming_signature service_topology service_signature".split()


def _select(columns: list[str], doubles=(), texts=()) -> str:  # noqa: ANN001
    return ", ".join(f"round({c} + 0.000000001, 6) AS {c}" if c in doubles else c if c in texts else f"cast({c} AS BIGINT) AS {c}" for c in columns)


for _b, _stages in B.PROJECTIONS.items():
    _columns = ["id", *[c for s in _stages for c in s if not c.startswith("_")]]
    register(
        f"block_{_b.lower()}",
        lambda spark, d, b=_b, columns=_columns: rounded(B.apply_blocks(accounts(spark, d), b), columns),
        f"SELECT {_select(_columns, DOUBLES, TEXTS)} FROM ({duck_stages(_stages)})",
    )

_AVG_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY {k})"


def _window_stats(medians, means, ranks) -> dict[str, str]:  # noqa: ANN001
    out = {}
    for k, p in (("_detail", "d"), ("_fallback", "f")):
        out[f"{p}_rows"] = f"count(*) OVER (PARTITION BY {k})"
        out |= {f"{p}_med_{c}": f"median({c}) OVER (PARTITION BY {k})" for c in medians} | {f"{p}_avg_{c}": f"avg({c}) OVER (PARTITION BY {k})" for c in means}
        out |= {f"{p}_rank_{c}": _AVG_RANK.format(k=k, c=c) for c in ranks}
    return out


def _use(c: str) -> str:
    return f"CASE WHEN d_rows >= 75 THEN d_{c} ELSE f_{c} END"


_H_STAGES = [
    *B.BASES["H"],
    {
        **_window_stats(["_support", "_ent", "_paid"], ["_share", "_mix"], ["_support", "_ent", "_mix"]),
        **{f"{p}_n{c}": f"count(*) OVER (PARTITION BY {k}, {c})" for k, p in (("_detail", "d"), ("_fallback", "f")) for c in ("_bundle", "_signature")},
    },
    {
        "contrast_cohort_rows": _use("rows"), "contrast_used_fallback_cohort": "CASE WHEN d_rows >= 75 THEN 0 ELSE 1 END", "support_count_minus_contrast_cohort": f"_support - ({_use('med__support')})",
        "entertainment_count_minus_contrast_cohort": f"_ent - ({_use('med__ent')})", "paid_services_minus_contrast_cohort": f"_paid - ({_use('med__paid')})", "support_share_minus_contrast_cohort": f"_share - ({_use('avg__share')})",
        "service_mix_minus_contrast_cohort": f"_mix - ({_use('avg__mix')})", "support_count_rank_in_contrast_cohort": _use("rank__support"), "entertainment_count_rank_in_contrast_cohort": _use("rank__ent"),
        "service_mix_rank_in_contrast_cohort": _use("rank__mix"), "bundle_archetype_rows_in_contrast_cohort": _use("n_bundle"), "service_signature_rows_in_contrast_cohort": _use("n_signature"),
    },
    {
        "bundle_archetype_share_in_contrast_cohort": "cast(bundle_archetype_rows_in_contrast_cohort AS DOUBLE) / contrast_cohort_rows",
        "service_signature_share_in_contrast_cohort": "cast(service_signature_rows_in_contrast_cohort AS DOUBLE) / contrast_cohort_rows",
    },
    {
        "is_rare_bundle_archetype_in_contrast_cohort": "CASE WHEN bundle_archetype_share_in_contrast_cohort <= 0.15 THEN 1 ELSE 0 END",
        "is_rare_service_signature_in_contrast_cohort": "CASE WHEN service_signature_share_in_contrast_cohort <= 0.10 THEN 1 ELSE 0 END",
    },
]
_H = ["id", *[c for s in _H_STAGES[-3:] for c in s]]
_H_INT = [c for c in _H if c == "id" or c.endswith("_rows") or "_rows_in_" in c or c.startswith(("is_", "contrast_used"))]
register("block_h", lambda spark, d: rounded(B.block_h(accounts(spark, d)), _H), f"SELECT {_select(_H, [c for c in _H if c not in _H_INT])} FROM ({duck_stages(_H_STAGES)})")

_V_STAGES = [
    *B.BASES["V"],
    _window_stats(["_raw", "monthly_per_active_service", "paid_services_count"], [], ["_raw"]),
    {
        "value_cohort_rows": "d_rows", "value_low_support_cohort": "CASE WHEN d_rows >= 75 THEN 0 ELSE 1 END", "monthly_minus_value_cohort_median": f"_mc - ({_use('med__raw')})", "monthly_over_value_cohort_median": f"_mc / greatest({_use('med__raw')}, 1)",
        "monthly_rank_in_value_cohort": _use("rank__raw"), "monthly_per_active_service_minus_cohort": f"monthly_per_active_service - ({_use('med_monthly_per_active_service')})", "paid_services_minus_cohort": f"paid_services_count - ({_use('med_paid_services_count')})",
    },
]
_V = ["id", *[c for s in B.BASES["V"] for c in s if not c.startswith("_")], *_V_STAGES[-1]]
_V_DOUBLE = [*DOUBLES, "monthly_minus_value_cohort_median", "monthly_over_value_cohort_median", "monthly_rank_in_value_cohort", "monthly_per_active_service_minus_cohort", "paid_services_minus_cohort"]
register("block_v", lambda spark, d: rounded(B.block_v(accounts(spark, d)), _V), f"SELECT {_select(_V, _V_DOUBLE)} FROM ({duck_stages(_V_STAGES)})")

_F_RANKED = [c for c, p in B.SURFACE if p not in ("support", "paid")]
_F_KEYS = ["ec_surface_is_family", "ec_surface_is_paperless_family", "ec_surface_tenure_bin_fine", "ec_surface_segment"]
_F_STATS = {f"ec_surface_{p}_minus_median": (f"{c} - ({_use(f'med_{c}')})", 0) for c, p in B.SURFACE} | {f"ec_surface_{p}_rank": (_use(f"rank_{c}"), 0.5) for c, p in B.SURFACE if c in _F_RANKED}
_F_STATS |= {"ec_surface_monthly_over_median": (f"_mc / greatest({_use('med__mc')}, 1)", 1), "ec_surface_pressure_x_support_deficit": (f"_mc / greatest({_use('med__mc')}, 1) * support_deficit_count", 0)}
_F_INTS = {"ec_surface_rows": _use("rows"), "ec_surface_used_fallback": "CASE WHEN d_rows >= 75 THEN 0 ELSE 1 END"}
_F_ALL = ["id", *_F_KEYS, *_F_STATS, *_F_INTS]
_f_inner = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in _window_stats([c for c, _ in B.SURFACE], [], _F_RANKED).items())} FROM ({duck_stages(B.BASES['F'])}) WHERE _macro = 1"
register(
    "block_f",
    lambda spark, d: rounded(B.block_f(accounts(spark, d)), _F_ALL),
    f"+base AS ({duck_stages(B.BASES['F'])}), fam AS ({_f_inner}) SELECT base.id, cast(base.ec_surface_is_family AS BIGINT) AS ec_surface_is_family, cast(base.ec_surface_is_paperless_family AS BIGINT) AS ec_surface_is_paperless_family, base.ec_surface_tenure_bin_fine, base.ec_surface_segment, "
    + ", ".join(f"round(coalesce(s.{c}, {d}) + 0.000000001, 6) AS {c}" for c, (_, d) in _F_STATS.items())
    + ", "
    + ", ".join(f"cast(coalesce(s.{c}, 0) AS BIGINT) AS {c}" for c in _F_INTS)
    + f" FROM base LEFT JOIN (SELECT id, {', '.join(f'{e} AS {c}' for c, (e, _) in _F_STATS.items())}, {', '.join(f'{e} AS {c}' for c, e in _F_INTS.items())} FROM fam) s USING (id)",
)


def _g(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d)
    out = S.CoverageBackoff().fit(a.filter("split = 'train'")).apply(a.filter("split = 'test'"))
    return rounded(out, _G)


_G_TEXT = ["segment3_family", "segment5_family", "segment3_support_bucket", "segment5_support_bucket", "segment5_backoff_family"]
_G_INT = ["segment3_train_rows", "segment5_train_rows", "segment5_seen_in_fit", "segment5_low_support_in_fit", "segment5_backoff_to_segment3"]
_G = ["id", *_G_TEXT, *_G_INT, "segment5_share_within_segment3"]
_S3, _S5 = K.segment3(), K.segment5()
register(
    "block_g_fit_apply",
    _g,
    f"+k AS (SELECT *, {_S3} AS s3, {_S5} AS s5 FROM accounts), c3 AS (SELECT s3, count(*) AS n3 FROM k WHERE split = 'train' GROUP BY 1), c5 AS (SELECT s5, count(*) AS n5 FROM k WHERE split = 'train' GROUP BY 1), "
    "j AS (SELECT k.id, k.s3, k.s5, coalesce(n3, 0) AS n3, coalesce(n5, 0) AS n5 FROM k LEFT JOIN c3 USING (s3) LEFT JOIN c5 USING (s5) WHERE split = 'test') "
    f"SELECT id, s3 AS segment3_family, s5 AS segment5_family, {K.support_bucket('n3')} AS segment3_support_bucket, {K.support_bucket('n5')} AS segment5_support_bucket, CASE WHEN n5 >= 75 THEN s5 ELSE 'BACKOFF__' || s3 END AS segment5_backoff_family, "
    "n3 AS segment3_train_rows, n5 AS segment5_train_rows, cast(n5 > 0 AS BIGINT) AS segment5_seen_in_fit, cast(n5 < 75 AS BIGINT) AS segment5_low_support_in_fit, cast(n5 < 75 AS BIGINT) AS segment5_backoff_to_segment3, round(n5 / greatest(n3, 1) + 0.000000001, 6) AS segment5_share_within_segment3 FROM j",
)

_T_TEXT = ["ec_surface_fit_level", "ec_surface_fit_segment", "ec_surface_fit_support_bucket"]
_T_INT = ["ec_surface_fit_is_family", "ec_surface_fit_is_paperless_family", "ec_surface_fit_rows", "ec_surface_fit_used_coarse", "ec_surface_fit_used_paperless"]
_T_STATS = [f"ec_surface_fit_{p}_minus_train_median" for _, p in B.SURFACE] + [f"ec_surface_fit_{p}_rank_fit" for _, p in B.SURFACE if p not in ("support", "paid")] + ["ec_surface_fit_monthly_over_train_median", "ec_surface_fit_pressure_x_support_deficit"]
_T = ["id", *_T_TEXT, *_T_INT, *_T_STATS]


def _t(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d)
    return rounded(S.SurfaceProfiles().fit(a.filter("split = 'train'")).apply(a.filter("split = 'test'")), _T)


def _duck_t() -> str:
    measures = ", ".join(f"median({c}) AS med_{p}, list_sort(list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges_{p}" for c, p in B.SURFACE)
    levels = " UNION ALL ".join(f"SELECT '{x}' AS level, _{x}_key AS key, count(*) AS rows, {measures} FROM fam WHERE split = 'train' GROUP BY 2" for x in S.LEVELS)
    pick = lambda c: f"CASE WHEN level = 'detail' THEN p1.{c} WHEN level = 'coarse' THEN p2.{c} ELSE p3.{c} END"
    picked = ", ".join(f"{pick(f'{k}_{p}')} AS {k}_{p}" for _, p in B.SURFACE for k in ("med", "edges"))
    stats = ", ".join(f"round(CASE WHEN fitted THEN {c} - med_{p} ELSE 0 END + 0.000000001, 6) AS ec_surface_fit_{p}_minus_train_median" for c, p in B.SURFACE)
    ranks = ", ".join(f"round(CASE WHEN fitted THEN (len(list_filter(edges_{p}, lambda e: e <= {c})) + 0.5) / (len(edges_{p}) + 1) ELSE 0.5 END + 0.000000001, 6) AS ec_surface_fit_{p}_rank_fit" for c, p in B.SURFACE if p not in ("support", "paid"))
    return f"""+base AS ({duck_stages(S.SURFACE_STAGES)}), fam AS (SELECT * FROM base WHERE _macro = 1), prof AS ({levels}),
l AS (SELECT base.*, CASE WHEN p1.rows >= 75 THEN 'detail' WHEN p2.rows >= 75 THEN 'coarse' ELSE 'paperless' END AS level, p1, p2, p3 FROM base LEFT JOIN prof p1 ON p1.level = 'detail' AND p1.key = _detail_key LEFT JOIN prof p2 ON p2.level = 'coarse' AND p2.key = _coarse_key LEFT JOIN prof p3 ON p3.level = 'paperless' AND p3.key = _paperless_key WHERE split = 'test'),
m AS (SELECT *, {pick('rows')} AS rows, {picked} FROM l), n AS (SELECT *, _macro = 1 AND rows IS NOT NULL AS fitted FROM m)
SELECT id, CASE WHEN fitted THEN level ELSE 'other' END AS ec_surface_fit_level, CASE WHEN fitted THEN level || '__' || CASE level WHEN 'detail' THEN _detail_key WHEN 'coarse' THEN _coarse_key ELSE _paperless_key END ELSE 'other' END AS ec_surface_fit_segment,
{K.support_bucket('(CASE WHEN fitted THEN rows ELSE 0 END)')} AS ec_surface_fit_support_bucket, cast(_macro AS BIGINT) AS ec_surface_fit_is_family, cast(_macro = 1 AND _paper = 'Yes' AS BIGINT) AS ec_surface_fit_is_paperless_family,
CASE WHEN fitted THEN rows ELSE 0 END AS ec_surface_fit_rows, cast(fitted AND level = 'coarse' AS BIGINT) AS ec_surface_fit_used_coarse, cast(fitted AND level = 'paperless' AS BIGINT) AS ec_surface_fit_used_paperless,
{stats}, {ranks}, round(CASE WHEN fitted THEN _mc / greatest(med_monthly, 1) ELSE 1 END + 0.000000001, 6) AS ec_surface_fit_monthly_over_train_median, round(CASE WHEN fitted THEN _mc / greatest(med_monthly, 1) * support_deficit_count ELSE 0 END + 0.000000001, 6) AS ec_surface_fit_pressure_x_support_deficit FROM n"""


register("block_t_fit_apply", _t, _duck_t())


def _priors(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d)
    return P.TargetPriors().fit(a.filter("split = 'train'")).apply(a.filter("split = 'test'"))


_SPEC_KEYS = {s.name: K.key(*s.columns) for s in P.DEFAULT_SPECS}
_PRIOR_INT = ["id", *[f"{k}_{s.name}" for s in P.DEFAULT_SPECS for k in ("support", "is_low_support")], "prior_hier_support", "prior_hier_level", "prior_hier_is_global"]
_PRIOR_DOUBLE = ["prior_global", "prior_global_logit", *[f"{k}_{s.name}" for s in P.DEFAULT_SPECS for k in ("prior", "prior_logit")], "prior_hier", "prior_hier_logit"]
_DEV = [f"cohort_{k}_{c.lstrip('_')}" for c in P.NUMERIC for k in ("mean", "delta", "rel")]


def _duck_priors(columns: str) -> str:
    means = ", ".join(f"avg({K.number(c)}) AS _g_{c}" for c in P.NUMERIC)
    sums = lambda s: ", ".join(f"sum(coalesce({K.number(c)}, _g_{c})) AS _{s}_{c}" for c in P.NUMERIC)
    tables = ", ".join(f"t_{s.name} AS (SELECT {_SPEC_KEYS[s.name]} AS _key_{s.name}, sum(target) AS _sum_{s.name}, count(target) AS _n_{s.name}, {sums(s.name)} FROM base, tot WHERE split = 'train' GROUP BY 1)" for s in P.DEFAULT_SPECS)
    joins = " ".join(f"LEFT JOIN t_{s.name} ON t_{s.name}._key_{s.name} = {_SPEC_KEYS[s.name]}" for s in P.DEFAULT_SPECS)
    each = ", ".join(f"coalesce(_n_{s.name}, 0) AS support_{s.name}, (coalesce(_sum_{s.name}, 0) + {s.alpha} * _g) / (coalesce(_n_{s.name}, 0) + {s.alpha}) AS prior_{s.name}" for s in P.DEFAULT_SPECS)
    hier = lambda value, default: "CASE " + " ".join(f"WHEN support_{s.name} >= {s.min_support} THEN {value(i, s)}" for i, s in reversed(list(enumerate(P.DEFAULT_SPECS)))) + f" ELSE {default} END"
    devs = ", ".join(f"{hier(lambda i, s, c=c: f'(coalesce(_{s.name}_{c}, 0) + {s.alpha} * _g_{c}) / (coalesce(_n_{s.name}, 0) + {s.alpha})', f'_g_{c}')} AS cohort_mean_{c.lstrip('_')}, coalesce({K.number(c)}, _g_{c}) AS own_{c.lstrip('_')}" for c in P.NUMERIC)
    last = ", ".join(f"own_{n} - cohort_mean_{n} AS cohort_delta_{n}, (own_{n} - cohort_mean_{n}) / (abs(cohort_mean_{n}) + 1) AS cohort_rel_{n}" for n in (c.lstrip("_") for c in P.NUMERIC))
    lows = ", ".join(f"cast(support_{s.name} < {s.min_support} AS BIGINT) AS is_low_support_{s.name}, {K.logit(f'prior_{s.name}')} AS prior_logit_{s.name}" for s in P.DEFAULT_SPECS)
    return f"""+base AS ({duck_stages(P.FRAME)}), tot AS (SELECT avg(target) AS _g, {means} FROM base WHERE split = 'train'), {tables},
j AS (SELECT base.*, tot.*, {each}, {', '.join(f'_n_{s.name}, ' + ', '.join(f'_{s.name}_{c}' for c in P.NUMERIC) for s in P.DEFAULT_SPECS)} FROM base CROSS JOIN tot {joins} WHERE split = 'test'),
h AS (SELECT *, {hier(lambda i, s: f'prior_{s.name}', '_g')} AS prior_hier, {hier(lambda i, s: f'support_{s.name}', '0')} AS prior_hier_support, {hier(lambda i, s: f"'{s.name}'", "'global'")} AS prior_hier_source, {hier(lambda i, s: str(i + 1), '0')} AS prior_hier_level, {devs} FROM j),
z AS (SELECT *, _g AS prior_global, {K.logit('_g')} AS prior_global_logit, {K.logit('prior_hier')} AS prior_hier_logit, cast(prior_hier_source = 'global' AS BIGINT) AS prior_hier_is_global, {lows}, {last} FROM h)
SELECT {columns} FROM z"""


register("prior_transform", lambda spark, d: rounded(_priors(spark, d), [*_PRIOR_INT, *_PRIOR_DOUBLE, "prior_hier_source"]), _duck_priors(_select([*_PRIOR_INT, *_PRIOR_DOUBLE, "prior_hier_source"], _PRIOR_DOUBLE, ["prior_hier_source"])))
register("prior_deviation", lambda spark, d: rounded(_priors(spark, d), ["id", *_DEV]), _duck_priors(_select(["id", *_DEV], _DEV)))


def _prior_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = P.TargetPriors().fit(accounts(spark, d).filter("split = 'train'"))
    parts = [t.select(F.lit(s.name).alias("spec"), F.col(f"_key_{s.name}").alias("key"), F.col(f"_sum_{s.name}").cast("long").alias("target_sum"), F.col(f"_n_{s.name}").cast("long").alias("n"), F.round(f"_{s.name}_MonthlyCharges", 4).alias("monthly_sum")) for s in fitted.specs for t in [fitted.tables[s.name]]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("prior_fit", _prior_fit, f"+base AS ({duck_stages(P.FRAME)}) " + " UNION ALL ".join(f"SELECT '{n}' AS spec, {k} AS key, cast(sum(target) AS BIGINT) AS target_sum, count(target) AS n, round(sum(MonthlyCharges), 4) AS monthly_sum FROM base WHERE split = 'train' GROUP BY 2" for n, k in _SPEC_KEYS.items()))

_TE = ("Contract", "InternetService", "PaymentMethod")


def _te(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d).select("id", "target", "split", "tenure", *_TE).withColumn("fold", F.pmod(F.col("id") * 7 + F.col("tenure"), F.lit(4)).cast("int"))
    out = P.fold_safe_encoding(a.filter("split = 'train'"), _TE, external=a.filter("split = 'test'"))
    return rounded(out, ["id", "fold", *[f"{k}{c}" for c in _TE for k in ("TE_", "TE_COUNT_")]])


register(
    "fold_safe_te",
    _te,
    "+f AS (SELECT *, cast((id * 7 + tenure) % 4 AS INTEGER) AS fold FROM accounts), tr AS (SELECT * FROM f WHERE split = 'train'), u AS (SELECT target, fold FROM tr UNION ALL SELECT target, -1 FROM f WHERE split = 'test'), "
    "p AS (SELECT k.fold, avg(u.target) AS p FROM (SELECT DISTINCT fold FROM tr) k JOIN u ON u.fold <> k.fold GROUP BY 1), "
    + ", ".join(f"g_{c} AS (SELECT {c}, fold, sum(target) AS s, count(*) AS n FROM (SELECT {c}, fold, target FROM tr UNION ALL SELECT {c}, -1, target FROM f WHERE split = 'test') GROUP BY 1, 2)" for c in _TE)
    + ", " + ", ".join(f"c_{c} AS (SELECT a.{c}, k.fold, coalesce(sum(a.s), 0) AS s, coalesce(sum(a.n), 0) AS n FROM g_{c} a JOIN (SELECT DISTINCT fold FROM tr) k ON a.fold <> k.fold GROUP BY 1, 2)" for c in _TE)
    + " SELECT tr.id, cast(tr.fold AS BIGINT) AS fold, "
    + ", ".join(f"round(CASE WHEN coalesce(c_{c}.n, 0) > 0 THEN (c_{c}.s + p.p * 10) / (c_{c}.n + 10) ELSE p.p END + 0.000000001, 6) AS TE_{c}, round(ln(1 + coalesce(c_{c}.n, 0)) + 0.000000001, 6) AS TE_COUNT_{c}" for c in _TE)
    + " FROM tr JOIN p USING (fold) " + " ".join(f"LEFT JOIN c_{c} ON c_{c}.{c} = tr.{c} AND c_{c}.fold = tr.fold" for c in _TE),
)
_NG = K.ngrams(K.NGRAM_COLUMNS, trigrams=True)
register(
    "ngram_te",
    lambda spark, d: P.smoothed_means(accounts(spark, d).filter("split = 'train'"), _NG).select("name", "value", F.col("rows").cast("long").alias("n"), F.round("smooth", 6).alias("smooth"), F.round("log_count", 6).alias("log_count")),
    "+tr AS (SELECT * FROM accounts WHERE split = 'train'), p AS (SELECT avg(target) AS p FROM tr) " + " UNION ALL ".join(f"SELECT '{n}' AS name, {e} AS value, count(*) AS n, round((sum(target) + any_value(p) * 10) / (count(*) + 10), 6) AS smooth, round(ln(1 + count(*)), 6) AS log_count FROM tr, p GROUP BY 2" for n, e in _NG.items()),
)
_LATE = "CASE WHEN split = 'test' AND tenure > 60 THEN 'Late' ELSE InternetService END"  # a value that no training row has
register(
    "full_te_apply",
    lambda spark, d: (lambda a: rounded(P.full_encoding(a.filter("split = 'test'"), a.filter("split = 'train'"), "InternetService"), ["id", "TE_InternetService", "TE_COUNT_InternetService"]))(accounts(spark, d).withColumn("InternetService", F.expr(_LATE))),
    f"+k AS (SELECT * REPLACE ({_LATE} AS InternetService) FROM accounts), tr AS (SELECT * FROM k WHERE split = 'train'), p AS (SELECT avg(target) AS p FROM tr), g AS (SELECT InternetService, sum(target) AS s, count(*) AS n FROM tr GROUP BY 1) SELECT id, round(CASE WHEN n IS NULL THEN p ELSE (s + p * 10) / (n + 10) END + 0.000000001, 6) AS TE_InternetService, round(ln(1 + coalesce(n, 0)) + 0.000000001, 6) AS TE_COUNT_InternetService FROM k CROSS JOIN p LEFT JOIN g USING (InternetService) WHERE split = 'test'",
)
register(
    "median_fill",
    lambda spark, d: accounts(spark, d).crossJoin(F.broadcast(quantiles(accounts(spark, d).filter("split = 'train'"), [], "TotalCharges", {"m": 0.5}))).select("id", F.round(F.coalesce("TotalCharges", "m"), 6).alias("total_filled")),
    "SELECT id, round(coalesce(TotalCharges, (SELECT median(TotalCharges) FROM accounts WHERE split = 'train')), 6) AS total_filled FROM accounts",
)
register(
    "standardise",
    lambda spark, d: (lambda a: a.crossJoin(F.broadcast(a.agg(F.avg("MonthlyCharges").alias("m"), F.stddev_pop("MonthlyCharges").alias("s")))).select("id", F.round((F.col("MonthlyCharges") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 6).alias("z")))(accounts(spark, d)),
    "SELECT id, round((MonthlyCharges - (SELECT avg(MonthlyCharges) FROM accounts)) / (SELECT CASE WHEN stddev_pop(MonthlyCharges) = 0 THEN 1 ELSE stddev_pop(MonthlyCharges) END FROM accounts), 6) AS z FROM accounts",
)
register(
    "category_codes",
    lambda spark, d: (lambda a: a.join(a.select("PaymentMethod").distinct().withColumn("code", F.row_number().over(Window.orderBy("PaymentMethod")).cast("long")), "PaymentMethod").select("id", "code"))(accounts(spark, d)),
    "SELECT id, dense_rank() OVER (ORDER BY PaymentMethod) AS code FROM accounts",
)
register("accounts_scan", lambda spark, d: accounts(spark, d).select("id", "PaymentMethod", "Contract", "InternetService", "PaperlessBilling", "tenure", F.round("MonthlyCharges", 6).alias("MonthlyCharges"), F.round("TotalCharges", 6).alias("TotalCharges"), *B.SERVICES, "PhoneService", "MultipleLines", "gender", "Partner", "Dependents", "SeniorCitizen", "Churn", "target", "split"),
         "SELECT id, PaymentMethod, Contract, InternetService, PaperlessBilling, tenure, round(MonthlyCharges, 6) AS MonthlyCharges, round(TotalCharges, 6) AS TotalCharges, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies, PhoneService, MultipleLines, gender, Partner, Dependents, SeniorCitizen, Churn, target, split FROM accounts")
register("family_frame", lambda spark, d: staged(accounts(spark, d), [{"tenure_bin": K.tenure_bin(), "segment3": _S3, "segment5": _S5}]).select("id", "segment3", "segment5", "tenure_bin"), f"SELECT id, {_S3} AS segment3, {_S5} AS segment5, {K.tenure_bin()} AS tenure_bin FROM accounts")
register("mask_presets", lambda spark, d: accounts(spark, d).select("id", *[F.expr(e).cast("long").alias(n) for n, e in PRESETS.items()]), f"SELECT id, {', '.join(f'cast({e} AS BIGINT) AS {n}' for n, e in PRESETS.items())} FROM accounts")
register("rank_in_cohort", lambda spark, d: average_rank(accounts(spark, d), ["Contract"], "TotalCharges", "r").select("id", F.round("r", 6).alias("r")), f"SELECT id, round(CASE WHEN TotalCharges IS NOT NULL THEN {_AVG_RANK.format(k='Contract', c='TotalCharges')} END, 6) AS r FROM accounts")
register("logits", lambda spark, d: accounts(spark, d).select("id", F.round(F.expr(K.logit("pred_cb")), 6).alias("logit")), f"SELECT id, round({K.logit('pred_cb')}, 6) AS logit FROM accounts")
