"""Feature blocks. Blocks of projections are SQL expressions in stages; cohort blocks add statistics of a cohort by
joins of small aggregates, with a coarser cohort where the detailed one has fewer than 75 rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.metrics import cumulated
from ..schema import ENTERTAINMENT, SERVICES, SUPPORT, Stages, require_columns, staged, text

MIN_ROWS = 75
# Months and friction of contracts and payments, and the bounds of outliers (first and last percentile).
MONTHS = "CASE Contract WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 1 END"
FRICTION = "CASE PaymentMethod WHEN 'Electronic check' THEN 2 WHEN 'Mailed check' THEN 3 WHEN 'Credit card (automatic)' THEN 0 WHEN 'Bank transfer (automatic)' THEN 0 ELSE 1 END"
_AUTO = f"CASE WHEN lower({text('PaymentMethod')}) LIKE '%automatic%' THEN 1 ELSE 0 END"
_INTERNET = f"CASE WHEN lower({text('InternetService')}) <> 'no' THEN 1 ELSE 0 END"
_T0, _T1 = K.filled("tenure"), f"coalesce(greatest({K.number('tenure')}, 1e0), 1e0)"
_MC, _TC = K.filled("MonthlyCharges"), K.filled("TotalCharges")
_COUNTS = {"_support": K.count_yes(SUPPORT), "_ent": K.count_yes(ENTERTAINMENT), "_internet": _INTERNET, "_paid": K.services_paid()}
_ARCHETYPE = (
    "CASE WHEN _internet = 0 THEN 'no_internet' WHEN _support = 0 AND _ent = 0 THEN 'connectivity_only' WHEN _support = 0 THEN 'streaming_only' "
    "WHEN _ent = 0 THEN 'support_only' WHEN _support >= _ent + 2 THEN 'support_heavy' WHEN _ent >= _support + 1 THEN 'entertainment_heavy' ELSE 'balanced' END"
)
_SHARE = "cast(_support AS DOUBLE) / greatest(_support + _ent, 1)"
MACRO = "(coalesce(PaymentMethod, '') = 'Electronic check' AND coalesce(Contract, '') = 'Month-to-month' AND coalesce(InternetService, '') = 'Fiber optic')"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def outlier_stages(bounds: dict[str, tuple[float, float]], clip: bool) -> Stages:
    """Flags of values outside the bounds and their number; or the values within the bounds and their sum."""
    values = {
        "_MonthlyCharges": _MC, "_TotalCharges": _TC, "_monthly_per_tenure": f"{_MC} / {_T1}", "_total_per_tenure": f"{_TC} / {_T1}",
        "_total_minus_monthly_tenure": f"{_TC} - {_MC} * {_T1}",
    }
    if clip:
        out = {f"pclip_{c}": f"least(greatest(_{c}, cast({a} AS DOUBLE)), cast({z} AS DOUBLE))" for c, (a, z) in bounds.items()}
        return [values, out, {"pclip_sum": " + ".join(out)}]
    out = {f"is_outlier_{c}": _flag(f"_{c} < {a} OR _{c} > {z}") for c, (a, z) in bounds.items()}
    return [values, out, {"outlier_flag_count": " + ".join(out)}]


#: Default bounds of outliers.
BOUNDS = {
    "MonthlyCharges": (19.3, 115.5),
    "TotalCharges": (33.9, 8240.85),
    "monthly_per_tenure": (0.278472, 80.15),
    "total_per_tenure": (17.983333, 116.734722),
    "total_minus_monthly_tenure": (-911.064, 789.9035),
}

VALUE_PRIMITIVES: Stages = [
    {**_COUNTS, "_t1": _T1, "_mc": _MC, "_tc": _TC},
    {
        "support_services_count": "_support", "entertainment_services_count": "_ent", "paid_services_count": "_paid",
        "support_deficit_count": "CASE WHEN _internet = 1 THEN 4 - _support ELSE 0 END", "monthly_per_active_service": "_mc / greatest(_paid, 1)",
        "effective_monthly_charge": f"_tc / greatest({_T0}, 1e0)", "payment_friction_index": FRICTION,
    },
    {
        "current_vs_effective_monthly_delta": "_mc - effective_monthly_charge",
        "current_vs_effective_monthly_ratio": "_mc / greatest(effective_monthly_charge, 1e0)",
    },
]

PROJECTIONS: dict[str, Stages] = {
    "A": [
        {"tenure_bin": K.tenure_bin(), "is_new_customer": _flag(f"{K.number('tenure')} <= 6"), "monthly_per_tenure": f"{_MC} / {_T1}"},
        {"tenure_x_contract": K.key("tenure_bin", "Contract")},
    ],
    "B": [
        {
            "is_auto_payment": _AUTO, "is_manual_payment": f"1 - ({_AUTO})", "is_electronic_check": _flag(f"lower({text('PaymentMethod')}) = 'electronic check'"),
            "payment_x_contract": K.key("PaymentMethod", "Contract"), "payment_x_internet": K.key("PaymentMethod", "InternetService"),
        }
    ],
    "C": [
        {"addons_active_count": K.count_yes(SERVICES), "has_internet": _INTERNET, "has_phone": K.yes("PhoneService"), "techsupport_x_onlinesecurity": K.key("TechSupport", "OnlineSecurity")},
        {"is_bundle_heavy": _flag("addons_active_count >= 3")},
    ],
    "M": [{"contract_commitment_ordinal": MONTHS, "is_manual_payment": f"1 - ({_AUTO})", "payment_friction_index": FRICTION}],
    "VP": VALUE_PRIMITIVES,
    "R": [
        {"contract_months": MONTHS, "_t": f"cast({_T0} AS BIGINT)"},
        {"has_contract_cycle": _flag("contract_months > 1"), "tenure_mod_12": "((_t % 12) + 12) % 12", "tenure_mod_24": "((_t % 24) + 24) % 24", "contract_cycle_position": "((_t % contract_months) + contract_months) % contract_months"},
        {
            "months_to_12_boundary": "(12 - tenure_mod_12) % 12", "months_to_24_boundary": "(24 - tenure_mod_24) % 24", "annual_cycle_progress": "cast(tenure_mod_12 AS DOUBLE) / 12", "two_year_cycle_progress": "cast(tenure_mod_24 AS DOUBLE) / 24",
            "months_to_contract_boundary": "CASE WHEN contract_months > 1 THEN (contract_months - contract_cycle_position) % contract_months ELSE 0 END",
            "contract_cycle_progress": "CASE WHEN contract_months > 1 THEN cast(contract_cycle_position AS DOUBLE) / contract_months ELSE 0e0 END",
        },
        {
            **{f"near_contract_boundary_{n}": _flag(f"has_contract_cycle = 1 AND months_to_contract_boundary <= {n}") for n in (1, 2, 3)},
            "annual_boundary_bin": K.bins("months_to_12_boundary", (0, 2, 5, 11), ("now", "near_2", "near_5", "far"), -1),
            "contract_boundary_bin": f"CASE WHEN has_contract_cycle = 1 THEN {K.bins('months_to_contract_boundary', (0, 2, 5, 24), ('now', 'near_2', 'near_5', 'far'), -1)} ELSE 'no_cycle' END",
        },
        {"contract_x_boundary_bin": K.key("Contract", "contract_boundary_bin")},
    ],
    "S": [
        {**_COUNTS, "_manual": f"1 - ({_AUTO})", "support_signature": K.first_letters(SUPPORT), "streaming_signature": K.first_letters(ENTERTAINMENT)},
        {
            "support_minus_entertainment": "_support - _ent", "support_share_of_addons": _SHARE, "is_support_gap_high": _flag("_internet = 1 AND _support <= 1"),
            "is_securityless_fiber": _flag("coalesce(InternetService, '') = 'Fiber optic' AND _support = 0"), "is_manual_basic_service": _flag("_manual = 1 AND _paid <= 1"),
            "is_manual_streaming_light_support": _flag("_manual = 1 AND _ent >= 1 AND _support <= 1 AND _internet = 1"), "bundle_archetype": _ARCHETYPE,
            "_support_bin": K.bins("_support", (0, 1, 2, 4), ("0", "1", "2", "3p")), "_ent_bin": K.bins("_ent", (0, 1, 2), ("0", "1", "2")),
        },
        {
            "service_topology": K.key("InternetService", "bundle_archetype", "Contract", "MultipleLines"),
            "service_signature": K.key("InternetService", "_support_bin", "_ent_bin", "support_signature", "streaming_signature"),
        },
    ],
    "O": outlier_stages(BOUNDS, clip=False),
    "P": outlier_stages(BOUNDS, clip=True),
}
#: What the cohort blocks start from.
BASES: dict[str, Stages] = {
    "H": [
        {**_COUNTS, "_bin": K.tenure_bin(_T0), "_sig": f"{K.first_letters(SUPPORT)} || '__' || {K.first_letters(ENTERTAINMENT)}"},
        {
            "_detail": f"{K.key(*K.SEGMENT5[:4])} || '__' || _bin", "_fallback": f"{K.key('Contract', 'InternetService')} || '__' || _bin", "_share": _SHARE, "_mix": "_support - _ent",
            "_bundle": _ARCHETYPE, "_signature": f"{text('InternetService')} || '__' || _sig || '__' || {text('MultipleLines')}",
        },
    ],
    "V": [
        *VALUE_PRIMITIVES,
        {
            "is_support_light": _flag("_internet = 1 AND _support <= 1"), "is_streaming_heavy_support_light": _flag("_internet = 1 AND _ent >= 1 AND _support = 0"), "_raw": K.number("MonthlyCharges"), "_bin": K.tenure_bin(_T0),
        },
        {"_detail": f"{K.key(*K.SEGMENT5[:4])} || '__' || _bin", "_fallback": f"{K.key('Contract', 'InternetService')} || '__' || _bin"},
    ],
    "F": [
        *VALUE_PRIMITIVES,
        {"_macro": _flag(MACRO), "_fine": K.fine_tenure_bin(_T0), "_coarse": K.tenure_bin(_T0)},
        {
            "ec_surface_is_family": "_macro", "ec_surface_is_paperless_family": _flag("_macro = 1 AND coalesce(PaperlessBilling, '') = 'Yes'"), "ec_surface_tenure_bin_fine": "CASE WHEN _macro = 1 THEN _fine ELSE 'other' END",
            "ec_surface_segment": f"CASE WHEN _macro = 1 THEN {text('PaperlessBilling')} || '__' || _fine ELSE 'other' END",
            "_detail": f"{text('PaperlessBilling')} || '__' || _fine", "_fallback": f"{text('PaperlessBilling')} || '__' || _coarse",
        },
    ],
}
#: Columns, outputs and names of a surface: (column, prefix).
SURFACE = (("_mc", "monthly"), ("_tc", "total"), ("monthly_per_active_service", "mpas"), ("support_services_count", "support"), ("paid_services_count", "paid"), ("current_vs_effective_monthly_delta", "delta"))

# Other names of the blocks, and the block that each stands for.
ALIASES = {
    "OUTLIER": "O",
    "OUTLIERS": "O",
    "OUTLIER_FLAGS": "O",
    "FLAGS": "O",
    "PCLIP": "P",
    "CLIP": "P",
    "CLIPPING": "P",
    "PERCENTILE_CLIP": "P",
    "RENEWAL": "R",
    "LIFECYCLE": "R",
    "CYCLE": "R",
    "COVERAGE": "G",
    "BACKOFF": "G",
    "SUPPORT": "G",
    "FAMILY": "G",
    "SURFACE": "F",
    "FOCUS": "F",
    "EC_SURFACE": "F",
    "SURFACE_FIT": "T",
    "TRAIN_SURFACE": "T",
    "EC_SURFACE_FIT": "T",
    "HARD": "H",
    "CONTRAST": "H",
    "COHORT": "H",
    "COHORT_CONTRAST": "H",
    "SERVICE": "S",
    "SERVICES": "S",
    "BUNDLE": "S",
    "TOPOLOGY": "S",
    "VALUE": "V",
    "PRESSURE": "V",
    "FRICTION": "V",
}
STATEFUL = ("G", "T")


def normalise(blocks: str | Sequence[str] | None) -> tuple[str, ...]:
    """Names in the order asked for, each once; unknown ones raise."""
    out: list[str] = []
    for b in blocks.split(",") if isinstance(blocks, str) else blocks or ():
        b = ALIASES.get(b.strip().upper(), b.strip().upper())
        if b and b not in (*PROJECTIONS, *BASES, *STATEFUL):
            raise ValueError(f"Unknown feature block {b!r}")
        if b and b not in out:
            out.append(b)
    return tuple(out)


def cohort_records(source: DataFrame, numbers: Sequence[str], texts: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What cohorts at both levels ('d' by _detail, 'f' by _fallback) hold, from one pass over the rows: their wide record
    (level, key, rows, med_<c> and avg_<c> of each number), the ranks (level, key, column, x, rank) of distinct numbers and
    the counts (level, key, column, v, n) of distinct texts.

    The rows are reduced to counts of distinct values first, which are added up over ranges of values: no task holds all
    of a cohort's values. Nulls and NaN don't count."""
    cell = lambda c, x, v: F.struct(F.lit(c).alias("column"), x.cast("double").alias("x"), v.cast("string").alias("v"))
    none = F.lit(None)
    cells = [cell("", F.lit(0), none), *[cell(c, F.nanvl(F.col(c).cast("double"), none.cast("double")), none) for c in numbers], *[cell(c, none, F.col(c)) for c in texts]]
    keys = [F.struct(F.lit(level).alias("level"), F.col(key).alias("key")) for level, key in (("d", "_detail"), ("f", "_fallback"))]
    each = source.select(F.explode(F.array(*keys)).alias("k"), F.array(*cells).alias("cells")).select("k.*", F.explode("cells").alias("c")).select("level", "key", "c.*")
    counts = saved(each.filter("key IS NOT NULL AND (x IS NOT NULL OR v IS NOT NULL)").groupBy("level", "key", "column", "x", "v").agg(F.count("*").alias("n")))
    by = ["level", "key", "column"]
    held = counts.filter("x IS NOT NULL AND column <> ''").drop("v")
    totals = held.groupBy(*by).agg(F.sum("n").alias("_all"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("_avg"))
    ranked = saved(cumulated(held, by, "x", {"_below": "n"}).join(totals, by))
    place = (F.col("_all") - 1) / 2
    at = lambda place: (F.col("_below") <= place) & (place < F.col("_below") + F.col("n"))
    middle = lambda c: (F.max(F.when((F.col("column") == c) & at(F.floor(place)), F.col("x"))) + F.max(F.when((F.col("column") == c) & at(F.ceil(place)), F.col("x")))) / 2
    measures = [m for c in numbers for m in (middle(c).alias(f"med_{c}"), F.max(F.when(F.col("column") == c, F.col("_avg"))).alias(f"avg_{c}"))]
    wide = ranked.groupBy("level", "key").agg(*measures)
    sizes = counts.filter("column = ''").select("level", "key", F.col("n").alias("rows"))
    records = sizes.join(wide, ["level", "key"], "left")
    ranks = ranked.select(*by, "x", ((F.col("_below") + (F.col("n") + 1) / 2) / F.col("_all")).alias("rank"))
    return records, ranks, counts.filter("v IS NOT NULL").select(*by, "v", "n")


def _both(df: DataFrame, medians: Sequence[str], means: Sequence[str] = (), ranks: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """df with _d_rows, _f_rows and, of the detailed cohort if it has enough rows, else of the fallback: _med_<c>, _avg_<c>,
    _rank_<c> and, of texts, _n<c>."""
    numbers = list(dict.fromkeys([*medians, *means, *ranks]))
    records, places, counts = cohort_records(df, numbers, texts)
    for key, level in (("_detail", "d"), ("_fallback", "f")):
        record = F.struct(*[c for c in records.columns if c not in ("level", "key")]).alias(f"_{level}")
        df = df.join(records.filter(F.col("level") == level).select(F.col("key").alias(key), record), key)
        df = df.withColumn(f"_{level}_rows", F.col(f"_{level}.rows"))
    enough = F.col("_d_rows") >= MIN_ROWS
    backed = {f"_{n}": F.when(enough, F.col(f"_d.{n}")).otherwise(F.col(f"_f.{n}")) for n in [f"med_{c}" for c in medians] + [f"avg_{c}" for c in means]}
    df = df.withColumns({"_level": F.when(enough, "d").otherwise("f"), "_key": F.when(enough, F.col("_detail")).otherwise(F.col("_fallback")), **backed}).drop("_d", "_f")
    for c in ranks:
        own = places.filter(F.col("column") == c).select(F.col("level").alias("_level"), F.col("key").alias("_key"), F.col("x").alias(f"_x_{c}"), F.col("rank").alias(f"_rank_{c}"))
        df = df.withColumn(f"_x_{c}", F.col(c).cast("double")).join(own, ["_level", "_key", f"_x_{c}"], "left")
    for c in texts:
        own = counts.filter(F.col("column") == c).select(F.col("level").alias("_level"), F.col("key").alias("_key"), F.col("v").alias(c), F.col("n").alias(f"_n{c}"))
        df = df.join(own, ["_level", "_key", c])
    return df


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def block_h(df: DataFrame) -> DataFrame:
    """Contrasts with the cohort: counts less medians, shares less means, ranks, and how common the bundle is."""
    out = _both(staged(df, BASES["H"], True), ["_support", "_ent", "_paid"], ["_share", "_mix"], ["_support", "_ent", "_mix"], ["_bundle", "_signature"])
    out = out.withColumn("contrast_cohort_rows", F.when(F.col("_d_rows") >= MIN_ROWS, F.col("_d_rows")).otherwise(F.col("_f_rows")))
    return _clean(staged(out, [{
        "contrast_used_fallback_cohort": f"CASE WHEN _d_rows >= {MIN_ROWS} THEN 0 ELSE 1 END",
        "support_count_minus_contrast_cohort": "_support - _med__support", "entertainment_count_minus_contrast_cohort": "_ent - _med__ent", "paid_services_minus_contrast_cohort": "_paid - _med__paid",
        "support_share_minus_contrast_cohort": "_share - _avg__share", "service_mix_minus_contrast_cohort": "_mix - _avg__mix",
        "support_count_rank_in_contrast_cohort": "_rank__support", "entertainment_count_rank_in_contrast_cohort": "_rank__ent", "service_mix_rank_in_contrast_cohort": "_rank__mix",
        "bundle_archetype_rows_in_contrast_cohort": "_n_bundle", "bundle_archetype_share_in_contrast_cohort": "cast(_n_bundle AS DOUBLE) / contrast_cohort_rows",
        "service_signature_rows_in_contrast_cohort": "_n_signature", "service_signature_share_in_contrast_cohort": "cast(_n_signature AS DOUBLE) / contrast_cohort_rows",
    }, {
        "is_rare_bundle_archetype_in_contrast_cohort": _flag("bundle_archetype_share_in_contrast_cohort <= 0.15"),
        "is_rare_service_signature_in_contrast_cohort": _flag("service_signature_share_in_contrast_cohort <= 0.10"),
    }], True))


def block_v(df: DataFrame) -> DataFrame:
    """Value pressure: charges and services against the cohort. Medians and ranks skip missing charges; value_cohort_rows
    is always the detailed cohort's."""
    out = _both(staged(df, BASES["V"], True), ["_raw", "monthly_per_active_service", "paid_services_count"], (), ["_raw"])
    return _clean(staged(out, [{
        "value_cohort_rows": "_d_rows", "value_low_support_cohort": f"CASE WHEN _d_rows >= {MIN_ROWS} THEN 0 ELSE 1 END", "monthly_minus_value_cohort_median": "_mc - _med__raw",
        "monthly_over_value_cohort_median": "_mc / greatest(_med__raw, 1e0)", "monthly_rank_in_value_cohort": "_rank__raw",
        "monthly_per_active_service_minus_cohort": "monthly_per_active_service - _med_monthly_per_active_service", "paid_services_minus_cohort": "paid_services_count - _med_paid_services_count",
    }], True))


def block_f(df: DataFrame, id_column: str = "id") -> DataFrame:
    """The surface of the dominant family, by billing and fine tenure, else coarse tenure; defaults outside the family.
    The family is filtered before it is grouped, and its columns come back by a join on the id."""
    base = staged(df, BASES["F"], True)
    columns = [c for c, _ in SURFACE]
    family = _both(base.filter("_macro = 1").select(id_column, "_detail", "_fallback", "support_deficit_count", *columns), columns, (), [c for c in columns if c not in ("support_services_count", "paid_services_count")])
    stats = {f"ec_surface_{p}_minus_median": f"{c} - _med_{c}" for c, p in SURFACE}
    stats |= {f"ec_surface_{p}_rank": f"_rank_{c}" for c, p in SURFACE if p not in ("support", "paid")}
    family = staged(family, [{
        "ec_surface_rows": f"CASE WHEN _d_rows >= {MIN_ROWS} THEN _d_rows ELSE _f_rows END", "ec_surface_used_fallback": f"CASE WHEN _d_rows >= {MIN_ROWS} THEN 0 ELSE 1 END",
        "ec_surface_monthly_over_median": "_mc / greatest(_med__mc, 1e0)", **stats,
    }, {"ec_surface_pressure_x_support_deficit": "ec_surface_monthly_over_median * support_deficit_count"}], True)
    own = [c for c in family.columns if c.startswith("ec_surface_")]
    kept = df.columns + ["ec_surface_is_family", "ec_surface_is_paperless_family", "ec_surface_tenure_bin_fine", "ec_surface_segment"]
    default = lambda c: 1.0 if c.endswith("over_median") else 0.5 if c.endswith("_rank") else 0
    joined = base.select(*kept).join(family.select(id_column, *own), id_column, "left")
    return joined.select(*kept, *[F.coalesce(F.col(c), F.lit(default(c))).alias(c) for c in own])


def apply_blocks(df: DataFrame, blocks: str | Sequence[str], id_column: str = "id") -> DataFrame:
    """df with the columns of the blocks, in the order asked for. Blocks with a fitted state have their own operators."""
    for b in normalise(blocks):
        if b in STATEFUL:
            raise ValueError(f"Block {b} needs a state that is fitted on training rows")
        require_columns(df, ("tenure", "Contract", "PaymentMethod") if b in "ABMR" else (*K.SEGMENT3, "tenure", *SERVICES) if b in ("H", "S", "V", "F") else (), f"Block {b}")
        if b in PROJECTIONS:
            # columns of block M that are there already stay as they are
            stages = [{c: e for c, e in s.items() if b != "M" or c not in df.columns} for s in PROJECTIONS[b]]
            df = staged(df, [s for s in stages if s])
        else:
            df = {"H": block_h, "V": block_v}[b](df) if b != "F" else block_f(df, id_column)
    return df
