"""Masks of cohorts as predicates, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_T = "coalesce(try_cast(tenure AS DOUBLE), 0)"


def _mask(contract: str = "", internet: str = "", payment: str = "", paperless: str = "", tenure: str = "") -> str:
    """Conditions on the columns; texts are one value, values separated by |, or !value."""

    def one(column: str, said: str) -> list[str]:
        if not said:
            return []
        if said[0] == "!":
            return [f"coalesce({column}, 'nan') <> '{said[1:]}'"]
        return [f"coalesce({column}, 'nan') IN ({', '.join(repr(x) for x in said.split('|'))})"]

    parts = one("Contract", contract) + one("InternetService", internet) + one("PaymentMethod", payment) + one("PaperlessBilling", paperless)
    return " AND ".join(parts + ([f"{_T} {tenure}"] if tenure else []))


_MTM, _FIBER, _EC, _MANUAL = "Month-to-month", "Fiber optic", "Electronic check", "Electronic check|Mailed check"
# The presets.
PRESETS: dict[str, str] = {
    "early_manual_internet": _mask(_MTM, "!No", _MANUAL, "", "<= 24"),
    "early_all_internet": _mask(_MTM, "!No", "", "", "<= 24"),
    "fiber_paperless_early": _mask(_MTM, _FIBER, "", "Yes", "<= 24"),
    "late_mtm_fiber": _mask(_MTM, _FIBER, "", "", "> 24"),
    "late_mtm_fiber_paperless": _mask(_MTM, _FIBER, "", "Yes", "> 24"),
    "long_fiber_any": _mask("One year|Two year", _FIBER, "", "", "> 24"),
    "manual_no_internet": _mask("", "No", _MANUAL),
    "one_year_fiber_any": _mask("One year", _FIBER),
    "one_year_dsl_any": _mask("One year", "DSL"),
    "one_year_dsl_paperless_49plus": _mask("One year", "DSL", "", "Yes", ">= 49"),
    "two_year_fiber_any": _mask("Two year", _FIBER),
    "two_year_dsl_paperless_49plus": _mask("Two year", "DSL", "", "Yes", ">= 49"),
    "one_year_fiber_paperless_49plus": _mask("One year", _FIBER, "", "Yes", ">= 49"),
    "one_year_fiber_paperless_25_48": _mask("One year", _FIBER, "", "Yes", "BETWEEN 25 AND 48"),
    "two_year_fiber_paperless_49plus": _mask("Two year", _FIBER, "", "Yes", ">= 49"),
    "two_year_fiber_nopaperless_49plus": _mask("Two year", _FIBER, "", "No", ">= 49"),
    "mtm_dsl_paperless_25_48_manual": _mask(_MTM, "DSL", _MANUAL, "Yes", "BETWEEN 25 AND 48"),
    "mtm_dsl_paperless_25_48_any": _mask(_MTM, "DSL", "", "Yes", "BETWEEN 25 AND 48"),
    "mtm_nointernet_mailed_0_24": _mask(_MTM, "No", "Mailed check", "", "<= 24"),
    "mtm_nointernet_no_0_6": _mask(_MTM, "No", "", "No", "<= 6"),
    "ec_mtm_fiber_paperless_0_6": _mask(_MTM, _FIBER, _EC, "Yes", "<= 6"),
    "ec_mtm_fiber_paperless_25_48": _mask(_MTM, _FIBER, _EC, "Yes", "BETWEEN 25 AND 48"),
    "ec_mtm_fiber_paperless_any": _mask(_MTM, _FIBER, _EC, "Yes"),
    "ec_mtm_fiber_any": _mask(_MTM, _FIBER, _EC),
    "ec_mtm_dsl_paperless_0_6": _mask(_MTM, "DSL", _EC, "Yes", "<= 6"),
    "ec_mtm_dsl_paperless_any": _mask(_MTM, "DSL", _EC, "Yes"),
}


def preset(name: str) -> Column:
    if name not in PRESETS:
        raise ValueError(f"Unknown preset {name!r}; known: {sorted(PRESETS)}")
    return F.expr(PRESETS[name])
