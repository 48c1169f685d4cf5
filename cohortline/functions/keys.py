"""Bins, keys and signatures as SQL expressions that mean the same in Spark and in other engines."""

from __future__ import annotations

from itertools import combinations

from ..schema import SERVICES, text


def bins(value: str, edges: tuple[float, ...], labels: tuple[str, ...], low: float | None = None) -> str:
    """Right-closed bins; below `low` (if given), above the last edge (if there are as many labels) and missing: 'nan'."""
    cases = [f"WHEN {value} IS NULL THEN 'nan'"] + ([f"WHEN {value} <= {low} THEN 'nan'"] if low is not None else [])
    cases += [f"WHEN {value} <= {e} THEN '{x}'" for e, x in zip(edges, labels)]
    return f"CASE {' '.join(cases)} ELSE '{labels[len(edges)] if len(labels) > len(edges) else 'nan'}' END"


def number(column: str) -> str:
    """A number, missing where it can't be read as one."""
    return f"try_cast({column} AS DOUBLE)"


def filled(column: str, value: str = "0") -> str:
    return f"coalesce({number(column)}, cast({value} AS DOUBLE))"


# Edges and labels of the bins.
TENURE = ((6, 12, 24, 48), ("0_6", "7_12", "13_24", "25_48", "49_plus"))
FINE_TENURE = ((2, 6, 12, 18, 24, 36, 48, 60), ("0_2", "3_6", "7_12", "13_18", "19_24", "25_36", "37_48", "49_60", "61_plus"))
SUPPORT_BUCKETS = ((0.5, 4.5, 24.5, 74.5, 199.5), ("zero", "1_4", "5_24", "25_74", "75_199", "200p"))


def tenure_bin(value: str = number("tenure")) -> str:
    return bins(value, *TENURE)


def fine_tenure_bin(value: str = number("tenure")) -> str:
    return bins(value, *FINE_TENURE)


def support_bucket(count: str) -> str:
    return bins(count, *SUPPORT_BUCKETS)


def key(*columns: str) -> str:
    """Texts joined by __; a missing value is a text too."""
    return " || '__' || ".join(text(c) for c in columns)


SEGMENT3 = ("PaymentMethod", "Contract", "InternetService")
SEGMENT5 = (*SEGMENT3, "PaperlessBilling", "tenure_bin")


def segment3() -> str:
    return key(*SEGMENT3)


def segment5(tenure: str = tenure_bin()) -> str:
    return f"{key(*SEGMENT5[:4])} || '__' || {tenure}"


def yes(column: str) -> str:
    return f"CASE WHEN lower({text(column)}) = 'yes' THEN 1 ELSE 0 END"


def count_yes(columns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"({yes(c)})" for c in columns) + ")"


def clip(p: str, epsilon: str = "0.000001") -> str:
    return f"least(greatest({p}, cast({epsilon} AS DOUBLE)), cast(1 - {epsilon} AS DOUBLE))"


def logit(p: str, epsilon: str = "0.000001") -> str:
    return f"ln({clip(p, epsilon)} / (1 - {clip(p, epsilon)}))"


def normal_text(column: str) -> str:
    """Trimmed, lower-cased, with single spaces; a missing value is __missing__."""
    return f"lower(trim(regexp_replace(coalesce(cast({column} AS STRING), '__missing__'), '[ \\\\t\\\\n\\\\r]+', ' ')))"


def first_letters(columns: tuple[str, ...]) -> str:
    return " || ".join(f"upper(substr({text(c)}, 1, 1))" for c in columns)


def ngrams(columns: tuple[str, ...], trigrams: bool = False) -> dict[str, str]:
    """Keys of all pairs of columns, and of all triples of the first four."""
    out = {f"ng2_{a}_{b}": key(a, b) for a, b in combinations(columns, 2)}
    if trigrams:
        out |= {f"ng3_{a}_{b}_{c}": key(a, b, c) for a, b, c in combinations(columns[:4], 3)}
    return out


#: The columns that n-grams are made of.
NGRAM_COLUMNS = ("Contract", "InternetService", "PaymentMethod", "OnlineSecurity", "TechSupport", "PaperlessBilling")


def sister_family(value: str) -> str | None:
    """The family with the tenure bin before (for the first: the next); of an unknown bin, that with the other billing."""
    parts = value.split("__")
    if len(parts) != 5:
        return None
    labels = TENURE[1]
    if parts[4] in labels:
        at = labels.index(parts[4])
        parts[4] = labels[at - 1 if at else 1]
    else:
        parts[3] = "No" if parts[3] == "Yes" else "Yes"
    return "__".join(parts)


def services_paid() -> str:
    """Number of services that an account pays for."""
    return f"(CASE WHEN lower({text('InternetService')}) <> 'no' THEN 1 ELSE 0 END + ({yes('PhoneService')}) + ({yes('MultipleLines')}) + {count_yes(SERVICES)})"


def sister_column(value: str) -> str:
    """The same for a column of families of five parts; NULL for other ones."""
    part = lambda i: f"element_at(split({value}, '__'), {i})"
    labels = "array(" + ", ".join(f"'{x}'" for x in TENURE[1]) + ")"
    at = f"array_position({labels}, {part(5)})"
    moved = f"concat_ws('__', {part(1)}, {part(2)}, {part(3)}, {part(4)}, element_at({labels}, cast(CASE WHEN {at} > 1 THEN {at} - 1 ELSE 2 END AS INT)))"
    flipped = f"concat_ws('__', {part(1)}, {part(2)}, {part(3)}, CASE WHEN {part(4)} = 'Yes' THEN 'No' ELSE 'Yes' END, {part(5)})"
    return f"CASE WHEN size(split({value}, '__')) <> 5 THEN NULL WHEN {at} > 0 THEN {moved} ELSE {flipped} END"


# Edges and labels of the support of a segment5.
SEGMENT5_SUPPORT = ((49, 99, 249, 499), ("lt50", "50_99", "100_249", "250_499", "500_plus"))


def segment5_support_bucket(count: str) -> str:
    return bins(count, *SEGMENT5_SUPPORT)


def normal_number(column: str, decimals: int = 6) -> str:
    """Rounded half to even; what isn't a number is -999999."""
    return f"coalesce(bround({number(column)}, {decimals}), cast(-999999 AS DOUBLE))"


def number_text(column: str, decimals: int = 6) -> str:
    """A normalised number as the text of a whole number of its last decimals, which all engines write alike."""
    return f"cast(cast(bround({normal_number(column, decimals)} * 1e{decimals}, 0) AS BIGINT) AS STRING)"
