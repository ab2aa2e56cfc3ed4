"""Rounding and ratios as SQL text, the same arithmetic in every engine."""

from __future__ import annotations

SPARK_RINT, ORACLE_RINT = "rint({})", "round_even({}, 0)"


def py_round(x: str, digits: int, rint: str = SPARK_RINT) -> str:
    """x rounded half to even of its exact binary value, as Python's round does.

    x * 10^digits is rounded to the nearest integer; where the scaled value looks like a tie, the exact error of the
    product (by Dekker's splitting) tells on which side of it x lies.
    """
    k = float(2 * 10**digits)
    c = 134217729.0
    ck = c * k
    kh = ck - (ck - k)
    kl = k - kh
    v = f"cast({x} as double)"
    d = lambda f: f"cast({f!r} as double)"
    p = f"({v} * {d(k)})"
    xh = f"({d(c)} * {v} - ({d(c)} * {v} - {v}))"
    xl = f"({v} - {xh})"
    e = f"((({xh} * {d(kh)} - {p}) + {xh} * {d(kl)} + {xl} * {d(kh)}) + {xl} * {d(kl)})"
    half = f"cast(floor({p} / 2) as double)"
    tie = f"CASE WHEN {e} > 0 THEN {half} + 1 WHEN {e} < 0 THEN {half} ELSE {rint.format(f'{p} / 2')} END"
    return f"(CASE WHEN {p} = floor({p}) AND {p} - 2 * {half} = 1 THEN {tie} ELSE {rint.format(f'{p} / 2')} END / {d(float(10**digits))})"


def safe_ratio(n: str, d: str, rint: str = SPARK_RINT) -> str:
    """n / d to three digits, 0 where d is 0."""
    return f"(CASE WHEN coalesce({d}, 0) = 0 THEN cast(0 as double) ELSE {py_round(f'({n}) / nullif(({d}), 0)', 3, rint)} END)"


def case(*rules: tuple[str, str], default: str = "NULL") -> str:
    """The value of the first condition that holds."""
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def labels(column: str, cuts: list[tuple[str, str]], default: str, unknown: str | None = None) -> str:
    """A bin: cuts are (comparison, label) tried in order."""
    first = [(f"{column} IS NULL", text(unknown))] if unknown else []
    return case(*first, *((f"{column} {c}", text(v)) for c, v in cuts), default=text(default))
