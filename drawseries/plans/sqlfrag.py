"""SQL text fragments for oracle queries, generated from the same fixed
values the Spark functions use (so both sides cannot drift apart)."""

from __future__ import annotations

from ..functions.clean import SIGN_ALIASES
from ..sources.testdata import SIGN_NAMES, SIGN_STRIP  # noqa: F401


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parse_fecha(x: str) -> str:
    t = f"trim({x})"
    return ("coalesce(" + ", ".join(
        f"CAST(try_strptime({t}, '{p}') AS DATE)" for p in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y")) + ")")


def parse_number(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) = 4 THEN CAST({d} AS INTEGER) END)"


def sign_alias(x: str) -> str:
    up = f"upper(trim({x}))"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SIGN_ALIASES.items())
    return f"(CASE {up} {whens} END)"


def normalise_sign(x: str, mode: str = "passthrough") -> str:
    if mode == "strict":
        return sign_alias(x)
    return f"coalesce({sign_alias(x)}, upper(trim({x})))"


def sign_name(code: str) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {q(n)}" for c, n in SIGN_NAMES)
    return f"(CASE {code} {whens} END)"


DIRTY_CTE = f"""dirty AS (
  SELECT k,
    CASE k % 4 WHEN 0 THEN strftime(fecha, '%Y-%m-%d') WHEN 1 THEN strftime(fecha, '%d/%m/%Y')
               WHEN 2 THEN strftime(fecha, '%d-%m-%Y') ELSE 'n/a' END AS fecha,
    CASE WHEN k % 17 = 0 THEN NULL ELSE '  ' || lower(lottery) || ' ' END AS lottery,
    CASE WHEN k % 7 = 0
         THEN substr(lpad(CAST(result AS VARCHAR), 4, '0'), 1, 2) || '-' || substr(lpad(CAST(result AS VARCHAR), 4, '0'), 3, 1)
         ELSE substr(lpad(CAST(result AS VARCHAR), 4, '0'), 1, 2) || '-' || substr(lpad(CAST(result AS VARCHAR), 4, '0'), 3, 2) END AS result,
    CASE WHEN k % 11 = 0 THEN 'OFIUCO' ELSE ' ' || {sign_name('series')} || ' ' END AS series
  FROM raw)"""
