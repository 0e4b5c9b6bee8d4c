"""Scalar cleaning and predicate functions (Column → Column) and the small
row-level operators built from them.  All are built-in Spark expressions, so
they stay inside whole-stage code generation and push down where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESSENTIAL = ["fecha", "lottery", "result", "series"]

# Sign name aliases → 3-letter code (accented and unaccented).
SIGN_ALIASES = {
    "ARIES": "ARI", "TAURO": "TAU", "GEMINIS": "GEM", "GÉMINIS": "GEM",
    "CANCER": "CAN", "CÁNCER": "CAN", "LEO": "LEO", "VIRGO": "VIR", "LIBRA": "LIB",
    "ESCORPIO": "ESC", "ESCORPION": "ESC", "SAGITARIO": "SAG", "CAPRICORNIO": "CAP",
    "ACUARIO": "ACU", "PISCIS": "PIS",
}

# Accepted date layouts, tried in this order.
DATE_PATTERNS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy"]
# shape of each layout; a parse is only attempted on text of that shape, so
# failed attempts (which cost an exception each) stay rare
_DATE_SHAPES = [r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- P18 / P19 --------------------------------------------------------------

def canonical_text(c) -> Column:
    """Trimmed, upper-cased text."""
    return F.upper(F.trim(_c(c)))


def slug(c) -> Column:
    """Lower-case, spaces → underscores."""
    return F.lower(F.replace(_c(c), F.lit(" "), F.lit("_")))


# -- P1 / P2 / P3 -----------------------------------------------------------

def lottery_eq(name: str, col: str = "lottery") -> Column:
    """Case-insensitive equality."""
    return F.upper(F.col(col)) == F.upper(F.lit(name))


def lottery_contains(text: str, col: str = "lottery") -> Column:
    """Case-insensitive literal substring (no LIKE wildcards)."""
    return F.upper(F.col(col)).contains(F.upper(F.lit(text)))


def between_dates(lo: str, hi: str, col: str = "fecha") -> Column:
    """Inclusive on both ends."""
    return F.col(col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


# -- P6 / P7 / P8 -----------------------------------------------------------

def parse_fecha(c) -> Column:
    """First layout that parses (1-digit day and month accepted); else null."""
    t = F.trim(_c(c))
    return F.coalesce(*[F.when(t.rlike(shape), F.call_function("try_to_date", t, F.lit(p)))
                        for p, shape in zip(DATE_PATTERNS, _DATE_SHAPES)])


def sign_map() -> Column:
    return F.create_map(*[x for k, v in SIGN_ALIASES.items() for x in (F.lit(k), F.lit(v))])


def normalise_sign(c, mode: str = "passthrough") -> Column:
    """upper+trim, alias map; unknown names stay (``passthrough``) or null (``strict``)."""
    up = canonical_text(c)
    mapped = F.try_element_at(sign_map(), up)
    if mode == "passthrough":
        return F.coalesce(mapped, up)
    if mode == "strict":
        return mapped
    raise ValueError(mode)


def parse_number(c) -> Column:
    """Strip non-digits; exactly four digits → int, else null."""
    digits = F.regexp_replace(_c(c), r"[^0-9]", "")
    return F.when(F.length(digits) == 4, digits.cast("int"))


# -- P15 / P16 / P17 --------------------------------------------------------

def zfill4(c) -> Column:
    """Zero-padded 4-character number."""
    return F.lpad(_c(c).cast("string"), 4, "0")


def is_four_digits(c) -> Column:
    return _c(c).rlike(r"^\d{4}$")


def calendar_parts(c) -> list[Column]:
    """Day, month, year, weekday (Monday = 0) and English day name."""
    c = _c(c)
    return [F.dayofmonth(c).alias("day"), F.month(c).alias("month"), F.year(c).alias("year"),
            F.weekday(c).alias("weekday"), F.date_format(c, "EEEE").alias("day_name")]


DIGIT_COLUMNS = ["miles", "centenas", "decenas", "unidades"]


def digits(c) -> list[Column]:
    """Thousands, hundreds, tens and units digit."""
    c = _c(c)
    return [(F.floor(c / F.lit(p)) % 10).cast("int").alias(n)
            for n, p in zip(DIGIT_COLUMNS, (1000, 100, 10, 1))]


def from_digits(m, c, d, u) -> Column:
    """P17 inverse."""
    return _c(m) * 1000 + _c(c) * 100 + _c(d) * 10 + _c(u)


# -- P5 / P9 / P12 ----------------------------------------------------------

def drop_incomplete(df: DataFrame, cols=ESSENTIAL) -> DataFrame:
    """P5: drop a row when any essential field is null."""
    return df.dropna(subset=list(cols))


def essential_columns(df: DataFrame, cols=ESSENTIAL) -> DataFrame:
    """Fail on missing columns, keep only the essential ones."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing essential columns: {missing}")
    return df.select(*cols)


def finite_or_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """±inf and NaN → 0, nulls → 0, on numeric columns."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    cols = cols or [n for n, t in df.dtypes if t in numeric or t.startswith("decimal")]
    out = []
    for n, t in df.dtypes:
        if n in cols:
            c = F.col(n)
            if t in ("double", "float"):
                c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)
            out.append(F.coalesce(c, F.lit(0).cast(t)).alias(n))
        else:
            out.append(F.col(n))
    return df.select(*out)


# -- cleaning pipeline for text rows (P5–P8, P18) ---------------------------

def clean_draws(df: DataFrame, sign_mode: str = "passthrough") -> DataFrame:
    """Text draw rows → typed draws; rows with any unusable field are dropped."""
    typed = df.select(
        parse_fecha("fecha").alias("fecha"),
        canonical_text("lottery").alias("lottery"),
        parse_number("result").alias("result"),
        normalise_sign("series", sign_mode).alias("series"),
        *[c for c in df.columns if c not in ESSENTIAL],
    )
    return drop_incomplete(typed)


# -- P10 --------------------------------------------------------------------

def validation_reasons(df: DataFrame) -> Column:
    """P10: array of every reason a typed-or-text draw row is invalid."""
    lot = F.trim(F.col("lottery").cast("string"))
    numeric = dict(df.dtypes)["result"] in ("int", "bigint", "smallint")
    res_num = F.col("result").cast("bigint") if numeric else F.expr("try_cast(result AS BIGINT)")
    fecha_ok = F.col("fecha").isNotNull() if dict(df.dtypes)["fecha"] == "date" else \
        parse_fecha("fecha").isNotNull()
    reasons = [
        F.when(lot.isNull() | (lot == ""), F.lit("lottery: empty")),
        F.when(res_num.isNull(), F.lit("result: not a number"))
         .when((res_num < 0) | (res_num > 9999), F.lit("result: outside 0..9999")),
        F.when(~fecha_ok, F.lit("fecha: unparseable")),
        F.when(F.col("series").isNull() | (F.trim(F.col("series")) == ""), F.lit("series: required")),
    ]
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())


def validate_draws(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10: split into (good rows, bad rows with ``reasons``); the caller decides to fail."""
    tagged = df.withColumn("reasons", validation_reasons(df))
    return (tagged.filter(F.size("reasons") == 0).drop("reasons"),
            tagged.filter(F.size("reasons") > 0))


# -- P11 --------------------------------------------------------------------

def check_training_set(df: DataFrame, min_rows: int = 50, key: str = "lottery",
                       cols: list[str] | None = None) -> DataFrame:
    """Per series, row count, null count per column and an ok flag."""
    cols = cols or [c for c in df.columns if c != key]
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [
        F.sum(F.col(c).isNull().cast("int")).alias(f"nulls_{c}") for c in cols]
    out = df.groupBy(key).agg(*aggs)
    null_cols = F.filter(F.array(*[F.when(F.col(f"nulls_{c}") > 0, F.lit(c)) for c in cols]),
                         lambda x: x.isNotNull())
    return out.withColumn("null_columns", F.array_join(null_cols, ",")) \
        .withColumn("enough_rows", F.col("n_rows") >= min_rows) \
        .withColumn("ok", (F.col("n_rows") >= min_rows) & (F.size(null_cols) == 0))


# -- P13 / P14 --------------------------------------------------------------

def sign_codes(df: DataFrame, col: str = "series") -> DataFrame:
    """Alphabetical dense code (0-based) of every distinct upper-cased sign.

    The distinct set is tiny (partial+final aggregation); the ranking window
    runs over that set only.
    """
    from pyspark.sql.window import Window
    signs = df.select(F.upper(F.col(col)).alias("sign")).where(F.col("sign").isNotNull()).distinct()
    return signs.select("sign", (F.dense_rank().over(Window.orderBy("sign")) - 1).alias("code"))


def encode_sign(df: DataFrame, col: str = "series", codes: DataFrame | None = None) -> DataFrame:
    """Add ``<col>_code``."""
    from ..session import store
    codes = store(codes if codes is not None else sign_codes(df, col), "sign-codes")    # the planner then knows its size
    return df.join(codes.withColumnRenamed("code", f"{col}_code"),
                   F.upper(df[col]) == codes["sign"], "left").drop("sign")


def decode_sign(df: DataFrame, code_col: str, codes: DataFrame, out: str = "decoded") -> DataFrame:
    """Code → sign through the same code table; unknown code → its text."""
    from ..session import store
    c = store(codes.select(F.col("code").alias("_code"), F.col("sign").alias("_sign")), "sign-codes")
    return df.join(c, df[code_col] == c["_code"], "left") \
        .withColumn(out, F.coalesce(F.col("_sign"), F.col(code_col).cast("string"))) \
        .drop("_code", "_sign")
