"""Queries for scalar functions, cleaning and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clean as C
from ..session import ensure_checkpoint_dir
from ..sources import tabular as S
from ..sources import testdata as td
from . import sqlfrag as Q
from .registry import register

DRAW_SPEC = "lottery str, fecha date, result int, series str"


def _dirty_sql(body: str, extra: list[str] | None = None) -> str:
    return td.with_ctes(["raw"], body, [Q.DIRTY_CTE] + (extra or []))


# -- P5 P6 P7 P8 P18: text rows → typed draws -------------------------------

@register("clean_draws", f"k int, {DRAW_SPEC}", _dirty_sql(f"""
SELECT * FROM (
  SELECT k, {Q.parse_fecha('fecha')} AS fecha, upper(trim(lottery)) AS lottery,
         {Q.parse_number('result')} AS result, {Q.normalise_sign('series')} AS series
  FROM dirty) c
WHERE fecha IS NOT NULL AND lottery IS NOT NULL AND result IS NOT NULL AND series IS NOT NULL"""))
def q_clean_draws(spark, sf_dir):
    return C.clean_draws(td.dirty_draws(spark, sf_dir))


@register("normalise_sign", "k int, raw str, passthrough str, strict str", _dirty_sql(f"""
SELECT k, series AS raw, {Q.normalise_sign('series')} AS passthrough,
       {Q.normalise_sign('series', 'strict')} AS strict
FROM dirty"""))
def q_normalise_sign(spark, sf_dir):
    d = td.dirty_draws(spark, sf_dir)
    return d.select("k", F.col("series").alias("raw"),
                    C.normalise_sign("series").alias("passthrough"),
                    C.normalise_sign("series", "strict").alias("strict"))


@register("parse_fecha", "k int, raw str, fecha date", _dirty_sql(
    f"SELECT k, fecha AS raw, {Q.parse_fecha('fecha')} AS fecha FROM dirty"))
def q_parse_fecha(spark, sf_dir):
    d = td.dirty_draws(spark, sf_dir)
    return d.select("k", F.col("fecha").alias("raw"), C.parse_fecha("fecha").alias("fecha"))


@register("parse_number", "k int, raw str, result nint", _dirty_sql(
    f"SELECT k, result AS raw, {Q.parse_number('result')} AS result FROM dirty"))
def q_parse_number(spark, sf_dir):
    d = td.dirty_draws(spark, sf_dir)
    return d.select("k", F.col("result").alias("raw"), C.parse_number("result").alias("result"))


@register("drop_incomplete", f"k int, {DRAW_SPEC}", _dirty_sql(f"""
SELECT * FROM (SELECT k, {Q.parse_fecha('fecha')} AS fecha, lottery, {Q.parse_number('result')} AS result,
                      series FROM dirty) t
WHERE fecha IS NOT NULL AND lottery IS NOT NULL AND result IS NOT NULL AND series IS NOT NULL"""))
def q_drop_incomplete(spark, sf_dir):
    d = td.dirty_draws(spark, sf_dir)
    typed = d.select("k", C.parse_fecha("fecha").alias("fecha"), "lottery",
                     C.parse_number("result").alias("result"), "series")
    return C.drop_incomplete(typed)


# -- P10 --------------------------------------------------------------------

@register("validate_draws", "k int, reasons str, n_reasons int", _dirty_sql(f"""
SELECT * FROM (
  SELECT k,
    concat_ws('; ',
      CASE WHEN lottery IS NULL OR trim(lottery) = '' THEN 'lottery: empty' END,
      CASE WHEN res IS NULL THEN 'result: not a number'
           WHEN res < 0 OR res > 9999 THEN 'result: outside 0..9999' END,
      CASE WHEN {Q.parse_fecha('fecha')} IS NULL THEN 'fecha: unparseable' END,
      CASE WHEN series IS NULL OR trim(series) = '' THEN 'series: required' END) AS reasons,
    (CASE WHEN lottery IS NULL OR trim(lottery) = '' THEN 1 ELSE 0 END
     + CASE WHEN res IS NULL OR res < 0 OR res > 9999 THEN 1 ELSE 0 END
     + CASE WHEN {Q.parse_fecha('fecha')} IS NULL THEN 1 ELSE 0 END
     + CASE WHEN series IS NULL OR trim(series) = '' THEN 1 ELSE 0 END) AS n_reasons
  FROM (SELECT k, fecha, lottery, {Q.parse_number('result')} AS res,
               {Q.normalise_sign('series', 'strict')} AS series FROM dirty) v) r
WHERE n_reasons > 0"""))
def q_validate_draws(spark, sf_dir):
    d = td.dirty_draws(spark, sf_dir).select(
        "k", "fecha", "lottery", C.parse_number("result").alias("result"),
        C.normalise_sign("series", "strict").alias("series"))
    _good, bad = C.validate_draws(d)
    return bad.select("k", F.array_join("reasons", "; ").alias("reasons"),
                      F.size("reasons").alias("n_reasons"))


# -- P1 P2 P3 ---------------------------------------------------------------

@register("lottery_eq", "lottery str, fecha date, result int", td.with_ctes(
    ["draws"], "SELECT lottery, fecha, result FROM draws WHERE upper(lottery) = upper('3-medium')"))
def q_lottery_eq(spark, sf_dir):
    return td.stored_draws(spark, sf_dir).filter(C.lottery_eq("3-medium")).select("lottery", "fecha", "result")


@register("lottery_contains", "lottery str, fecha date, result int", td.with_ctes(
    ["draws"], "SELECT lottery, fecha, result FROM draws WHERE contains(upper(lottery), upper('high'))"))
def q_lottery_contains(spark, sf_dir):
    return td.stored_draws(spark, sf_dir).filter(C.lottery_contains("high")).select("lottery", "fecha", "result")


@register("between_dates", "lottery str, fecha date, result int", td.with_ctes(
    ["draws"], """SELECT lottery, fecha, result FROM draws
WHERE fecha BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'"""))
def q_between_dates(spark, sf_dir):
    return td.stored_draws(spark, sf_dir).filter(C.between_dates("1996-03-01", "1996-03-31")) \
        .select("lottery", "fecha", "result").orderBy("fecha")


# -- P4 ---------------------------------------------------------------------

TODAY = "1999-01-01"
_TARGET_SQL = """tgt AS (
  SELECT * FROM raw_old
  WHERE lottery <> '5-LOW'
    AND fecha <= CASE WHEN lottery = '1-URGENT' THEN DATE '1998-12-31' ELSE DATE '1998-06-30' END)"""


def _target(spark, sf_dir):
    r = td.raw_old(spark, sf_dir)
    cut = F.when(F.col("lottery") == "1-URGENT", F.lit("1998-12-31")).otherwise(F.lit("1998-06-30")).cast("date")
    return r.filter((F.col("lottery") != "5-LOW") & (F.col("fecha") <= cut))


def _new_rows_sql(upper: bool):
    y = f"(DATE '{TODAY}' - INTERVAL 1 DAY)"
    keep = f"(m.last_fecha IS NULL OR (m.last_fecha < {y} AND n.fecha >= m.last_fecha + INTERVAL 1 DAY))"
    if upper:
        keep += f" AND n.fecha <= {y}"
    return td.with_ctes(["raw_old", "raw_new"], f"""
SELECT n.k, n.lottery, n.fecha, n.result, n.series
FROM raw_new n LEFT JOIN (SELECT lottery, max(fecha) AS last_fecha FROM tgt GROUP BY lottery) m
  ON n.lottery = m.lottery
WHERE {keep}""", [_TARGET_SQL])


@register("new_rows", f"k int, {DRAW_SPEC}", _new_rows_sql(False))
def q_new_rows(spark, sf_dir):
    return S.new_rows(td.raw_new(spark, sf_dir), _target(spark, sf_dir), TODAY)


@register("new_rows_closed", f"k int, {DRAW_SPEC}", _new_rows_sql(True))
def q_new_rows_closed(spark, sf_dir):
    return S.new_rows(td.raw_new(spark, sf_dir), _target(spark, sf_dir), TODAY, upper_bound=True)


# -- P11 --------------------------------------------------------------------

@register("check_training_set",
          "lottery str, n_rows int, nulls_fecha int, nulls_result int, nulls_series int, "
          "null_columns str, enough_rows bool, ok bool",
          _dirty_sql(f"""
SELECT lottery, n_rows, nulls_fecha, nulls_result, nulls_series,
       concat_ws(',', CASE WHEN nulls_fecha > 0 THEN 'fecha' END, CASE WHEN nulls_result > 0 THEN 'result' END,
                      CASE WHEN nulls_series > 0 THEN 'series' END) AS null_columns,
       n_rows >= 50 AS enough_rows,
       n_rows >= 50 AND nulls_fecha = 0 AND nulls_result = 0 AND nulls_series = 0 AS ok
FROM (SELECT lottery, count(*) AS n_rows,
             sum(CASE WHEN fecha IS NULL THEN 1 ELSE 0 END) AS nulls_fecha,
             sum(CASE WHEN result IS NULL THEN 1 ELSE 0 END) AS nulls_result,
             sum(CASE WHEN series IS NULL THEN 1 ELSE 0 END) AS nulls_series
      FROM (SELECT upper(trim(lottery)) AS lottery, {Q.parse_fecha('fecha')} AS fecha,
                   {Q.parse_number('result')} AS result, {Q.normalise_sign('series', 'strict')} AS series
            FROM dirty) t
      GROUP BY lottery) g"""))
def q_check_training_set(spark, sf_dir):
    d = td.dirty_draws(spark, sf_dir).select(
        C.canonical_text("lottery").alias("lottery"), C.parse_fecha("fecha").alias("fecha"),
        C.parse_number("result").alias("result"), C.normalise_sign("series", "strict").alias("series"))
    return C.check_training_set(d, min_rows=50)


# -- P13 P14 ----------------------------------------------------------------

@register("sign_codes", "lottery str, fecha date, series str, series_code int, decoded str", td.with_ctes(
    ["draws"], """
SELECT d.lottery, d.fecha, d.series, c.code AS series_code, c.sign AS decoded
FROM draws d JOIN (SELECT sign, CAST(dense_rank() OVER (ORDER BY sign) - 1 AS BIGINT) AS code
                   FROM (SELECT DISTINCT upper(series) AS sign FROM draws) s) c
  ON upper(d.series) = c.sign"""))
def q_sign_codes(spark, sf_dir):
    d = td.draws(spark, sf_dir).select("lottery", "fecha", "series")
    codes = C.sign_codes(d)
    enc = C.encode_sign(d, codes=codes)
    return C.decode_sign(enc, "series_code", codes)


# -- P15 P16 P17 P19 --------------------------------------------------------

@register("draw_parts",
          "lottery str, fecha date, numero str, four_digits bool, day int, month int, year int, "
          "weekday int, day_name str, miles int, centenas int, decenas int, unidades int, "
          "recomposed int, slug str",
          td.with_ctes(["draws"], """
SELECT lottery, fecha, lpad(CAST(result AS VARCHAR), 4, '0') AS numero,
       regexp_full_match(lpad(CAST(result AS VARCHAR), 4, '0'), '\\d{4}') AS four_digits,
       day(fecha) AS day, month(fecha) AS month, year(fecha) AS year,
       isodow(fecha) - 1 AS weekday, dayname(fecha) AS day_name,
       CAST(floor(result / 1000) AS BIGINT) % 10 AS miles, CAST(floor(result / 100) AS BIGINT) % 10 AS centenas,
       CAST(floor(result / 10) AS BIGINT) % 10 AS decenas, result % 10 AS unidades,
       result AS recomposed, lower(replace(lottery, ' ', '_')) AS slug
FROM draws"""))
def q_draw_parts(spark, sf_dir):
    d = td.draws(spark, sf_dir)
    parts = d.select("lottery", "fecha", "result", C.zfill4("result").alias("numero"),
                     *C.calendar_parts("fecha"), *C.digits("result"), C.slug("lottery").alias("slug"))
    return parts.withColumn("four_digits", C.is_four_digits("numero")) \
        .withColumn("recomposed", C.from_digits("miles", "centenas", "decenas", "unidades"))


# -- S2 ---------------------------------------------------------------------

@register("read_draws", DRAW_SPEC, td.with_ctes(
    ["draws"], "SELECT lottery, fecha, result, series FROM draws WHERE upper(lottery) = upper('2-high')"))
def q_read_draws(spark, sf_dir):
    """The draws are stored (partitioned by lottery) and read back with the
    lottery predicate evaluated by the Parquet scan."""
    root = f"{ensure_checkpoint_dir(spark)}/draws_{uuid.uuid4().hex}"
    path = S.write_version(td.draws(spark, sf_dir), root, 0, partition_by=("lottery",))
    return S.read_draws(path, "2-high", spark=spark, canonical_names=True)


# -- S3 + P9 ----------------------------------------------------------------

@register("read_draws_tabular", DRAW_SPEC, _dirty_sql(f"""
SELECT * FROM (
  SELECT {Q.parse_fecha('fecha')} AS fecha, upper(trim(lottery)) AS lottery,
         TRY_CAST(trim(result) AS INTEGER) AS result, upper(trim(series)) AS series
  FROM (SELECT fecha, lottery, replace(result, '-', '') AS result, series FROM dirty) d) t
WHERE fecha IS NOT NULL AND lottery IS NOT NULL AND result IS NOT NULL AND series IS NOT NULL"""),
          note="writes the dirty rows as CSV under the checkpoint folder, reads them back")
def q_read_draws_tabular(spark, sf_dir):
    root = ensure_checkpoint_dir(spark)
    path = f"{root}/tabular_{uuid.uuid4().hex}"
    d = td.dirty_draws(spark, sf_dir)
    d.select("fecha", "lottery", F.replace("result", F.lit("-"), F.lit("")).alias("result"), "series") \
        .write.option("header", True).csv(path)
    return S.read_draws_tabular(spark, path)


# -- S6 ---------------------------------------------------------------------

@register("merge_snapshot", f"k int, {DRAW_SPEC}", td.with_ctes(["raw_old", "raw_new"], """
SELECT k, lottery, fecha, result, series FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY src DESC, k DESC) AS rn
  FROM (SELECT *, 0 AS src FROM raw_old UNION ALL SELECT *, 1 AS src FROM raw_new) u) r
WHERE rn = 1"""))
def q_merge_snapshot(spark, sf_dir):
    return S.merge_snapshot(td.raw_old(spark, sf_dir), td.raw_new(spark, sf_dir))


# -- S8 / S9 ----------------------------------------------------------------

@register("list_lotteries", "lottery str", _dirty_sql(
    "SELECT DISTINCT trim(lottery) AS lottery FROM dirty WHERE lottery IS NOT NULL"))
def q_list_lotteries(spark, sf_dir):
    return S.list_lotteries(td.dirty_draws(spark, sf_dir))


@register("last_date", "lottery str, last_fecha date, start_fecha date", td.with_ctes(["raw"], f"""
SELECT l.lottery, m.last_fecha,
       coalesce(m.last_fecha + INTERVAL 1 DAY, DATE '{TODAY}' - INTERVAL 30 DAY) AS start_fecha
FROM (SELECT DISTINCT lottery FROM raw UNION ALL SELECT '6-NEW') l
LEFT JOIN (SELECT lottery, max(fecha) AS last_fecha FROM raw GROUP BY lottery) m ON l.lottery = m.lottery"""))
def q_last_date(spark, sf_dir):
    r = td.raw_draws(spark, sf_dir)
    extra = spark.createDataFrame([("6-NEW",)], "lottery string")        # a lottery without history
    return S.last_date(r, default_days_back=30, today=TODAY, lotteries=r.select("lottery").unionByName(extra))


# -- P12 --------------------------------------------------------------------

@register("finite_or_zero", "lottery str, seq int, inv_units dbl, inv_tens dbl", td.with_ctes(["draws"], """
SELECT lottery, seq,
       CASE WHEN a IS NULL OR isinf(a) OR isnan(a) THEN 0.0 ELSE a END AS inv_units,
       CASE WHEN b IS NULL OR isinf(b) OR isnan(b) THEN 0.0 ELSE b END AS inv_tens
FROM (SELECT lottery, seq, pow(CAST(result % 10 AS DOUBLE), -1.0) AS a,
             pow(CAST(CAST(floor(result / 10) AS BIGINT) % 10 AS DOUBLE), -1.0) AS b FROM draws) x"""))
def q_finite_or_zero(spark, sf_dir):
    """Reciprocal digits produce ±inf for a zero digit; P12 maps them to 0."""
    d = td.draws(spark, sf_dir)
    ratios = d.select("lottery", "seq",
                      F.pow((F.col("result") % 10).cast("double"), F.lit(-1.0)).alias("inv_units"),
                      F.pow((F.floor(F.col("result") / 10) % 10).cast("double"), F.lit(-1.0)).alias("inv_tens"))
    return C.finite_or_zero(ratios, ["inv_units", "inv_tens"])


@register("ruled_draws", "lottery str, fecha date, seq int, result int, series str", td.with_ctes(["ruled"], "SELECT * FROM ruled"),
          note="F12, the learnable rule that the model queries are held against")
def q_ruled_draws(spark, sf_dir):
    return td.ruled_draws(spark, sf_dir)
