"""Queries for the star schema, keyed writes and page ingest
(J1–J6, S1, S7, A3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import catalog as CT
from ..operators import stats as ST
from ..operators import update as U
from ..operators.catalog import dedupe_last
from ..session import ensure_checkpoint_dir, store
from ..sources.cow import CowTable
from ..sources import pages as PG
from ..sources import testdata as td
from . import sqlfrag as Q
from .registry import register

DRAW_SPEC = "lottery str, fecha date, result int, series str"
NO_PIS = ("PIS",)
SIGNOS_NO_PIS = "signos_np AS (SELECT * FROM signos WHERE codigo <> 'PIS')"
OLD_SQL = """old AS (SELECT fecha, lottery, result, series, k FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY k DESC) AS rn FROM raw_old) o WHERE rn = 1)"""


def _old(spark, sf_dir):
    return dedupe_last(td.raw_old(spark, sf_dir), ["fecha", "lottery"], ["k"])


def _fact(spark, sf_dir, draws):
    resolved, _ = CT.lookup_keys(draws, td.loterias(spark, sf_dir), td.signos(spark))
    return resolved.select("fecha", "loteria_id", "result", "signo_id")


# -- J1 ---------------------------------------------------------------------

@register("v_resultados", f"{DRAW_SPEC}, sign_name str", td.with_ctes(["draws", "loterias", "signos"], """
SELECT l.nombre AS lottery, f.fecha, f.result, s.codigo AS series, s.nombre AS sign_name
FROM draws f JOIN loterias l ON f.lottery = l.nombre JOIN signos s ON f.series = s.codigo"""))
def q_v_resultados(spark, sf_dir):
    fact = _fact(spark, sf_dir, td.draws(spark, sf_dir))
    return CT.v_resultados(fact, td.loterias(spark, sf_dir), td.signos(spark))


# -- J2 / J3 ----------------------------------------------------------------

_CLEAN_SQL = f"""cleaned AS (
  SELECT * FROM (
    SELECT k, {Q.parse_fecha('fecha')} AS fecha, upper(trim(lottery)) AS lottery,
           {Q.parse_number('result')} AS result, {Q.normalise_sign('series')} AS series
    FROM dirty) c
  WHERE fecha IS NOT NULL AND lottery IS NOT NULL AND result IS NOT NULL AND series IS NOT NULL)"""


@register("lookup_keys", "k int, lottery str, series str, loteria_id nint, signo_id nint, resolved bool",
          td.with_ctes(["raw", "loterias", "signos"], """
SELECT c.k, c.lottery, c.series, l.id AS loteria_id, s.id AS signo_id,
       l.id IS NOT NULL AND s.id IS NOT NULL AS resolved
FROM cleaned c LEFT JOIN loterias l ON upper(trim(c.lottery)) = upper(trim(l.nombre))
LEFT JOIN signos_np s ON upper(trim(c.series)) = upper(trim(s.codigo))""",
                       [Q.DIRTY_CTE, _CLEAN_SQL, SIGNOS_NO_PIS]))
def q_lookup_keys(spark, sf_dir):
    cleaned = C.clean_draws(td.dirty_draws(spark, sf_dir))
    ok, bad = CT.lookup_keys(cleaned, td.loterias(spark, sf_dir), td.signos(spark, drop=NO_PIS))
    both = ok.withColumn("resolved", F.lit(True)).unionByName(bad.withColumn("resolved", F.lit(False)))
    return both.select("k", "lottery", "series", "loteria_id", "signo_id", "resolved")


@register("unknown_codes", "series str", td.with_ctes(["raw", "signos"], """
SELECT DISTINCT series FROM cleaned WHERE series NOT IN (SELECT codigo FROM signos_np)""",
                                                     [Q.DIRTY_CTE, _CLEAN_SQL, SIGNOS_NO_PIS]))
def q_unknown_codes(spark, sf_dir):
    cleaned = C.clean_draws(td.dirty_draws(spark, sf_dir))
    return CT.unknown_codes(cleaned, td.signos(spark, drop=NO_PIS))


# -- J4 / J5 ----------------------------------------------------------------

@register("insert_if_absent", f"{DRAW_SPEC}, k int", td.with_ctes(["raw_old", "raw_new"], """
SELECT lottery, fecha, result, series, k FROM old
UNION ALL
SELECT lottery, fecha, result, series, k FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY k) AS rn FROM raw_new) n
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.fecha = n.fecha AND o.lottery = n.lottery)""",
                                                                         [OLD_SQL]))
def q_insert_if_absent(spark, sf_dir):
    merged, _ins = CT.insert_if_absent(_old(spark, sf_dir), td.raw_new(spark, sf_dir),
                                       ["fecha", "lottery"], ["k"])
    return merged


@register("upsert", f"{DRAW_SPEC}, k int", td.with_ctes(["raw_old", "raw_new"], """
SELECT lottery, fecha, result, series, k FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY p DESC, k DESC) AS rn
  FROM (SELECT *, 0 AS p FROM old UNION ALL SELECT fecha, lottery, result, series, k, 1 AS p FROM raw_new) u) r
WHERE rn = 1""", [OLD_SQL]))
def q_upsert(spark, sf_dir):
    return CT.upsert(_old(spark, sf_dir), td.raw_new(spark, sf_dir), ["fecha", "lottery"], ["k"])


@register("upsert_counts", "affected int, inserted int, replaced int, stored int", td.with_ctes(["raw_old", "raw_new"], """
SELECT (SELECT count(*) FROM raw_new) AS affected, count(*) FILTER (NOT has_old) AS inserted,
       count(*) FILTER (has_old AND has_new) AS replaced, count(*) AS stored
FROM (SELECT fecha, lottery, bool_or(p = 0) AS has_old, bool_or(p = 1) AS has_new
      FROM (SELECT fecha, lottery, 0 AS p FROM old UNION ALL SELECT fecha, lottery, 1 FROM raw_new) u GROUP BY ALL) k""", [OLD_SQL]),
          note="J5's counts, observed on the write of the merged table")
def q_upsert_counts(spark, sf_dir):
    merged, seen = CT.upsert_observed(_old(spark, sf_dir), td.raw_new(spark, sf_dir), ["fecha", "lottery"], ["k"])
    n = store(merged, "upserted").count()
    got = seen.get
    return spark.createDataFrame([(got["affected"], got["inserted"], got["replaced"], n)],
                                 "affected long, inserted long, replaced long, stored long")


# -- J6 ---------------------------------------------------------------------

@register("pair_predictions", "lottery str, fecha date, pred int, pred_series str, real_result int, real_series str",
          td.with_ctes(["pairs"], """
SELECT p.lottery, p.fecha, p.pred, p.pred_series, d.result AS real_result, d.series AS real_series
FROM pairs p JOIN draws d ON p.lottery = d.lottery AND p.fecha = d.fecha"""))
def q_pair_predictions(spark, sf_dir):
    d = td.draws(spark, sf_dir)
    preds = ST.persistence_predictions(d).select("lottery", "fecha", "pred", "pred_series")
    return CT.pair_predictions(preds, d)


# -- S7 / A3 ----------------------------------------------------------------

_BULK_SQL = [OLD_SQL, SIGNOS_NO_PIS, """fact_old AS (
  SELECT o.fecha, l.id AS loteria_id FROM old o JOIN loterias l ON o.lottery = l.nombre JOIN signos s ON o.series = s.codigo)""",
             """staged AS (
  SELECT n.*, l.id AS loteria_id, s.id AS signo_id
  FROM (SELECT * FROM raw_new WHERE fecha IS NOT NULL AND lottery IS NOT NULL AND result IS NOT NULL
          AND series IS NOT NULL) n
  LEFT JOIN loterias l ON n.lottery = l.nombre LEFT JOIN signos_np s ON n.series = s.codigo)""",
             """ins AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fecha, loteria_id ORDER BY k) AS rn
                 FROM staged WHERE loteria_id IS NOT NULL AND signo_id IS NOT NULL) s
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM fact_old f WHERE f.fecha = s.fecha AND f.loteria_id = s.loteria_id))""",
             """per AS (
  SELECT r.lottery,
         CASE WHEN r.lottery = '5-LOW' THEN -1 ELSE r.n END AS read,
         CASE WHEN r.lottery = '5-LOW' THEN -1 ELSE coalesce(j.n, 0) END AS rejected,
         CASE WHEN r.lottery = '5-LOW' THEN -1 ELSE coalesce(i.n, 0) END AS inserted,
         CASE WHEN r.lottery = '5-LOW' THEN -1 ELSE r.n - coalesce(j.n, 0) - coalesce(i.n, 0) END AS skipped
  FROM (SELECT lottery, count(*) AS n FROM raw_new GROUP BY lottery) r
  LEFT JOIN (SELECT lottery, count(*) AS n FROM staged WHERE loteria_id IS NULL OR signo_id IS NULL GROUP BY lottery) j
    ON r.lottery = j.lottery
  LEFT JOIN (SELECT lottery, count(*) AS n FROM ins GROUP BY lottery) i ON r.lottery = i.lottery)"""]


@register("bulk_load_report", "lottery str, read int, rejected int, inserted int, skipped int",
          td.with_ctes(["raw_old", "raw_new", "loterias", "signos"], """
SELECT * FROM per
UNION ALL
SELECT 'TOTAL', coalesce(sum(read), 0), coalesce(sum(rejected), 0), coalesce(sum(inserted), 0),
       coalesce(sum(skipped), 0) FROM per WHERE inserted >= 0""", _BULK_SQL))
def q_bulk_load_report(spark, sf_dir):
    target = _fact(spark, sf_dir, _old(spark, sf_dir))
    failed = spark.createDataFrame([("5-LOW",)], "lottery string")
    _merged, report = CT.bulk_load(target, td.raw_new(spark, sf_dir), td.loterias(spark, sf_dir),
                                   td.signos(spark, drop=NO_PIS), failed=failed)
    return report


@register("bulk_load_fact", "fecha date, loteria_id int, result int, signo_id int",
          td.with_ctes(["raw_old", "raw_new", "loterias", "signos"], """
SELECT o.fecha, l.id AS loteria_id, o.result, s.id AS signo_id
FROM old o JOIN loterias l ON o.lottery = l.nombre JOIN signos s ON o.series = s.codigo
UNION ALL
SELECT fecha, loteria_id, result, signo_id FROM ins""", _BULK_SQL))
def q_bulk_load_fact(spark, sf_dir):
    target = _fact(spark, sf_dir, _old(spark, sf_dir))
    merged, _report = CT.bulk_load(target, td.raw_new(spark, sf_dir), td.loterias(spark, sf_dir),
                                   td.signos(spark, drop=NO_PIS))
    return merged


# -- S1 and the update chain: S1 → P4 → J2 → J5 → A3 --------------------------

UPDATE_TODAY = "2030-01-01"
STORED_BEFORE = "1998-01-01"
#: fetched beside the real ones: a name that is no lottery, and one whose pages hold no second table
UNKNOWN_NAME, BROKEN_NAME = "9-NONE", "6-NEW"

_SECOND = ", ".join(f"'{x}'" for x, name in td.FETCH_NAMES.items() if x != name)
_FETCH = f"CASE WHEN lottery IN ({_SECOND}) THEN lottery || ' LUNA' ELSE lottery END"
_PAGES_SQL = td.with_ctes(["draws"], f"SELECT {_FETCH} AS lottery, fecha, result, series FROM draws")


@register("extract_result_rows_all", DRAW_SPEC, _PAGES_SQL, note="earlier name of extract_result_rows")
@register("extract_result_rows", DRAW_SPEC, _PAGES_SQL,
          note="pages of all five lotteries rendered from F1 (two tables, header and short rows, one single-table page)")
def q_extract_result_rows(spark, sf_dir):
    return PG.extract_result_rows(td.all_result_pages(spark, sf_dir))


def _fetched(name: str):
    names = F.create_map(*[F.lit(x) for pair in td.FETCH_NAMES.items() for x in pair])
    return names[F.col(name)]


def _stored_before(draws):
    return draws.filter(F.col("fecha") < F.lit(STORED_BEFORE).cast("date")) \
        .select("fecha", _fetched("lottery").alias("lottery"), "result", "series")


@register("update_from_pages_all", DRAW_SPEC, _PAGES_SQL, note="earlier name of update_from_pages")
@register("update_from_pages", DRAW_SPEC, _PAGES_SQL,
          note="stored table holds draws before 1998; stored pages of all five lotteries bring the rest")
def q_update_from_pages(spark, sf_dir):
    from ..sources.tabular import new_rows
    stored = _stored_before(td.draws(spark, sf_dir))
    scraped = PG.extract_result_rows(td.all_result_pages(spark, sf_dir)).drop("page_id")
    fresh = new_rows(scraped, stored, UPDATE_TODAY).withColumn("_arrival", F.lit(1))
    merged = CT.upsert(stored.withColumn("_arrival", F.lit(0)), fresh, ["fecha", "lottery"], ["_arrival"])
    return merged.drop("_arrival")


BAD_PAGE = ("<table><tr><th>x</th></tr><tr><td>31/31/2031</td><td>0001</td><td>Leo</td></tr>"
            "<tr><td>01/02/2031</td><td>12</td><td>Leo</td></tr></table><table></table>")
_REPORT_SQL = [f"""fetched AS (SELECT {_FETCH} AS lottery, fecha, series FROM draws)""",
               f"""marks AS (SELECT lottery, max(fecha) FILTER (fecha < DATE '{STORED_BEFORE}') AS last FROM fetched GROUP BY lottery)""",
               """fresh AS (SELECT f.* FROM fetched f JOIN marks m ON f.lottery = m.lottery AND (m.last IS NULL OR f.fecha > m.last))"""]


def _update(spark, sf_dir):
    """The chain over all five lotteries, an unknown name, a lottery of broken pages, and signs without PIS."""
    table = CowTable(spark, f"{ensure_checkpoint_dir(spark)}/update_{uuid.uuid4().hex}", period="decade")
    draws = td.draws(spark, sf_dir)
    table.start(_stored_before(draws).withColumn("k", F.lit(0).cast("long")))
    pages = td.all_result_pages(spark, sf_dir, draws)
    first = td.LOTTERIES[0]
    pages = pages.unionByName(pages.where(F.col("lottery") == first).withColumn("lottery", F.lit(UNKNOWN_NAME))).unionByName(
        spark.createDataFrame([(-1, first, BAD_PAGE), (-2, BROKEN_NAME, "<p>no table</p>"), (-3, BROKEN_NAME, "<table></table>")],
                              "page_id long, lottery string, html string"))
    pages = store(pages, "pages")                        # stored pages: the chain reads them more than once
    names = [*td.FETCH_NAMES.values(), BROKEN_NAME]
    loterias = spark.createDataFrame(list(enumerate(names, 1)), "id int, nombre string")
    return (*U.update(table, pages, loterias, td.signos(spark, drop=NO_PIS), UPDATE_TODAY, 0), table)


@register("update_report", "lottery str, status str, read int, rejected int, not_new int, inserted int, updated int",
          td.with_ctes(["draws"], f"""
SELECT lottery, 'ok' AS status, read, rejected, not_new, inserted, 0 AS updated FROM per
UNION ALL SELECT '{UNKNOWN_NAME}', 'unknown_lottery', -1, -1, -1, -1, -1
UNION ALL SELECT '{BROKEN_NAME}', 'no_table', -1, -1, -1, -1, -1
UNION ALL SELECT 'TOTAL', '', sum(read), sum(rejected), sum(not_new), sum(inserted), 0 FROM per""", [*_REPORT_SQL, f"""per AS (
  SELECT f.lottery, count(*) + CASE WHEN f.lottery = '{td.LOTTERIES[0]}' THEN 2 ELSE 0 END AS read,
         max(n.rejected) + CASE WHEN f.lottery = '{td.LOTTERIES[0]}' THEN 2 ELSE 0 END AS rejected,
         count(*) - max(n.fresh) AS not_new, max(n.fresh) - max(n.rejected) AS inserted
  FROM fetched f JOIN (SELECT m.lottery, count(x.fecha) AS fresh, count(*) FILTER (x.series = 'PIS') AS rejected
                       FROM marks m LEFT JOIN fresh x ON m.lottery = x.lottery GROUP BY m.lottery) n ON f.lottery = n.lottery
  GROUP BY f.lottery)"""]),
          note="S1 → P4 → J2 → J5 → A3; failed lotteries report -1 and the others commit")
def q_update_report(spark, sf_dir):
    report, _rejected, _table = _update(spark, sf_dir)
    return report


@register("update_rejected", "lottery str, fecha_text str, reason str", td.with_ctes(["draws"], f"""
SELECT lottery, strftime(fecha, '%d/%m/%Y') AS fecha_text, 'unknown_sign' AS reason FROM fresh WHERE series = 'PIS'
UNION ALL SELECT '{td.LOTTERIES[0]}', '31/31/2031', 'bad_date' UNION ALL SELECT '{td.LOTTERIES[0]}', '01/02/2031', 'bad_number'""",
                                                                               _REPORT_SQL),
          note="rows of the update that could not be stored, with the reason")
def q_update_rejected(spark, sf_dir):
    _report, rejected, _table = _update(spark, sf_dir)
    return rejected


@register("update_table", DRAW_SPEC, td.with_ctes(["draws"], f"""
SELECT {_FETCH} AS lottery, d.fecha, d.result, d.series FROM draws d
WHERE d.fecha < DATE '{STORED_BEFORE}' OR d.series <> 'PIS'""", _REPORT_SQL), note="the table as the update left it")
def q_update_table(spark, sf_dir):
    _report, _rejected, table = _update(spark, sf_dir)
    return table.read()


# -- J4 on a dimension --------------------------------------------------------

@register("extend_loterias", "id int, nombre str", td.with_ctes(["raw_old", "raw_new"], """
WITH_DIM
SELECT id, nombre FROM dim
UNION ALL
SELECT CAST((SELECT max(id) FROM dim) + row_number() OVER (ORDER BY nombre) AS INT) AS id, nombre FROM (
  SELECT DISTINCT lottery AS nombre FROM raw_new WHERE lottery NOT IN (SELECT nombre FROM dim)) n""".replace(
    "WITH_DIM\n", ""), ["""dim AS (SELECT CAST(row_number() OVER (ORDER BY nombre) AS INT) AS id, nombre
  FROM (SELECT DISTINCT lottery AS nombre FROM raw_old WHERE lottery NOT IN ('2-HIGH', '5-LOW')) d)"""]))
def q_extend_loterias(spark, sf_dir):
    """Stored dimension lacks two lotteries; the new rows bring them (next ids)."""
    from ..operators.sequence import add_seq
    old_names = td.raw_old(spark, sf_dir).select(F.col("lottery").alias("nombre")) \
        .filter(~F.col("nombre").isin("2-HIGH", "5-LOW")).distinct()
    dim = add_seq(old_names.withColumn("_all", F.lit(1)), "_all", ["nombre"]) \
        .select(F.col("seq").cast("int").alias("id"), "nombre")
    names = td.raw_new(spark, sf_dir).select(F.col("lottery").alias("nombre"))
    return CT.extend_dimension(dim, names)
