"""Draw-shaped inputs derived from the driver's TPC-H-like tables.

Every function here reads the given parquet tables and derives a draw table
from them, so its work grows with the data.  Each Spark derivation has a SQL
twin (``SQL_CTES``) that DuckDB and Spark SQL both run unchanged; oracle
queries are built from these CTEs with :func:`with_ctes`.

Conventions shared by both engines: ``floor()`` before integer casts, ties
broken by ``o_orderkey``, DATE only through an explicit cast, session time
zone UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sequence import add_seq
from ..session import checkpoint

# Sign dimension, code -> display name (zodiac order).
SIGN_NAMES = [
    ("ARI", "Aries"), ("TAU", "Tauro"), ("GEM", "Géminis"), ("CAN", "Cáncer"),
    ("LEO", "Leo"), ("VIR", "Virgo"), ("LIB", "Libra"), ("ESC", "Escorpio"),
    ("SAG", "Sagitario"), ("CAP", "Capricornio"), ("ACU", "Acuario"), ("PIS", "Piscis"),
]

# a customer key picks a code by its place in this row of codes
SIGN_STRIP = "".join(code for code, _ in SIGN_NAMES)

LOTTERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# F1 keeps one draw per (date, lottery).  Every thousand customers draw in an era
# of their own, later than the last one's, so that the series grow with the orders.
ERA_CUSTOMERS, ERA_DAYS = 1000, 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- F1 / F2 --

def raw_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per order, duplicates on (fecha, lottery); ``k`` = arrival."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.date_add(F.col("o_orderdate").cast("date"), (F.floor(F.col("o_custkey") / ERA_CUSTOMERS) * ERA_DAYS).cast("int"))
        .alias("fecha"),
        F.col("o_orderpriority").alias("lottery"),
        (F.floor("o_totalprice").cast("bigint") % 10000).cast("int").alias("result"),
        F.substring(F.lit(SIGN_STRIP), (F.col("o_custkey") % 12 * 3 + 1).cast("int"),
                    F.lit(3)).alias("series"),
        F.col("o_orderkey").alias("k"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one draw per (fecha, lottery) — the last arrival wins — plus ``seq``."""
    raw = raw_draws(spark, sf_dir)
    dedup = raw.groupBy("fecha", "lottery").agg(
        F.max_by("result", "k").alias("result"),
        F.max_by("series", "k").alias("series"),
    )
    # several branches of a query read the draws: write them once (shared
    # checkpoint folder) instead of re-deriving them from orders per branch
    return checkpoint(add_seq(dedup, "lottery", ["fecha"]))


#: What each digit adds with every second draw, and in odd draws.
RULE = {1000: (3, 2), 100: (7, 5), 10: (1, 4), 1: (9, 8)}


def ruled_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the draws of F1 with numbers and signs that follow from the draw before last.

    Each digit is that of two draws before plus a fixed step (mod 10), the sign follows
    from the units digit: a rule that the as-of features determine, so a right fit finds it.
    """
    half, odd = F.floor((F.col("seq") / 2).cast("double")), F.col("seq") % 2
    digit = {p: (half * step + odd * more + F.length("lottery")) % 10 for p, (step, more) in RULE.items()}
    result = sum(d * p for p, d in digit.items())
    return draws(spark, sf_dir).select(
        "fecha", "lottery", result.cast("int").alias("result"),
        F.substring(F.lit(SIGN_STRIP), (3 * digit[1] + 1).cast("int"), F.lit(3)).alias("series"), "seq")


_STORED: dict[tuple[str, str], str] = {}


def stored_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 as a stored table: Parquet partitioned by lottery, written once per
    session into the shared checkpoint folder.  Reads of it get partition
    pruning on ``lottery`` and Parquet pushdown on the other columns."""
    from ..session import ensure_checkpoint_dir
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/stored_draws_{abs(hash(sf_dir))}_{len(_STORED)}"
        draws(spark, sf_dir).write.mode("overwrite").partitionBy("lottery").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def raw_old(spark, sf_dir):
    return raw_draws(spark, sf_dir).filter(F.col("k") % 3 != 0)


def raw_new(spark, sf_dir):
    return raw_draws(spark, sf_dir).filter(F.col("k") % 3 == 0)


# ---------------------------------------------------------------------- F3 --

def loterias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lottery dimension: ids 1..n over the sorted distinct names.

    The distinct set is tiny (one row per series) so the global ordering
    runs on a handful of rows after a partial+final distinct aggregation.
    """
    names = raw_draws(spark, sf_dir).select(F.col("lottery").alias("nombre")).distinct()
    return add_seq(names.withColumn("_all", F.lit(1)), "_all", ["nombre"]) \
        .select(F.col("seq").cast("int").alias("id"), "nombre")


def signos(spark: SparkSession, drop: tuple[str, ...] = ()) -> DataFrame:
    """Sign dimension: the 12 codes in alphabetical order with ids 1..12 (``drop`` removes rows, ids stay)."""
    names = dict(SIGN_NAMES)
    rows = [(i + 1, c, names[c]) for i, c in enumerate(sorted(names)) if c not in drop]
    return spark.createDataFrame(rows, "id int, codigo string, nombre string")


# ---------------------------------------------------------------------- F4 --

def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the events table as long series, one per event type, ordered by ts."""
    e = table(spark, sf_dir, "events")
    base = e.select(
        F.col("event_type").alias("lottery"),
        F.col("ts"),
        F.col("event_id"),
        F.col("ts").cast("date").alias("fecha"),
        (F.floor(F.col("value") * 100).cast("bigint") % 10000).cast("int").alias("result"),
    )
    return add_seq(base, "lottery", ["ts", "event_id"])


# --------------------------------------------------------------------- F11 --

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every line item as one single series (the fully skewed case: one
    key holds all rows), in ship-date order with a unique tie-break."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.lit("ALL").alias("lottery"), *LINE_ORDER,
        F.col("l_shipdate").cast("date").alias("fecha"),
        (F.floor("l_extendedprice").cast("bigint") % 10000).cast("int").alias("result"))
    return add_seq(base, "lottery", LINE_ORDER)


# ---------------------------------------------------------------------- F5 --

def digit_long(df: DataFrame, value: str = "result") -> DataFrame:
    """(…, position 0..3, digit): thousands, hundreds, tens, units."""
    return df.select("*", F.posexplode(F.array(
        *[(F.col(value) / p).cast("bigint") % 10 for p in (1000, 100, 10, 1)]
    )).alias("position", "digit"))


def digit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per (lottery, position, digit) the share of draws with that digit."""
    d = digit_long(draws(spark, sf_dir).select("lottery", "result"))
    counts = d.groupBy("lottery", "position", "digit").agg(F.count("*").alias("n"))
    totals = d.groupBy("lottery", "position").agg(F.count("*").alias("total"))
    return counts.join(totals, ["lottery", "position"]).select(
        "lottery", "position", "digit", (F.col("n") / F.col("total")).alias("score"))


# ---------------------------------------------------------------------- F6 --

def dirty_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the raw rows rendered as messy text, cycling formats over ``k``."""
    r = raw_draws(spark, sf_dir)
    k = F.col("k")
    names = F.create_map(*[x for c, n in SIGN_NAMES for x in (F.lit(c), F.lit(n))])
    padded = F.lpad(F.col("result").cast("string"), 4, "0")
    fecha = (F.when(k % 4 == 0, F.date_format("fecha", "yyyy-MM-dd"))
             .when(k % 4 == 1, F.date_format("fecha", "dd/MM/yyyy"))
             .when(k % 4 == 2, F.date_format("fecha", "dd-MM-yyyy"))
             .otherwise(F.lit("n/a")))
    numero = F.when(k % 7 == 0, F.concat(F.substring(padded, 1, 2), F.lit("-"), F.substring(padded, 3, 1))) \
        .otherwise(F.concat(F.substring(padded, 1, 2), F.lit("-"), F.substring(padded, 3, 2)))
    signo = F.when(k % 11 == 0, F.lit("OFIUCO")).otherwise(
        F.concat(F.lit(" "), names[F.col("series")], F.lit(" ")))
    lottery = F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("  "), F.lower("lottery"), F.lit(" ")))
    return r.select(k, fecha.alias("fecha"), lottery.alias("lottery"),
                    numero.alias("result"), signo.alias("series"))


# ---------------------------------------------------------------------- F7 --

PAGE_LOTTERIES = ("1-URGENT", "2-HIGH")      # table 0, table 1 of every page
SECOND_TABLE_NAME = "2-HIGH LUNA"            # fetch name that selects table 1


def result_pages(spark: SparkSession, sf_dir: str, pair: tuple[str, ...] = PAGE_LOTTERIES,
                 second_name: str = SECOND_TABLE_NAME, made: DataFrame | None = None) -> DataFrame:
    """HTML pages rendered from F1, one per month, two tables per page.

    Returns ``(page_id, lottery, html)``: every page is listed once per
    lottery it is fetched for (``1-URGENT`` reads table 0, ``2-HIGH LUNA``
    reads table 1).  Each table has a header row and one short row; one
    extra page carries a single table and must yield nothing.  ``made``: F1, if there already.
    """
    d = (draws(spark, sf_dir) if made is None else made).filter(F.col("lottery").isin(*pair))
    names = F.create_map(*[x for c, n in SIGN_NAMES for x in (F.lit(c), F.lit(n))])
    rows = d.select(
        F.date_format("fecha", "yyyy-MM").alias("month"), "lottery",
        F.concat(F.lit("<tr><td>"), F.date_format("fecha", "dd/MM/yyyy"),
                 F.lit("</td><td> "), F.lpad(F.col("result").cast("string"), 4, "0"),
                 F.lit(" </td><td>"), names[F.col("series")], F.lit("</td></tr>")).alias("tr"))
    # a month holds at most 31 draws per lottery, so each page group is bounded
    tables = rows.groupBy("month").agg(*[
        F.concat_ws("", F.sort_array(F.collect_list(
            F.when(F.col("lottery") == name, F.col("tr"))))).alias(f"t{i}")
        for i, name in enumerate(pair)])
    head = "<table class=\"r\"><tr><th>Fecha</th><th>Numero</th><th>Signo</th></tr>"
    short = "<tr><td>01/01/1990</td><td>0000</td></tr></table>"
    pages = tables.select(
        F.unix_date(F.to_date(F.concat(F.col("month"), F.lit("-01")))).cast("bigint").alias("page_id"),
        F.concat(F.lit("<html><body><h1>Resultados "), F.col("month"), F.lit("</h1>"),
                 F.lit(head), F.col("t0"), F.lit(short),
                 F.lit(head), F.col("t1") if len(pair) > 1 else F.lit(""), F.lit(short),
                 F.lit("</body></html>")).alias("html"))
    single = spark.createDataFrame(
        [(0, "<html><body>" + head + "<tr><td>02/02/1990</td><td>4321</td><td>Leo</td></tr>"
          "</table></body></html>")], "page_id bigint, html string")
    all_pages = pages.unionByName(single)
    fetch = F.explode(F.array(F.lit(pair[0]), *[F.lit(second_name)][:len(pair) - 1]))
    return all_pages.select("page_id", fetch.alias("lottery"), "html")


#: Lotteries of the pages of each kind: table 0, table 1; the last kind's second table is empty.
PAGE_PAIRS = [tuple(LOTTERIES[i:i + 2]) for i in range(0, len(LOTTERIES), 2)]
#: Fetch names of all lotteries: those of a second table carry the marker.
FETCH_NAMES = {name: name if i == 0 else f"{name} LUNA" for pair in PAGE_PAIRS for i, name in enumerate(pair)}


def all_result_pages(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """F7 for all lotteries: pages of two lotteries each, as ``result_pages`` renders them.  ``made``: F1, if there already."""
    pages = [result_pages(spark, sf_dir, pair, FETCH_NAMES[pair[-1]], made) for pair in PAGE_PAIRS]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------------- F9 --

HOT_RUN = 7


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """training-attempt history; a third of all attempts are of one run, the others
    of 20 runs for every thousand customers."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    run = F.when(k % 3 == 0, F.lit(HOT_RUN)).otherwise(
        F.col("o_custkey") % 20 + 20 * F.floor(F.col("o_custkey") / 1000)).cast("int")
    flat = F.lit(0.5) + (k % 2) / F.lit(1000.0)
    racc = (F.floor("o_totalprice") % 1000) / F.lit(1000.0)
    sacc = ((k * 7919) % 1000) / F.lit(1000.0)
    is_flat = run < 5
    no_f1 = k % 13 == 0
    base = o.select(
        run.alias("run_id"),
        F.element_at(F.array(*[F.lit(x) for x in LOTTERIES]), run % 5 + 1).alias("lottery"),
        k.alias("k"),
        F.when(is_flat, flat).otherwise(racc).alias("result_acc"),
        F.when(is_flat, flat).otherwise(sacc).alias("series_acc"),
        F.when(no_f1, F.lit(None)).otherwise(((k * 31) % 1000) / F.lit(1000.0)).alias("result_f1"),
        F.when(no_f1, F.lit(None)).otherwise(((k * 17) % 1000) / F.lit(1000.0)).alias("series_f1"),
        F.col("o_orderdate").alias("ts"),
    )
    return add_seq(base, "run_id", ["k"]).withColumnRenamed("seq", "attempt")


# ------------------------------------------------------------ SQL twins --

SQL_CTES: dict[str, str] = {
    "raw": f"""raw AS (
  SELECT CAST(o_orderdate AS DATE) + CAST(floor(o_custkey / {ERA_CUSTOMERS}.0) * {ERA_DAYS} AS INT) AS fecha,
         o_orderpriority AS lottery,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS INT) AS result,
         substr('{SIGN_STRIP}', CAST(3 * (o_custkey % 12) + 1 AS INT), 3) AS series,
         o_orderkey AS k
  FROM orders)""",
    "draws": """draws AS (
  SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY fecha) AS seq
  FROM (SELECT fecha, lottery, max_by(result, k) AS result, max_by(series, k) AS series
        FROM raw GROUP BY fecha, lottery) d0)""",
    "ruled": "ruled AS (SELECT fecha, lottery, CAST(" + " + ".join(
        f"{p} * ((floor(seq / 2.0) * {step} + seq % 2 * {more} + length(lottery)) % 10)" for p, (step, more) in RULE.items())
        + f""" AS INT) AS result, substr('{SIGN_STRIP}', CAST(3 * ((floor(seq / 2.0) * {RULE[1][0]} + seq % 2 * {RULE[1][1]}
  + length(lottery)) % 10) + 1 AS INT), 3) AS series, seq FROM draws)""",
    "raw_old": "raw_old AS (SELECT * FROM raw WHERE k % 3 <> 0)",
    "raw_new": "raw_new AS (SELECT * FROM raw WHERE k % 3 = 0)",
    "loterias": """loterias AS (
  SELECT CAST(row_number() OVER (ORDER BY nombre) AS INT) AS id, nombre
  FROM (SELECT DISTINCT lottery AS nombre FROM raw) l0)""",
    "signos": "signos AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i + 1}, '{c}', '{n}')" for i, (c, n) in enumerate(sorted(SIGN_NAMES))
    ) + ") AS s(id, codigo, nombre))",
    "event_series": """event_series AS (
  SELECT event_type AS lottery, ts, event_id, CAST(ts AS DATE) AS fecha,
         CAST(CAST(floor(value * 100) AS BIGINT) % 10000 AS INT) AS result,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq
  FROM events)""",
    "line_series": """line_series AS (
  SELECT 'ALL' AS lottery, CAST(l_shipdate AS DATE) AS fecha,
         CAST(CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS INT) AS result,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
  FROM lineitem)""",
    "pairs": """pairs AS (
  SELECT * FROM (
    SELECT lottery, fecha, seq, result AS real, series AS real_series,
           lag(result) OVER (PARTITION BY lottery ORDER BY seq) AS pred,
           lag(series) OVER (PARTITION BY lottery ORDER BY seq) AS pred_series
    FROM draws) p0 WHERE pred IS NOT NULL)""",
    "digits_long": """digits_long AS (
  SELECT lottery, seq, result, pos.position,
         CAST((CAST(floor(result / pos.p) AS BIGINT)) % 10 AS BIGINT) AS digit
  FROM draws, (VALUES (0, 1000), (1, 100), (2, 10), (3, 1)) AS pos(position, p))""",
    "digit_scores": """digit_scores AS (
  SELECT c.lottery, c.position, c.digit, CAST(c.n AS DOUBLE) / t.total AS score
  FROM (SELECT lottery, position, digit, count(*) AS n FROM digits_long GROUP BY lottery, position, digit) c
  JOIN (SELECT lottery, position, count(*) AS total FROM digits_long GROUP BY lottery, position) t
    ON c.lottery = t.lottery AND c.position = t.position)""",
    "history": f"""history AS (
  SELECT run_id, lottery, k, result_acc, series_acc, result_f1, series_f1, ts,
         row_number() OVER (PARTITION BY run_id ORDER BY k) AS attempt
  FROM (
    SELECT run_id, ({'[' + ', '.join(repr(x) for x in LOTTERIES) + ']'})[run_id % 5 + 1] AS lottery,
           o_orderkey AS k,
           CASE WHEN run_id < 5 THEN 0.5 + CAST(o_orderkey % 2 AS DOUBLE) / 1000.0
                ELSE CAST(floor(o_totalprice) % 1000 AS DOUBLE) / 1000.0 END AS result_acc,
           CASE WHEN run_id < 5 THEN 0.5 + CAST(o_orderkey % 2 AS DOUBLE) / 1000.0
                ELSE CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 END AS series_acc,
           CASE WHEN o_orderkey % 13 = 0 THEN NULL
                ELSE CAST((o_orderkey * 31) % 1000 AS DOUBLE) / 1000.0 END AS result_f1,
           CASE WHEN o_orderkey % 13 = 0 THEN NULL
                ELSE CAST((o_orderkey * 17) % 1000 AS DOUBLE) / 1000.0 END AS series_f1,
           o_orderdate AS ts
    FROM (SELECT *, CAST(CASE WHEN o_orderkey % 3 = 0 THEN {HOT_RUN}
                              ELSE o_custkey % 20 + 20 * floor(o_custkey / 1000.0) END AS INT) AS run_id FROM orders) o) h0)""",
}

# CTE -> CTEs it reads
_DEPS = {
    "draws": ["raw"], "ruled": ["draws"], "raw_old": ["raw"], "raw_new": ["raw"], "loterias": ["raw"],
    "pairs": ["draws"], "digits_long": ["draws"], "digit_scores": ["digits_long"],
}


def with_ctes(names: list[str] | tuple[str, ...], body: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named fixture CTEs (and their inputs), then ``body``.

    ``extra`` are further ``name AS (...)`` CTE texts appended after the fixtures.
    """
    order: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [SQL_CTES[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body
