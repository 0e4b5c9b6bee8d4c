"""Draw rows from stored result pages.

Input ``(page_id, lottery, html)``: one row per page and the lottery the page
was fetched for.  A page needs at least two ``<table>`` elements; lotteries
whose name contains ``LUNA`` read the second table, all others the first.
The header row is skipped, rows with fewer than three cells are skipped,
then date (P6), number (P8) and sign (P7) are parsed; rows whose date or
number does not parse are dropped.

Everything is a per-row expression (regex extraction + ``posexplode``), so
pages are parsed where they are stored, in parallel, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import normalise_sign, parse_fecha, parse_number

# The marker that selects the second table.
SECOND_TABLE_MARKER = "LUNA"

_TABLE = r"(?is)<table\b[^>]*>(.*?)</table>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
_CELL = r"(?is)<td\b[^>]*>(.*?)</td>"


def _text(c):
    """Cell text: tags removed, common entities decoded, whitespace trimmed."""
    no_tags = F.regexp_replace(c, r"<[^>]+>", "")
    decoded = F.replace(F.replace(no_tags, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(decoded)


def _tables():
    return F.regexp_extract_all(F.col("html"), F.lit(_TABLE), 1)


def page_counts(pages: DataFrame) -> DataFrame:
    """(lottery, pages, readable): how many pages were fetched for a lottery and how many have the two tables."""
    return pages.groupBy("lottery").agg(F.count(F.lit(1)).alias("pages"),
                                        F.count(F.when(F.size(_tables()) >= 2, 1)).alias("readable"))


def result_cells(pages: DataFrame) -> DataFrame:
    """(page_id, lottery, fecha_text, number_text, sign_text): the rows of three cells and more, as text."""
    idx = F.when(F.upper(F.col("lottery")).contains(SECOND_TABLE_MARKER), 1).otherwise(0)
    picked = pages.select("page_id", "lottery", _tables().alias("_tables"), idx.alias("_idx")) \
        .filter(F.size("_tables") >= 2) \
        .select("page_id", "lottery", F.get("_tables", F.col("_idx")).alias("_table"))
    rows = picked.select("page_id", "lottery", F.posexplode(
        F.regexp_extract_all(F.col("_table"), F.lit(_ROW), 1)).alias("_pos", "_row")) \
        .filter(F.col("_pos") > 0)
    cells = rows.select("page_id", "lottery",
                        F.regexp_extract_all(F.col("_row"), F.lit(_CELL), 1).alias("_cells")) \
        .filter(F.size("_cells") >= 3)
    # a filter on the text may be evaluated before the one on the size, on rows of no cells: ``get`` gives them null
    return cells.select("page_id", "lottery", *[_text(F.get("_cells", F.lit(i))).alias(name) for i, name in enumerate(
        ("fecha_text", "number_text", "sign_text"))])


def parsed_rows(cells: DataFrame) -> DataFrame:
    """``cells`` with fecha, result and series; null where the text does not parse."""
    return cells.select("*", parse_fecha(F.col("fecha_text")).alias("fecha"), parse_number(F.col("number_text")).alias("result"),
                        normalise_sign(F.col("sign_text")).alias("series"))


def extract_result_rows(pages: DataFrame) -> DataFrame:
    parsed = parsed_rows(result_cells(pages)).select("page_id", "fecha", "lottery", "result", "series")
    return parsed.filter(F.col("fecha").isNotNull() & F.col("result").isNotNull())
