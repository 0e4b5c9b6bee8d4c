"""The update chain: stored pages to a keyed table, with a report (S1 → P4 → J2 → J5 → A3).

Lotteries fail alone.  One whose name is no member of the dimension, or of whose pages
none can be read, is reported with a status and -1 for its counts, and nothing of it is
written; all others are committed together.  Rows that cannot be stored are kept, with
the reason.  All lotteries go through one plan; their rows are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from ..sources.cow import CowTable
from ..sources.pages import page_counts, parsed_rows, result_cells
from ..sources.tabular import new_rows

COUNTS = ("read", "rejected", "not_new", "inserted", "updated", "stale")


def lottery_status(pages: DataFrame, loterias: DataFrame) -> DataFrame:
    """(lottery, pages, status): ok, unknown_lottery or no_table for every lottery that pages were fetched for."""
    known = loterias.select(F.upper(F.trim("nombre")).alias("_name")).distinct()
    counts = page_counts(pages)
    j = counts.join(known, F.upper(F.trim(counts["lottery"])) == known["_name"], "left")
    return j.select("lottery", "pages", F.when(F.col("_name").isNull(), "unknown_lottery")
                    .when(F.col("readable") == 0, "no_table").otherwise("ok").alias("status"))


def update(table: CowTable, pages: DataFrame, loterias: DataFrame, signos: DataFrame, today: str,
           batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Brings the pages' new draws into ``table``; (report, rejected rows).

    Report: one row a lottery and TOTAL over the lotteries that did not fail.  ``not_new``
    counts rows that the watermark leaves out (P4).  A page row's order of arrival is its
    page's id.  A batch that was committed before is reported with no changes.
    """
    status = store(lottery_status(pages, loterias), "status")
    alive = status.where("status = 'ok'").select("lottery")
    codes = signos.select(F.col("codigo").alias("_code"))
    rows = parsed_rows(result_cells(pages)).join(alive, "lottery")
    rows = rows.join(codes, rows["series"] == codes["_code"], "left")
    reason = (F.when(F.col("fecha").isNull(), "bad_date").when(F.col("result").isNull(), "bad_number")
              .when(F.col("_code").isNull(), "unknown_sign"))
    rows = rows.select("page_id", "lottery", "fecha_text", "number_text", "sign_text", "fecha", "result", "series",
                       reason.alias("reason"))
    # pages are parsed once; what follows reads the rows
    rows = store(rows, "page-rows")
    dated = rows.where("fecha is not null")
    fresh = store(new_rows(dated, table.read(), today), "fresh")
    good = fresh.where("reason is null").select("fecha", "lottery", "result", "series", F.col("page_id").alias(table.order))
    rejected = rows.where("fecha is null").unionByName(fresh.where("reason is not null"))
    outcome: list[DataFrame] = []
    table.merge(good, batch_id, outcome)

    events = rows.select("lottery", F.lit("read").alias("what")).unionByName(
        rejected.select("lottery", F.lit("rejected").alias("what")))
    for rows_written in outcome:
        events = events.unionByName(rows_written.select("lottery", "what"))
    counts = events.groupBy("lottery").agg(*[F.count(F.when(F.col("what") == w, 1)).alias(w) for w in COUNTS if w != "not_new"])
    # dated rows that the watermark left out
    kept = fresh.groupBy("lottery").agg(F.count(F.lit(1)).alias("_fresh"))
    seen = dated.groupBy("lottery").agg(F.count(F.lit(1)).alias("_dated"))
    left_out = seen.join(kept, "lottery", "left").select("lottery", (F.col("_dated") - F.coalesce("_fresh", F.lit(0))).alias("not_new"))
    per = store(status.join(counts, "lottery", "left").join(left_out, "lottery", "left").select(
        "lottery", "status", "pages", *[F.when(F.col("status") == "ok", F.coalesce(c, F.lit(0))).otherwise(-1).cast("long").alias(c)
                                        for c in COUNTS]), "report")
    total = per.where("status = 'ok'").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"),
                                           *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    report = per.unionByName(total.select(F.lit("TOTAL").alias("lottery"), F.lit("").alias("status"), "pages", *COUNTS))
    return report, rejected.select("page_id", "lottery", "fecha_text", "number_text", "sign_text",
                                   "reason")
