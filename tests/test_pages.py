"""S1 page rules on hand-made pages."""

from drawseries.plans.registry import spark_query
from drawseries.sources import testdata as td
from drawseries.sources.pages import extract_result_rows

from .conftest import SF_SMALL

T0 = ("<table><tr><th>Fecha</th><th>N</th><th>S</th></tr>"
      "<tr><td>05/01/2024</td><td><b>0123</b></td><td> Géminis </td></tr>"
      "<tr><td>06/01/2024</td><td>12-34</td></tr>"                       # short row: skipped
      "<tr><td>n/a</td><td>5555</td><td>Leo</td></tr>"                    # bad date: dropped
      "<tr><td>2024-01-07</td><td>123</td><td>Leo</td></tr></table>")     # 3 digits: dropped
T1 = ("<TABLE class='x'><tr><td>h</td><td>h</td><td>h</td></tr>"
      "<tr><td>08-01-2024</td><td>9&nbsp;876</td><td>OFIUCO</td></tr></TABLE>")


def test_page_rules(spark):
    pages = spark.createDataFrame(
        [(1, "SOL", T0 + T1), (1, "noche luna", T0 + T1), (2, "SOL", T0)],
        "page_id bigint, lottery string, html string")
    rows = {(r.page_id, r.lottery, str(r.fecha), r.result, r.series)
            for r in extract_result_rows(pages).collect()}
    assert rows == {(1, "SOL", "2024-01-05", 123, "GEM"),
                    (1, "noche luna", "2024-01-08", 9876, "OFIUCO")}


def test_all_lotteries_pass_the_pages(spark):
    name = {v: k for k, v in td.FETCH_NAMES.items()}
    want = sorted((r.lottery, str(r.fecha), r.result, r.series) for r in td.draws(spark, SF_SMALL).collect())
    assert {x[0] for x in want} == set(td.LOTTERIES)
    for query in ("extract_result_rows_all", "update_from_pages_all"):
        got = spark_query(query)(spark, SF_SMALL).collect()
        assert sorted((name[r.lottery], str(r.fecha), r.result, r.series) for r in got) == want


def test_rows_without_cells_are_skipped_wherever_the_text_is_filtered(spark):
    """A header of ``th`` cells, a row of no cells and one of one cell yield nothing and end no query."""
    table = ("<table><tr><th>Fecha</th><th>N</th><th>S</th></tr><tr></tr><tr><td>05/01/2024</td></tr>"
             "<tr><td>06/01/2024</td><td>0456</td><td>Leo</td></tr></table>")
    pages = spark.createDataFrame([(1, "SOL", table * 2), (2, "SOL", "<table></table>" * 2), (3, "LUNA", "<table><tr></tr></table>" * 2)],
                                  "page_id bigint, lottery string, html string")
    rows = extract_result_rows(pages)
    assert [(r.page_id, str(r.fecha), r.result, r.series) for r in rows.where("result > 0 and series <> ''").collect()] \
        == [(1, "2024-01-06", 456, "LEO")]
    assert rows.where("fecha > date'2024-01-01'").count() == 1
