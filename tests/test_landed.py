"""Lines of bars and fund flow: what is read of them, and how often."""

from datetime import date

from tidebars.sources import landed

LINES = [("7", 1, "2024-01-02,1,2,3,0.5,100,inf,-,nan, 4 ,1e1"), ("7", 2, "2024-01-02,1,2.5,3,0.5,100,-,-Infinity,x,,0.25"), ("7", 1, "2024-01-03,1,2,3,0.5,100,1,1,1,1"), ("8", 1, "-,1,2,3,0.5,100,1,1,1,1,1"), ("9", 1, "2024-01-02,1,-,3,0.5,100,1,1,1,1,1")]


def test_fields_that_are_no_number_are_null(spark):
    rows = landed.ingest_csv_bars(spark.createDataFrame(LINES[:1] + LINES[2:], "code string, seq int, line string")).collect()
    assert [(r["code"], r["date"]) for r in rows] == [("000007", date(2024, 1, 2))]
    assert [rows[0][c] for c in ("amount", "amplitude", "pct_chg", "chg", "turnover")] == [float("inf"), None, None, 4.0, 10.0]


def test_the_last_line_of_a_day_counts(spark):
    rows = landed.ingest_csv_bars(spark.createDataFrame(LINES, "code string, seq int, line string")).collect()
    assert [(r["close"], r["amount"], r["amplitude"], r["pct_chg"], r["chg"], r["turnover"]) for r in rows] == [(2.5, None, float("-inf"), None, None, 0.25)]


def test_a_line_is_cut_up_once(spark):
    lines = spark.range(10).selectExpr("cast(id as string) AS code", "1 AS seq", "concat_ws(',', '2024-01-02', '1', '2', cast(id as string)) AS line")
    for ingest in (landed.ingest_csv_bars, landed.ingest_fund_flow):
        plan = ingest(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
