from pyspark.sql import functions as F

from pageline import schemas
from pageline.operators import masthead


def test_masthead(spark):
    pages = {
        "a": ["SATURDAY", "Smarch 13, 2025", "September 13, 2025", "DELHI", "CITY EDITION 12 pages"],
        "b": ["nothing here", "REGD. NO 12", "EDITION"],
        "c": ["CHENNAI", "City Edition", "May 1,2025"],
    }
    df = spark.createDataFrame([(k, i, t) for k, v in pages.items() for i, t in enumerate(v, 1)], "edition_file string, line_no int, text string")
    got = {r.edition_file: (r.edition, r.date) for r in masthead.parse_masthead(df).collect()}
    assert got == {"a": ("delhi", "2025-09-13"), "b": (None, None), "c": ("chennai", "2025-05-01")}


def test_prompt_rows_and_viewport(spark):
    rows = [(1, 1, "hello world", "x", (0.0, 1.0, 2.0, 3.0), ("S", 9.0, False, False, False), 0, 0, (False, False, False)), (1, 2, "D", "D", (0.0, 1.0, 2.0, 3.0), ("S", 37.0, False, False, False), 0, 0, (True, True, False))]
    df = spark.createDataFrame(rows, schemas.LINE)
    modal = spark.createDataFrame([(1, 9.0)], "page_num int, modal_size double")
    assert masthead.prompt(df, modal).first().prompt == "PAGE 1 | modal_body_font_size=9.0pt | 2 lines\nL0001|9.0|-|hello world\nL0002|37.0|D|D"
    box = df.limit(1).select(masthead.viewport_box(F.struct(F.lit(265.75).alias("x0"), F.lit(336.303).alias("top"), F.lit(834.55).alias("x1"), F.lit(378.147).alias("bottom")), F.lit(1530.71), F.lit(1.0)).alias("b")).first().b
    assert [round(v, 3) for v in box] == [265.75, 336.303, 568.8, 41.844]


def test_prompts_need_no_exchange_of_lines(spark, sf_dir):
    """A page's lines stood together, were written one by one, exchanged and sorted together again."""
    from pageline.plans import pages

    plan = pages.page_prompts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
