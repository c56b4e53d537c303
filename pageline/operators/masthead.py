"""What a first page says of itself, the dumps that annotators are given, and boxes in a viewer's coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.functions.text import is_alpha, is_upper

#: Fixed value: how a date is written.
DATE = r"\b([A-Z][a-z]+ [0-9]{1,2},\s*[0-9]{4})\b"


def parse_masthead(lines: DataFrame, keys: Sequence[str] = ("edition_file",)) -> DataFrame:
    """edition and date of each first page (keys, line_no, text); null where the page doesn't say.

    Each line's first date counts if it is one (the first line whose first date is valid tells the day); a name is an upper-case word of 2 to 20 letters just above a line that says EDITION.
    """
    said = F.regexp_replace(F.regexp_extract("text", DATE, 1), r",\s*", ", ")
    date = F.date_format(F.try_to_timestamp(said, F.lit("MMMM d, yyyy")), "yyyy-MM-dd")
    after = F.lead("text").over(Window.partitionBy(*keys).orderBy("line_no"))
    name = is_alpha(F.col("text")) & is_upper(F.col("text")) & F.length("text").between(2, 20) & F.upper("_after").contains("EDITION")
    rows = lines.withColumns({"_after": after, "_date": F.when(said != "", date)})
    rows = rows.withColumn("_name", F.when(F.coalesce(name, F.lit(False)), F.lower("text")))
    return rows.groupBy(*keys).agg(
        F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("line_no"))).alias("edition"),
        F.min_by("_date", F.when(F.col("_date").isNotNull(), F.col("line_no"))).alias("date"),
    )


def prompt_row(line: Column) -> Column:
    """The row that an annotator sees of a line: number, size, D for a drop cap, the text as it stands."""
    cap = line["flags"]["single_glyph"] & line["flags"]["size_outlier"]
    return F.concat_ws("|", F.format_string("L%04d", line["line_no"]), F.format_string("%.1f", line["font_profile"]["size"]), F.when(cap, "D").otherwise("-"), F.coalesce(line["text"], F.lit("")))


def prompt_rows(lines: DataFrame) -> DataFrame:
    """``lines`` with the row that an annotator sees of each."""
    return lines.withColumn("prompt_row", prompt_row(F.struct("line_no", "text", "font_profile", "flags")))


def _prompt_of(rows: Column, number: Column, modal: Column) -> Column:
    head = F.format_string("PAGE %s | modal_body_font_size=%.1fpt | %d lines\n", number.cast("string"), F.coalesce(modal, F.lit(0.0)), F.size(rows))
    return F.concat(head, F.array_join(rows, "\n"))


def page_prompt(lines: Column, number: Column, modal: Column) -> Column:
    """What an annotator is given of a page whose lines are an array in their order: the rows of ``prompt``, which has them one by one."""
    return _prompt_of(F.transform(lines, prompt_row), number, modal)


def prompt(lines: DataFrame, modal: DataFrame, keys: Sequence[str] = ("page_num",)) -> DataFrame:
    """What an annotator is given of each page: a header with its number, modal size (``modal``: keys, modal_size) and lines, and its rows in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "prompt_row"))), lambda x: x["prompt_row"])
    told = prompt_rows(lines).groupBy(*keys).agg(rows.alias("_rows")).join(modal, list(keys), "left")
    return told.select(*keys, _prompt_of(F.col("_rows"), F.col(keys[-1]), F.col("modal_size")).alias("prompt"))


def ranking_prompt(corpus: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The candidates of each edition (``keys``) as one text, in the order of page and id (``ord`` where the corpus has one)."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("--- article_id="), F.col("article_id"), F.lit(" page="), none("page"), F.lit(" continues_on_page="), none("continues_on_page"), F.lit(" ---"))
    said = [F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit(""))) for c in ("headline", "deck", "body_preview")]
    order = [c for c in ("page", "ord", "article_id") if c in corpus.columns]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.concat_ws("\n", head, *said).alias("_row")))), lambda x: x["_row"])
    first = F.concat(F.count("*").cast("string"), F.lit(" candidate articles from this edition:\n"))
    return corpus.groupBy(*keys).agg(F.concat(first, F.array_join(rows, "\n\n")).alias("prompt"))


def corrections(issues: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What a second attempt is told of each edition that needs one: a bullet for each issue in its order, then one for each pair of
    articles that tell one story twice."""
    keep = F.concat(
        F.lit("- article '"), F.col("article_id"), F.lit("' (continues on page "), F.col("page").cast("string"), F.lit(") and '"), F.col("continuation_id"),
        F.lit("' (on that same page) are the same story ranked twice - keep only '"), F.col("article_id"), F.lit("'"),
    )
    a = issues.select(*keys, F.lit(0).alias("_part"), F.col("ord").cast("long").alias("_ord"), F.concat(F.lit("- "), F.col("told")).alias("_t"))
    b = pairs.select(*keys, F.lit(1).alias("_part"), F.lit(0).cast("long").alias("_ord"), keep.alias("_t"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_part", "_ord", "_t"))), lambda x: x["_t"])
    both = a.unionByName(b).groupBy(*keys).agg(F.count("*").alias("_n"), F.array_join(rows, "\n").alias("_rows")).filter("_n > 0")
    return both.select(*keys, F.concat(F.lit("Your previous response had these problems - fix them:\n"), F.col("_rows")).alias("corrections"))


def viewport_box(bbox: Column, page_height: Column, scale: Column) -> Column:
    """A box in an unrotated viewer: back to the page's own axis, which points up, and from there to the screen."""
    low, high = page_height - bbox["bottom"], page_height - bbox["top"]
    top, bottom = (page_height - high) * scale, (page_height - low) * scale
    left, right = bbox["x0"] * scale, bbox["x1"] * scale
    return F.struct(F.least(left, right).alias("left"), F.least(top, bottom).alias("top"), F.abs(right - left).alias("width"), F.abs(bottom - top).alias("height"))
