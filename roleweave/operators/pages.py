"""Page main text as a table operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.functions.arrays import with_computed
from roleweave.functions.html import PageRules, main_text


def extract_pages(pages: DataFrame, html: str = "html", rules: PageRules = PageRules()) -> DataFrame:
    """Replace the markup by ``text``, ``step`` and ``n_chars``.

    The extraction runs once per page however many of its fields are read.
    """
    found = with_computed(pages, {"_page": main_text(F.col(html), rules)}).drop(html)
    return found.withColumns(
        {"text": F.col("_page.text"), "step": F.col("_page.step"), "n_chars": F.length("_page.text")}
    ).drop("_page")


def extraction_report(extracted: DataFrame) -> DataFrame:
    """Pages and characters per extraction step."""
    return extracted.groupBy("step").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n_chars").alias("chars"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
    )


def page_texts(extracted: DataFrame, link: str = "job_link") -> DataFrame:
    """One text per link: the longest, then the smallest; pages without text are left out."""
    return (
        extracted.where(F.col("text") != "")
        .groupBy(link)
        .agg(F.max(F.struct("n_chars", "text")).alias("best"))
        .select(link, "best.text")
    )
