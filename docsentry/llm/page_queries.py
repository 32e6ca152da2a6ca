"""Query of the HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_extraction
from .common import query, read


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    model = html_extraction.train(html_extraction.labelled_pages())
    return html_extraction.extract(read(spark, sf_dir, "pages"), model)
