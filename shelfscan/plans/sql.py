"""Pages, elements, products and results for SQL: a table function and views over captured pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..operators.elements import parsed_elements
from .search import DEFAULT_MAX_PAGES, EXTRACTORS, extract_all, run_searches

ELEMENT_ROW = (
    "id int, end int, depth int, tag string, classes array<string>, attrs map<string,string>, text string"
)


class PageElements:
    """Rows of the elements of one page; a page that is null, blank or not parsed has none."""

    def eval(self, html: str):
        elements, text = parsed_elements(html)
        for number, (end, depth, tag, attrs, at, length, classes) in enumerate(elements):
            yield number, end, depth, tag, list(classes), dict(attrs), text[at : at + length]


def register_functions(spark: SparkSession, name: str = "page_elements") -> None:
    """Make ``SELECT ... FROM pages p, LATERAL page_elements(p.html) e`` possible in a session.

    The function sees one page at a time and gives rows as they are asked for.
    """
    spark.udtf.register(name, udtf(PageElements, returnType=ELEMENT_ROW))


def register_pages(
    pages: DataFrame,
    name: str,
    keys: Sequence[str] = ("platform", "search_term"),
    max_pages: int = DEFAULT_MAX_PAGES,
    extractors: Mapping[str, Callable[[DataFrame], DataFrame]] = EXTRACTORS,
) -> None:
    """Views over captured pages: ``name`` itself, and with _products, _rejected and _results.

    ``extractors`` are the hooks: one function of parsed pages for each platform, whose products
    the views then hold. Views are plans; a query reads what it needs of them.
    """
    products, rejected = extract_all(pages, keys, extractors)
    pages.createOrReplaceTempView(name)
    products.createOrReplaceTempView(f"{name}_products")
    rejected.createOrReplaceTempView(f"{name}_rejected")
    run_searches(pages, None, keys, max_pages, extractors).createOrReplaceTempView(f"{name}_results")
