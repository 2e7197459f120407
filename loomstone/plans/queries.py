"""All queries over the input tables; the modules register them as they are imported."""

from loomstone.plans import (  # noqa: F401
    crawl_queries,
    page_queries,
    parse_queries,
    report_queries,
    scalar_queries,
    text_queries,
    url_queries,
    warehouse_queries,
)
from loomstone.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "page_report"
