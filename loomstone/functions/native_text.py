"""Helpers for native columns, and DuckDB spellings of the page columns that several query twins share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class PageTextSql:
    title: str = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g'))"
    plain: str = (
        r"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, "
        r"'(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', chr(10), 'g'), "
        r"'(?i)</?(?:p|div|section|article|main|aside|header|footer|nav|ul|ol|li|table|tr|td|th|h[1-6]|br|hr|form|figure|"
        r"figcaption|blockquote|pre|dl|dt|dd)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), chr(10)), "
        r"lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
    )


PAGE_TEXT_SQL = PageTextSql()
