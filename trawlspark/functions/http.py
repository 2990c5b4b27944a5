"""Fields of stored responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML = "text/html"
CSS = "text/css"
TEXT = "text"

# Fixed value: larger bodies are treated as failed requests.
MAX_CONTENT_BYTES = 5 * 1024 * 1024


def media_is(content_type: Column, media_type: str) -> Column:
    return F.coalesce(content_type.startswith(media_type), F.lit(False))


def first_header(headers: Column, name: str) -> Column:
    """First value of a header; names are case-sensitive, missing gives null."""
    return F.get(F.try_element_at(headers, F.lit(name)), F.lit(0))


def body_text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def effective_status(status: Column, content: Column, limit: int = MAX_CONTENT_BYTES) -> Column:
    """-1 (failed request) when the body is over the limit."""
    return F.when(F.octet_length(content) > limit, F.lit(-1)).otherwise(status)


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_redirect(status: Column) -> Column:
    return status.between(300, 399)


def is_fail(status: Column) -> Column:
    """Everything else, -1 for requests without a response included."""
    return ~status.between(200, 399)


def status_class(status: Column) -> Column:
    return (
        F.when(is_success(status), "success")
        .when(is_redirect(status), "redirect")
        .otherwise("fail")
    )
