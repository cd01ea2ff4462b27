"""Files that the JSON answers of data archives list, as arrays of (url, name); entries without either are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of the answers.
RECORD = "files array<struct<links: struct<content: string, self: string>, download_url: string, key: string, filename: string>>"
ARTICLE = "array<struct<download_url: string, name: string>>"


def _first(*fields: Column) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in fields))


def _listed(files: Column, url, name) -> Column:  # noqa: ANN001
    rows = F.transform(F.coalesce(files, F.array()), lambda f: F.struct(url(f).alias("url"), name(f).alias("name")))
    return F.filter(rows, lambda r: r["url"].isNotNull() & r["name"].isNotNull())


def record_files(answer: Column) -> Column:
    """Of a record's answer; text that is no JSON lists none."""
    files = F.from_json(answer, RECORD)["files"]
    return _listed(files, lambda f: _first(f["links"]["content"], f["links"]["self"], f["download_url"]), lambda f: _first(f["key"], f["filename"]))


def article_files(answer: Column) -> Column:
    """Of an article's list of files; text that is no JSON lists none."""
    return _listed(F.from_json(answer, ARTICLE), lambda f: _first(f["download_url"]), lambda f: _first(f["name"]))
