"""Web pages as source files: a language of one's own, through the same extraction as the built-in ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.sources.extract import Facts, Language, Registry
from symloom.sources.ingest import extract_facts, split_facts

_TITLE = re.compile(r"<title>([^<]*)</title>")
_LINK = re.compile(r'<a href="([^"]*)"')


def extract_page(path: str, text: str) -> Facts:
    """The title is a symbol of kind ``title``, links are references of kind ``path`` and imports of their target."""
    module = path.rpartition(".")[0]

    def place(at: int) -> tuple[int, int]:
        start = text.rfind("\n", 0, at) + 1
        return text.count("\n", 0, at) + 1, len(text[start:at].encode()) + 1

    links = [(m[1], *place(m.start(1))) for m in _LINK.finditer(text)]
    return Facts(
        symbols=[(m[1], "title", *place(m.start(1)), module) for m in _TITLE.finditer(text)],
        refs=[(name, line, column, "path", module) for name, line, column in links],
        imports=[(name, None) for name, _, _ in links],
    )


PAGES = Language("page", ("page",), extract_page)


def page_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    files = pages.select(F.concat("page_id", F.lit(".page")).alias("path"), F.sha2(html, 256).alias("content_hash"), html.alias("content"))
    return split_facts(extract_facts(files, Registry((PAGES,))))


def plugin_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tables(spark, sf_dir)["symbols"].select("path", "name", "kind", "start_line", "module_path")


def plugin_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tables(spark, sf_dir)["refs"].groupBy("path", "name", "container").agg(F.count("*").alias("n_refs"))


def plugin_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tables(spark, sf_dir)["files"]


_SOURCE = "WITH p AS (SELECT page_id || '.page' AS path, CAST(page_id AS VARCHAR) AS module, coalesce(html, '') AS html FROM pages)"
ORACLES = {
    "plugin_symbols": f"{_SOURCE}, m AS (SELECT path, module, html, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS name FROM p) SELECT path, name, 'title' AS kind, CAST(1 + length(split_part(html, '<title>', 1)) - length(replace(split_part(html, '<title>', 1), chr(10), '')) AS INTEGER) AS start_line, module AS module_path FROM m",
    "plugin_references": f"{_SOURCE}, m AS (SELECT path, module, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS name FROM p) SELECT path, name, module AS container, count(*) AS n_refs FROM m GROUP BY ALL",
    "plugin_files": f"{_SOURCE} SELECT path, sha256(html) AS content_hash FROM p",
}
