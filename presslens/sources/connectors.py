"""Pluggable connectors: search results and fetched pages come from callables that the caller injects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from presslens.sources.io import ARTICLE, FIELDS


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class SearchReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], list[str]], pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self):
        return [_Page(0)]

    def read(self, partition):
        for page in range(self.pages):
            links = self.fetch(page)
            if not links:
                break
            yield from ((link,) for link in links if link)


def search_source(fetch: Callable[[int], list[str]], pages: int = 10) -> type[DataSource]:
    """A data source of search results: page after page until the first empty one."""

    class Search(DataSource):
        @classmethod
        def name(cls):
            return "presslens_search"

        def schema(self):
            return "link string"

        def reader(self, schema):
            return SearchReader(fetch, pages)

    return Search


def search(spark: SparkSession, fetch: Callable[[int], list[str]], pages: int = 10) -> DataFrame:
    """Distinct links of a search."""
    spark.dataSource.register(search_source(fetch, pages))
    return spark.read.format("presslens_search").load().distinct()


def fetch_articles(urls: DataFrame, fetch: Callable[[str], dict | None], url: str = "url") -> DataFrame:
    """Articles of urls; a url whose fetch fails is skipped, as is one that gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u in pdf[url]:
                try:
                    got = fetch(u)
                except Exception:
                    got = None
                if got:
                    got = {"url": u, **got}
                    if isinstance(got.get("authors"), (list, tuple)):
                        got["authors"] = "; ".join(got["authors"])
                    rows.append([None if got.get(f) is None else str(got[f]) for f in FIELDS])
            yield pd.DataFrame(rows, columns=FIELDS)

    return urls.select(url).mapInPandas(run, ARTICLE)


def any_of(columns: list[Column], words: list[str]) -> Column:
    """Whether one of the words occurs in one of the columns, ignoring case."""
    pattern = "(?iu)" + "|".join("\\Q" + w + "\\E" for w in words)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.rlike(pattern), F.lit(False))
    return out


def article_query(articles: DataFrame, words: list[str], excluded: list[str] = (), after: str | None = None, before: str | None = None, sites: list[str] = (), not_sites: list[str] = ()) -> DataFrame:
    """A search expression over stored articles: any word in title, url or text, no excluded part in the url, published within the dates, of the sites and not of the others (a site is part of a url or a source)."""
    found = articles.where(any_of([F.col("title"), F.col("url"), F.col("maintext")], list(words)))
    if excluded:
        found = found.where(~any_of([F.col("url")], list(excluded)))
    if sites:
        found = found.where(any_of([F.col("source_domain"), F.col("url")], list(sites)))
    if not_sites:
        found = found.where(~any_of([F.col("source_domain"), F.col("url")], list(not_sites)))
    if after:
        found = found.where(F.col("date_publish") >= F.lit(after).cast("timestamp"))
    if before:
        found = found.where(F.col("date_publish") < F.lit(before).cast("timestamp"))
    return found
