"""Paged JSON services as a Spark source: a partition a page, with retries, and fetches that go on where they stopped.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", "https://host/items?limit={limit}&offset={offset}").option("items", "items").load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page long, place long, item string"


def fetch(url: str, retries: int = 4, backoff: float = 0.5, timeout: float = 60.0):
    """The JSON behind a URL.

    What may pass (timeouts, dropped connections, status 429 and 5xx) is tried
    again, after ``backoff`` seconds and twice as long each time; what a server
    refuses otherwise raises at once, and so does text that isn't JSON.
    """
    for k in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or k == retries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == retries:
                raise
        time.sleep(backoff * 2**k)


def inside(doc, path: str):
    """What a document has under a dotted path; an empty path is the document."""
    for name in path.split(".") if path else ():
        doc = doc[name]
    return doc


class Options:
    """``url`` with {page}, {offset} and {limit}; ``items``, the path of a page's items; ``total``, the path of their number, or ``pages``; ``size``; ``first`` page; ``retries``, ``backoff``, ``timeout``."""

    def __init__(self, options: dict) -> None:
        o = {k.lower(): v for k, v in options.items()}
        if "url" not in o:
            raise ValueError("give the option url")
        self.url, self.items, self.total = o["url"], o.get("items", ""), o.get("total")
        self.size, self.first = int(o.get("size", 1000)), int(o.get("first", 0))
        self.pages = int(o["pages"]) if "pages" in o else None
        self.only = [int(x) for x in o["only"].split(",") if x] if "only" in o else None
        self.how = {"retries": int(o.get("retries", 4)), "backoff": float(o.get("backoff", 0.5)), "timeout": float(o.get("timeout", 60))}
        if self.pages is None and self.total is None:
            raise ValueError("give the option total or the option pages")

    def at(self, page: int) -> str:
        return self.url.replace("{page}", str(page + self.first)).replace("{offset}", str(page * self.size)).replace("{limit}", str(self.size))

    def read(self, page: int) -> list:
        got = inside(fetch(self.at(page), **self.how), self.items)
        if not isinstance(got, list):
            raise ValueError(f"page {page} has no list at {self.items!r}")
        return got

    def count(self) -> int:
        """How many pages there are; asks the first one where ``pages`` isn't given."""
        if self.pages is not None:
            return self.pages
        return -(-int(inside(fetch(self.at(0), **self.how), self.total)) // self.size)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = Options(options)

    def partitions(self) -> list[InputPartition]:
        o = self.options
        return [Page(p) for p in (o.only if o.only is not None else range(o.count()))]

    def read(self, partition: Page) -> Iterator[tuple]:
        for i, x in enumerate(self.options.read(partition.number)):
            yield partition.number, i, json.dumps(x, sort_keys=True, ensure_ascii=False)


class PagedSource(DataSource):
    """(page, place, item): the items of all pages as JSON text; see ``Options``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**options).load()


def fetch_all(spark: SparkSession, path: str, batch: int = 64, **options) -> DataFrame:
    """All pages, kept under ``path``: what an earlier run has stored isn't fetched again.

    Pages are fetched ``batch`` at a time, each batch one append that is visible
    whole or not at all.  A page without items leaves a row with a null item,
    so that it counts as fetched; the result leaves it out.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    stored = spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)
    # page numbers, not items
    have = {r.page for r in stored.select("page").distinct().collect()}
    want = [p for p in range(Options(options).count()) if p not in have]
    for at in range(0, len(want), batch):
        some = want[at : at + batch]
        got = read_pages(spark, **options, only=",".join(map(str, some)))
        asked = spark.createDataFrame([(p,) for p in some], "page long")
        asked.join(got, "page", "left").write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("item").isNotNull())


def fetch_keys(keys: DataFrame, path: str, url: str, key: str, items: str = "", batch: int = 50, sep: str = ";", at_once: int = 64, **how) -> DataFrame:
    """(key, item) of a service that takes lists of keys, kept under ``path``: what is stored isn't fetched again.

    ``keys`` has (key); ``url`` has {keys}, which becomes ``batch`` of them with
    ``sep`` between; an answer's items stand under the path ``items`` and their
    own keys under the path ``key``.  Each batch is a request of its own, tried
    again as ``fetch`` does; ``at_once`` batches are one append, visible whole
    or not at all.  A key that the service doesn't know is stored without an
    item, so that it is asked for once.  Null keys are left out.
    """
    import pandas as pd

    from signflow.functions.storage import numbered, store

    spark, schema = keys.sparkSession, "key string, item string"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    lacking = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct().join(stored.select("key"), "key", "left_anti")
    dealt = store(numbered(lacking, "key").select("key", F.floor(F.col("number") / batch).alias("batch")), "keys")
    rounds = -(-dealt.count() // (batch * at_once))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        for pdf in frames:
            for some in pdf["keys"]:
                got = inside(fetch(url.replace("{keys}", sep.join(quote(k, safe="") for k in some)), **how), items)
                found = {str(inside(x, key)): json.dumps(x, sort_keys=True, ensure_ascii=False) for x in got}
                yield pd.DataFrame({"key": list(some), "item": [found.get(k) for k in some]})

    for k in range(rounds):
        part = dealt.where(F.col("batch").between(k * at_once, (k + 1) * at_once - 1)).groupBy("batch").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        # a request a task
        part.repartition(at_once, "batch").select("keys").mapInPandas(run, schema).write.mode("append").parquet(path)
    if rounds or there:
        return spark.read.schema(schema).parquet(path).where(F.col("item").isNotNull())
    return stored
