"""Reading page snapshots, chapters and cached tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PAGE

FORMATS = {"json": "json", "txt": "text", "text": "text", "parquet": "parquet"}


def format_of(path: str) -> str:
    """The format of a path by its ending: folders without one are parquet, unknown endings plain text.  Pickles are refused, as loading one runs its code."""
    ending = PurePosixPath(path).suffix.removeprefix(".").lower()
    if not ending:
        return "parquet"  # a folder
    if ending in ("pkl", "pickle", "p"):
        raise ValueError("pickles are not read")
    return FORMATS.get(ending, "text")


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader, form = spark.read, format_of(path)
    if schema is not None and form != "text":
        reader = reader.schema(schema)
    return reader.option("multiLine", True).json(path) if form == "json" else reader.format(form).load(path)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).format(format_of(path)).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(path: str) -> Callable:
    """Read a table if it is there, else make it and keep it; the arguments don't count, as there is one table a path."""

    def wrap(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
            if not exists(spark, path):
                save(make(spark, *args, **kwargs), path)
            return load(spark, path)

        return run

    return wrap


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages of a JSON snapshot, by id."""
    return load(spark, path, PAGE).orderBy("pageid")


def flat(raw: DataFrame) -> DataFrame:
    """(pageid, title, timestamp, content); missing texts are empty, missing times null."""
    last = F.get("revisions", F.lit(0))
    return raw.select(
        "pageid",
        F.coalesce("title", F.lit("")).alias("title"),
        F.try_to_timestamp(last["timestamp"], F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("timestamp"),
        F.coalesce(last["slots"]["main"]["content"], F.lit("")).alias("content"),
    )


class SourceError(RuntimeError):
    """The service answered with an error."""


def batches(ask: Callable[[dict], dict], request: dict) -> Iterator[dict]:
    """Pages of a service that answers in parts: each answer's ``continue`` is merged into the next request."""
    go_on: dict | None = {}
    while go_on is not None:
        answer = ask(request | go_on)
        if "error" in answer:
            raise SourceError(str(answer["error"]))
        for page in answer.get("query", {}).get("pages", []):
            yield page
        go_on = answer.get("continue")


class PagedSource(DataSource):
    """``spark.read.format("pages")``: option ``ask`` is the import path (module:function) of what asks the service; ``parts`` requests run side by side."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("parts", 1)))]

    def read(self, partition):
        import importlib
        import json

        module, _, name = self.options["ask"].partition(":")
        ask = getattr(importlib.import_module(module), name)
        for page in batches(ask, json.loads(self.options.get("request", "{}")) | {"part": partition.value}):
            revisions = [(r.get("timestamp"), ((r.get("slots", {}).get("main", {}).get("content"),),)) for r in page.get("revisions", [])]
            yield page.get("pageid"), page.get("title"), revisions


def paragraphs(html: Column) -> Column:
    """The text of all paragraphs, by lines.  Scripts, styles and comments go first, and no paragraph needs to be closed."""
    clean = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    parts = F.slice(F.split(clean, r"(?i)<p(?:\s[^>]*)?>"), 2, 1_000_000_000)
    ends = r"(?is)</?(?:p|div|ul|ol|table|section|article|header|footer|nav|body|html|h[1-6])\b.*"
    inner = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, ends, ""), "<[^>]*>", ""))
    out = F.array_join(inner, "\n")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def manifest(opf: Column, pattern: Column) -> Column:
    """(id, href) of the XHTML items of a package file whose id starts with the pattern, in the file's order."""
    flat_ = F.regexp_replace(opf, r'\sxmlns(:\w+)?="[^"]*"', "")
    ids = F.xpath(flat_, F.lit('//item[@media-type="application/xhtml+xml"]/@id'))
    hrefs = F.xpath(flat_, F.lit('//item[@media-type="application/xhtml+xml"]/@href'))
    return F.filter(F.arrays_zip(ids.alias("id"), hrefs.alias("href")), lambda x: F.regexp_like(x["id"], F.concat(F.lit("^(?:"), pattern, F.lit(")"))))


def chapters(spark: SparkSession, books: str, patterns: dict[str, str | None]) -> DataFrame:
    """(key, chapter, text) of the books that lie in folders below ``books`` named by key, from their package files.

    A package belongs to the longest key that leads to it; keys whose pattern is null, and packages of no key, have no chapters.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(books)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")

    def files(glob: str) -> DataFrame:
        found = spark.read.text(books, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
        return found.select(path.alias("path"), F.col("value"))

    keys = spark.createDataFrame(list(patterns.items()), "key string, pattern string")
    packages = files("*.opf").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    own = packages.join(keys, F.concat("folder", F.lit("/")).startswith(F.concat(F.lit(root + "/"), "key", F.lit("/"))))
    own = own.groupBy("path", "folder").agg(F.max_by(F.struct("key", "pattern", "value"), F.length("key")).alias("b")).select("folder", "b.*").where("pattern is not null")
    items = own.select("key", "folder", F.explode(manifest(F.col("value"), F.col("pattern"))).alias("item"))
    items = items.select("key", F.col("item.id").alias("chapter"), F.concat_ws("/", "folder", "item.href").alias("path"))
    return items.join(files("*html"), "path").select("key", "chapter", paragraphs(F.col("value")).alias("text"))
