"""Files as documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import file_type
from .state import cut

class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.href: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "table", "ul", "ol", "tr", "br"):
            self.out.append("\n\n" if tag != "br" else "\n")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif re.fullmatch("h[1-6]|p", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown(html: str | None) -> str | None:
    """FN-09: headings, paragraphs, list items and links of an HTML page."""
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(parser.out))).strip()


def pages_to_markdown(pages: DataFrame, html: str = "html", into: str = "markdown") -> DataFrame:
    """FN-09 over a table of pages, in Arrow batches."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(markdown, na_action="ignore")

    return pages.withColumn(into, convert(F.col(html)))


_FILE = "path string, file_type string, size long, mtime timestamp, hash string, text string, error string"


def _read(files: DataFrame, kinds: set[str] | None, extractors: dict[str, Callable[[bytes], str]] | None) -> DataFrame:
    from .formats import READERS

    readers = READERS | (extractors or {})
    wanted = set(readers) if kinds is None else kinds & set(readers)
    files = files.withColumn("file_type", file_type(F.col("path"))).where(F.col("file_type").isin(*wanted))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b["file_type"], b["content"]):
                try:
                    texts.append(readers[kind](content))
                    errors.append(None)
                except Exception as x:  # noqa: BLE001  an unreadable file is a row with an error
                    texts.append(None)
                    errors.append(f"{type(x).__name__}: {x}")
            out = b.drop(columns="content")
            yield out.assign(text=pd.Series(texts, b.index, object), error=pd.Series(errors, b.index, object))

    slim = files.select("path", "file_type", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "content")
    return slim.mapInPandas(decode, _FILE)


def read_files(spark: SparkSession, path: str, recursive: bool = True, kinds: set[str] | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """SRC-02, SRC-05, SRC-26: a file or folder -> path, file_type, size, mtime, hash, text, error (text is null then).

    kinds: suffixes to read (all that have a reader); extractors: readers by suffix, before the built-in ones. A folder is
    listed, and its files are read where the rows are made.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _read(files, kinds, extractors)


def load_files(spark: SparkSession, path: str, recursive: bool = True, kinds: set[str] | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """SRC-01 to SRC-05, SRC-27: as read_files, without the files that couldn't be read."""
    return read_files(spark, path, recursive, kinds, extractors).where("error is null").drop("error")


def file_stream(spark: SparkSession, path: str, kinds: set[str] | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """SRC-03: the files of a folder as a stream, new ones as they come; unreadable ones are skipped."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return _read(files, kinds, extractors).where("error is null").drop("error")


def pdf_page_rows(files: DataFrame) -> DataFrame:
    """SRC-07: PDF files (path, content) -> (path, page_no from 1, text); a file that can't be read has no rows."""
    from .formats import pdf_pages

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, i, text) for i, text in enumerate(pdf_pages(content), 1)]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.select("path", "content").mapInPandas(pages, "path string, page_no int, text string")


def sitemap_urls(maps: DataFrame, root: str, most_levels: int = 10) -> DataFrame:
    """SRC-19: the distinct page urls of a sitemap and the sitemaps it lists; each sitemap is read once, so circles end.

    maps (url, xml) is what was fetched. Namespaces are dropped before the paths are evaluated.
    """
    clean = maps.select("url", F.regexp_replace(F.regexp_replace("xml", r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", ""), r"<(/?)\w+:", "<$1").alias("xml"))
    locs = lambda df, path: df.select(F.explode(F.expr(f"xpath(xml, '{path}')")).alias("url")).select(F.trim("url").alias("url")).distinct()
    seen = wave = clean.where(F.col("url") == root).select("url")
    for _ in range(most_levels):
        wave = cut(locs(clean.join(wave, "url", "left_semi"), "/sitemapindex/sitemap/loc/text()").join(seen, "url", "left_anti"))
        if wave.isEmpty():
            break
        seen = seen.union(wave)
    return locs(clean.join(seen, "url", "left_semi"), "/urlset/url/loc/text()")


def sitemap_of(url: str) -> str:
    return re.sub(r"^([a-z]+://[^/]+).*", r"\1/sitemap.xml", url)
