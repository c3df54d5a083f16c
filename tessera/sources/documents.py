"""Scans of raw documents: binary files through a pluggable extractor, web pages, remote catalogues."""

from __future__ import annotations

import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions import text as tx
from . import catalogue, pdf

#: How a catalogue may be sorted (fixed values).
SORTS = ("relevance", "submitted", "updated")


class ExtractionError(RuntimeError):
    """A file that can't be read or holds no text."""


def plain_text(content: bytes) -> list[str]:
    """The stand-in extractor: form feeds part pages."""
    return content.decode("utf-8").split("\f")


def pdf_text(content: bytes) -> list[str]:
    """Pages of a PDF: by pypdf where the executors have it (an empty password is tried), else by the plain reader."""
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            return pdf.pages(content)
        except ValueError as e:
            raise ExtractionError(f"{e}; pypdf might read it") from e
    import io

    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        reader.decrypt("")
    return [page.extract_text() or "" for page in reader.pages]


def extracted(extract: Callable[[bytes], list[str]]):
    """A function from a binary column to pages and problem; a file that can't be read, or has no text, is a row with a problem."""

    @F.pandas_udf("struct<pages:array<string>,problem:string>")
    def pages(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in contents:
            rows = []
            for content in part:
                try:
                    found = extract(content)
                    rows.append((found, None) if any(p.strip() for p in found) else ([], "no extractable text"))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append(([], f"cannot read: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["pages", "problem"])

    return pages


def scan_files(spark: SparkSession, path: str, manifest: DataFrame | None = None, extract: Callable[[bytes], list[str]] = plain_text, glob: str = "*.pdf") -> DataFrame:
    """file, doc_id, title, pages, problem: every file of a folder with its manifest record (by file name), else named by its stem.

    Pages are cleaned; empty ones stay as "". A file that can't be read, or has
    no text at all, keeps a row with the problem and no pages.
    """

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("file"), extracted(extract)("content").alias("x")).select("file", F.transform("x.pages", lambda p: tx.clean_text(p)).alias("pages"), "x.problem")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    if manifest is None:
        return rows.select("file", stem.alias("doc_id"), stem.alias("title"), "pages", "problem")
    known = manifest.select(tx.file_name(F.col("arxiv_id")).alias("file"), "arxiv_id", F.col("title").alias("known"))
    return rows.join(known, "file", "left").select("file", F.coalesce("arxiv_id", stem).alias("doc_id"), F.coalesce("known", stem).alias("title"), "pages", "problem")


def html_text(html: Column) -> Column:
    """Text of a web page: without scripts, styles, comments and tags, common entities resolved, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def fetch(wanted: DataFrame, folder: str, get: Callable[[str], bytes] | None = None, delay: float = 3.0, partitions: int = 1, magic: bytes = b"%PDF-") -> DataFrame:
    """Fetch files of (arxiv_id, url) into a folder that all executors share: arxiv_id, pdf_path, problem.

    Each file is written beside its place, in blocks as they arrive, and
    renamed, so that it is whole or absent; what doesn't begin with `magic` is refused; a failure is a row. An
    existing file is kept as it is. `delay` passes between fetches of a task.
    """

    def blocks(url: str) -> Iterator[bytes]:
        if get:
            yield get(url)
            return
        with urllib.request.urlopen(url, timeout=60) as r:
            while block := r.read(1 << 15):
                yield block

    def write(url: str, part: str) -> None:
        os.makedirs(folder, exist_ok=True)
        begin = b""
        with open(part, "wb") as f:
            for block in blocks(url):
                begin = (begin + block)[: len(magic)] if len(begin) < len(magic) else begin
                if not magic.startswith(begin):
                    raise ValueError("not the expected kind of file")
                f.write(block)
        if begin != magic:
            raise ValueError("not the expected kind of file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            rows = []
            for name, url in zip(batch["arxiv_id"], batch["url"], strict=True):
                place = os.path.join(folder, name.replace("/", "_") + ".pdf")
                problem, part = None, f"{place}.part"
                if not os.path.exists(place):
                    if not first:
                        time.sleep(delay)
                    first = False
                    try:
                        write(url, part)
                        os.replace(part, place)
                    except Exception as e:  # logged as a row; the next file goes on
                        problem = f"{type(e).__name__}: {e}"
                    finally:
                        if os.path.exists(part):
                            os.unlink(part)
                rows.append((name, None if problem else place, problem))
            yield pd.DataFrame(rows, columns=["arxiv_id", "pdf_path", "problem"])

    return wanted.select("arxiv_id", "url").repartition(partitions).mapInPandas(run, "arxiv_id string, pdf_path string, problem string")


class CatalogueSource(DataSource):
    """`spark.read.format("paper_catalogue")`: records of a remote catalogue, page by page.

    Options: query, max_results, sort_by, and either url, of a server that
    answers with Atom feeds (with delay and retries; see catalogue.AtomClient),
    or client, an importable "module:function" that takes query, start, count
    and sort and gives records as dicts. One task reads after the other's pages
    only if the session runs them so: a server's wish for few requests is met
    with max_results up to 100, which is one task.

    `spark.readStream.format("paper_catalogue")` follows a search from the
    newest max_results records on: each batch has what was submitted since the
    last. The offset is the time and the ids of the newest records delivered, so
    a query that is started again on its checkpoint goes on where it was, and a
    batch that has to be repeated is asked for again and cut at the same offsets.
    """

    @classmethod
    def name(cls) -> str:
        return "paper_catalogue"

    def schema(self) -> str:
        return "arxiv_id string, title string, url string, authors array<string>, published string, categories array<string>, summary string"

    def reader(self, schema):
        return _CatalogueReader(dict(self.options))

    def simpleStreamReader(self, schema):  # noqa: N802
        return _CatalogueStream(dict(self.options))


class _Page(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class _CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.query = options.get("query", "")
        self.most = int(options.get("max_results", options.get("maxresults", 15)))
        self.sort = options.get("sort_by", "relevance")
        self.client = options.get("client")
        self.server = {k: kind(options[k]) for k, kind in (("url", str), ("delay", float), ("retries", int)) if k in options}
        if self.most <= 0:
            raise ValueError("max_results must be positive")
        if self.sort not in SORTS:
            raise ValueError(f"sort_by must be one of {SORTS}")

    def partitions(self):
        return [_Page(a, min(100, self.most - a)) for a in range(0, self.most, 100)]

    def read(self, partition):
        import importlib

        if "url" in self.server:
            ask = catalogue.AtomClient(**self.server).records
        elif self.client:
            module, _, name = self.client.partition(":")
            ask = getattr(importlib.import_module(module), name)
        else:
            raise RuntimeError("a catalogue needs the option url or client")
        for r in ask(self.query, partition.start, partition.count, self.sort):
            yield (r["arxiv_id"], r.get("title"), r.get("url"), r.get("authors"), r.get("published"), r.get("categories"), r.get("summary"))


class _CatalogueStream(SimpleDataSourceStreamReader):
    """Offsets: published, the time of the newest record delivered, and ids, those delivered of that time."""

    def __init__(self, options: dict):
        # newest first: only so can a look end at what is known
        self.batch = _CatalogueReader(options | {"sort_by": "submitted"})

    def initialOffset(self) -> dict:  # noqa: N802
        return {"published": "", "ids": []}

    def _newest(self, start: dict) -> list[tuple]:
        """Records from the newest back to what is known, or max_results of them where nothing is."""
        out: list[tuple] = []
        while True:
            count = 100 if start["published"] else min(100, self.batch.most - len(out))
            rows = list(self.batch.read(_Page(len(out), count))) if count > 0 else []
            out += rows
            if len(rows) < count or not rows or (start["published"] and (rows[-1][4] or "") < start["published"]):
                return out

    @staticmethod
    def _after(rows: list[tuple], start: dict) -> list[tuple]:
        return [r for r in rows if (r[4] or "") > start["published"] or ((r[4] or "") == start["published"] and r[0] not in start["ids"])]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen: set[str] = set()
        fresh = [r for r in self._after(self._newest(start), start) if not (r[0] in seen or seen.add(r[0]))]
        if not fresh:
            return iter([]), start
        last = max(r[4] or "" for r in fresh)
        ids = sorted({r[0] for r in fresh if (r[4] or "") == last} | (set(start["ids"]) if last == start["published"] else set()))
        return iter(sorted(fresh, key=lambda r: (r[4] or "", r[0]))), {"published": last, "ids": ids}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = {r[0]: r for r in self._after(self._newest(start), start) if (r[4] or "") < end["published"] or ((r[4] or "") == end["published"] and r[0] in end["ids"])}
        return iter(sorted(rows.values(), key=lambda r: (r[4] or "", r[0])))

    def commit(self, end: dict) -> None:
        """Nothing is kept at the catalogue."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogueSource)
