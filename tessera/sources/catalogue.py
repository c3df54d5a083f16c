"""A client for catalogues that answer searches with Atom feeds."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

_ATOM = "{http://www.w3.org/2005/Atom}"
# fixed values: what the sorts are called on the wire
_SORT = {"relevance": "relevance", "submitted": "submittedDate", "updated": "lastUpdatedDate"}


@dataclass
class AtomClient:
    """Records of a search, a page of the feed at a time; `delay` seconds pass between requests, a failing one is repeated."""

    url: str
    page: int = 100
    delay: float = 3.0
    retries: int = 3
    timeout: float = 60.0

    def records(self, query: str, start: int, count: int, sort: str) -> Iterator[dict]:
        end = start + count
        while start < end:
            found = self._page(query, start, min(self.page, end - start), sort)
            yield from found
            if not found:
                return
            start += len(found)
            if start < end:
                time.sleep(self.delay)

    def _page(self, query: str, start: int, count: int, sort: str) -> list[dict]:
        asked = urllib.parse.urlencode({"search_query": query, "start": start, "max_results": count, "sortBy": _SORT[sort], "sortOrder": "descending"})
        for left in reversed(range(self.retries + 1)):
            try:
                with urllib.request.urlopen(f"{self.url}?{asked}", timeout=self.timeout) as answer:
                    return [self._record(e) for e in ET.parse(answer).getroot().iter(f"{_ATOM}entry")]
            except (urllib.error.URLError, ET.ParseError) as e:
                if not left:
                    raise RuntimeError(f"the catalogue failed {self.retries + 1} times: {e}") from e
                time.sleep(self.delay)
        raise AssertionError

    @staticmethod
    def _record(entry: ET.Element) -> dict:
        text = lambda tag: " ".join((entry.findtext(f"{_ATOM}{tag}") or "").split())
        links = {x.get("title") or x.get("rel"): x.get("href") for x in entry.iter(f"{_ATOM}link")}
        return {
            "arxiv_id": text("id").rsplit("/abs/", 1)[-1],
            "title": text("title"),
            "url": links.get("pdf") or links.get("alternate"),
            "authors": [" ".join((a.findtext(f"{_ATOM}name") or "").split()) for a in entry.iter(f"{_ATOM}author")],
            "published": text("published"),
            "categories": [c.get("term") for c in entry.iter(f"{_ATOM}category")],
            "summary": text("summary"),
        }
