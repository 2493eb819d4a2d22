"""Pages: visible text, links with their context, dates from markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset(("script", "style", "noscript", "svg"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
CONTAINERS = frozenset(("article", "tr", "li"))
OUTER = frozenset(("body", "nav", "header", "footer"))
#: A page with fewer links or fewer characters counts as near empty. Fixed values.
FEW_LINKS, FEW_CHARS = 3, 200


class _Page(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.stack, self.parts = base, [], []
        self.links: list[dict] = []
        self.open: dict | None = None
        self.containers: list[tuple[int, int]] = []
        self.published = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "time" and a.get("datetime") and not self.published:
            self.published = a["datetime"]
        if tag == "meta" and not self.published and (a.get("property") or a.get("name")) in ("article:published_time", "date", "dc.date") and a.get("content"):
            self.published = a["content"]
        if tag == "a" and a.get("href") is not None:
            self.open = {"href": a["href"], "at": len(self.parts), "box": self.containers[-1][1] if self.containers else -1, "text": ""}
        if tag not in VOID:
            self.stack.append(tag)
            if tag in CONTAINERS:
                self.containers.append((len(self.stack), len(self.parts)))

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            self.open["text"] = " ".join(" ".join(self.parts[self.open["at"] :]).split())
            self.links.append(self.open)
            self.open = None
        if tag in self.stack:
            while self.stack:
                gone = self.stack.pop()
                if self.containers and self.containers[-1][0] > len(self.stack):
                    _, start = self.containers.pop()
                    body = " ".join(" ".join(self.parts[start:]).split())
                    for x in self.links:
                        if x["box"] == start and "context" not in x:
                            x["context"] = body
                if gone == tag:
                    break

    def handle_data(self, data):
        if not HIDDEN.intersection(self.stack):
            self.parts.append(data)


def parse(markup: str, base: str) -> tuple[str, list[dict], str]:
    """Visible text, links (url, text, context) in order, each url once, and the published date as written."""
    page = _Page(base)
    page.feed(markup or "")
    page.close()
    seen, links = set(), []
    for x in page.links:
        href = x["href"].strip()
        if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:", "tel:")):
            continue
        try:
            url = urljoin(base, href).split("#")[0]
            urlsplit(url)
        except ValueError:
            continue
        if url not in seen:
            seen.add(url)
            links.append({"url": url, "text": x["text"], "context": x.get("context", x["text"])})
    return " ".join(" ".join(page.parts).split()), links, page.published


_LINK = pa.struct([("url", pa.string()), ("text", pa.string()), ("context", pa.string())])


def read_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, text, links, published and near_empty of each page. Null markup is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [parse(h or "", u or "") for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                empty = [len(x[1]) < FEW_LINKS or len(x[0]) < FEW_CHARS for x in found]
                columns = [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(_LINK)), pa.array([x[2] for x in found], pa.string()), pa.array(empty, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "text", "links", "published", "near_empty"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kind}, text string, links array<struct<url:string,text:string,context:string>>, published string, near_empty boolean")


def links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for each link, with its place."""
    return pages.select(id_col, F.posexplode("links").alias("pos", "l")).select(id_col, "pos", "l.url", "l.text", "l.context")


def is_document(url: Column) -> Column:
    return F.endswith(F.lower(F.try_parse_url(url, F.lit("PATH"))), F.lit(".pdf"))


def may_hydrate(url: Column, page_url: Column) -> Column:
    """Same host, and not a binary file."""
    same = F.try_parse_url(url, F.lit("HOST")).eqNullSafe(F.try_parse_url(page_url, F.lit("HOST")))
    return same & ~F.lower(F.try_parse_url(url, F.lit("PATH"))).rlike(r"\.(pdf|zip|docx?|xlsx?|odt|ods|jpe?g|png)$")
