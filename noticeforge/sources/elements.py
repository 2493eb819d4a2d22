"""Pages as tables: elements and texts are rows with the interval of places that they span.

An element spans the places from pre to post; what it holds has places in between.
So "within", "the text of" and "the nearest of a kind" are comparisons of places, by
windows over a page's rows or joins on the places that stand above a row, and checks
of a page are columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import text
from noticeforge.sources import dom

ROWS = "pre int, post int, up array<int>, tag string, attrs map<string,string>, url string, words string"


def _rows(root: dom.Node, base: str) -> list[list]:
    """ROWS of all that stands below, in the order of the page; tag is empty for texts, url is what an href leads to, without its fragment."""
    out: list[list] = []
    # A node is met twice: when it opens, and when its last place is known.
    todo: list = [(child, [], None) for child in reversed(root.children)]
    while todo:
        node, up, opened = todo.pop()
        if opened is not None:
            out[opened][1] = len(out) - 1
        elif isinstance(node, str):
            out.append([len(out), len(out), up, "", [], None, node])
        else:
            out.append([len(out), len(out), up, node.tag, list(node.attrs.items()), _url(base, node.attrs.get("href")), ""])
            todo.append((node, up, len(out) - 1))
            below = [*up, len(out) - 1]
            todo += [(child, below, None) for child in reversed(node.children)]
    return out


def _url(base: str, href: str | None) -> str | None:
    try:
        return None if href is None else urldefrag(urljoin(base, href.strip()))[0]
    except ValueError:
        return None


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """key and ROWS of every page, with links led on from url_col if there is one; a null or empty page has none. up has the places of the elements above, outermost first."""
    kind = pages.schema[id_col].dataType.simpleString()
    schema = pa.schema([("pre", pa.int32()), ("post", pa.int32()), ("up", pa.list_(pa.int32())), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("url", pa.string()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html, base in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = _rows(dom.tree(html), base or "")
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(rows)), *columns], names=["key", *schema.names])

    base = F.col(url_col) if url_col else F.lit("")
    return pages.select(id_col, html_col, base.alias("_base")).mapInArrow(run, f"key {kind}, {ROWS}")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)


def words() -> Column:
    """Aggregate: the words of a group's texts, in the order of the page."""
    texts = F.collect_list(F.when(F.col("tag") == "", F.struct("pre", "words")))
    return text.clean(F.array_join(F.transform(F.array_sort(texts), lambda x: x["words"]), " "))


def first_of(value: Column, where: Column) -> Column:
    """Aggregate: the value of the first row of the page for which the condition holds and the value isn't null."""
    return F.min_by(F.when(where, value), F.when(where & value.isNotNull(), F.col("pre")))


def within(rows: DataFrame, outer: Column, name: str) -> DataFrame:
    """Rows that stand in an element of a kind whose elements don't hold each other, with name: its pre. The element's own row is among them."""
    opened = F.last(F.when(outer, F.struct("pre", "post")), ignorenulls=True).over(Window.partitionBy("key").orderBy("pre"))
    return rows.withColumn("_o", opened).where(F.col("pre") <= F.col("_o.post")).withColumn(name, F.col("_o.pre")).drop("_o")


def words_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """key, pre and words of the elements in asked (key, pre): each text goes to those that stand above it."""
    texts = rows.where("tag = ''").select("key", F.col("pre").alias("at"), "words", F.explode("up").alias("pre"))
    texts = texts.join(asked.select("key", "pre").distinct(), ["key", "pre"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]), " ")
    return texts.groupBy("key", "pre").agg(text.clean(joined).alias("words"))
