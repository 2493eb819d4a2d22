"""Feeds as they come: nested, with scalars for lists, keys in any case, dates in parts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "section string, department string, heading string, id string, title string, url string, pdf string"


def as_list(v):
    return [] if v is None else v if isinstance(v, list) else [v]


def lowered(record: dict) -> dict:
    """Keys in lower case; a key that is there as asked wins when get() looks it up."""
    return {str(k).lower(): v for k, v in record.items()} | record


def get(record: dict, *names: str):
    """The first name that is there: as it is written, else without regard to case."""
    own = {str(k).lower(): v for k, v in record.items()}
    for n in names:
        if n in record:
            return record[n]
        if n.lower() in own:
            return own[n.lower()]
    return None


def daily_index(raw: str, sections: tuple[str, ...] = ("2A", "2B")) -> Iterator[tuple]:
    """Items of a daily index; every level may be one value or a list. Other sections are skipped before they are opened."""
    data = json.loads(raw)
    for day in as_list((data.get("data") or {}).get("sumario", {}).get("diario")):
        for section in as_list(day.get("seccion")):
            if section.get("codigo") not in sections:
                continue
            for dep in as_list(section.get("departamento")):
                for head in as_list(dep.get("epigrafe")):
                    for item in as_list(head.get("item")):
                        pdf = item.get("url_pdf")
                        yield section["codigo"], dep.get("nombre"), head.get("nombre"), item.get("identificador"), item.get("titulo"), item.get("url_html"), pdf.get("texto") if isinstance(pdf, dict) else pdf


def unwrap(payload) -> list[dict]:
    """Records of a board: a list, the first list under a known key, or the object itself. Others are dropped."""
    if isinstance(payload, dict):
        payload = next((payload[k] for k in ("data", "items", "result", "results", "anuncios") if isinstance(payload.get(k), list)), [payload])
    return [x for x in as_list(payload) if isinstance(x, dict)]


def embedded(page: str, variable: str) -> list[dict]:
    """The JSON array that a script assigns to a variable."""
    m = re.search(rf"var\s+{re.escape(variable)}\s*=\s*", page)
    return [x for x in json.JSONDecoder().raw_decode(page[m.end() :])[0] if isinstance(x, dict)] if m else []


def struct_date(x: Column) -> Column:
    """Date of a struct (year, month, day); null if it isn't one."""
    return F.try_to_date(F.concat_ws("-", x["year"].cast("string"), x["month"].cast("string"), x["day"].cast("string")), "y-M-d")


def indexes(df: DataFrame, raw_col: str = "raw", day_col: str = "day") -> DataFrame:
    """A row for each item of each day; a day that can't be read gives a row with its error, and no items."""
    import pyarrow as pa

    names = ["section", "department", "heading", "id", "title", "url", "pdf"]

    def run(batches):
        for batch in batches:
            out = []
            for day, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(day, *x, None) for x in daily_index(raw)] if raw is not None else []
                except (ValueError, AttributeError, KeyError, TypeError) as e:
                    out.append((day, *[None] * 7, type(e).__name__))
            columns = list(zip(*out)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(list(c), pa.string()) for c in columns[1:])], names=["day", *names, "error"])

    kind = df.schema[day_col].dataType.simpleString()
    return df.select(F.col(day_col).alias("day"), raw_col).mapInArrow(run, f"day {kind}, {ITEM}, error string")
