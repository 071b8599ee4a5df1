"""Paged web sources with a polite client. The transport is a parameter, so tests need no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Reply:
    status: int
    text: str
    headers: dict = field(default_factory=dict)


Transport = Callable[[str], Reply]


def web(url: str) -> Reply:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=60) as r:
            return Reply(r.status, r.read().decode("utf-8", "replace"), dict(r.headers))
    except HTTPError as e:
        return Reply(e.code, e.read().decode("utf-8", "replace"), dict(e.headers))


@dataclass
class Client:
    """Waits as the server asks: after 429 for Retry-After, near the end of the allowance until it is renewed; doubles its wait
    after server errors, from 2 to 120 seconds; tries a refused query (422) once more; gives up after `most` tries."""

    transport: Transport = web
    sleep: Callable[[float], None] = time.sleep
    most: int = 6

    def get(self, url: str) -> Reply:
        wait, refused = 2.0, False
        for _ in range(self.most):
            r = self.transport(url)
            head = {k.lower(): v for k, v in r.headers.items()}
            if r.status == 200:
                if float(head.get("x-ratelimit-remaining", 2)) <= 1:
                    self.sleep(float(head.get("x-ratelimit-reset", 1)))
                return r
            if r.status == 429:
                self.sleep(float(head.get("retry-after", wait)))
            elif r.status >= 500:
                self.sleep(wait)
                wait = min(wait * 2, 120.0)
            elif r.status == 422 and not refused:
                refused = True
                self.sleep(wait)
            else:
                raise RuntimeError(f"{url}: status {r.status}")
        raise RuntimeError(f"{url}: no answer after {self.most} tries")


def author_pages(base: str, author: str, client: Client, size: int = 100) -> Iterator[dict]:
    """All records of an author, oldest first: pages by a cursor one second past the last record; each id once. A short page, or a
    cursor that doesn't move, ends it."""
    after, seen = 0, set()
    while True:
        rows = json.loads(client.get(f"{base}?{urlencode({'author': author, 'limit': size, 'sort': 'asc', 'after': after})}").text).get("data") or []
        for r in rows:
            if r.get("id") not in seen:
                seen.add(r.get("id"))
                yield r
        if len(rows) < size:
            return
        cursor = int(float(rows[-1]["created_utc"])) + 1
        if cursor <= after:
            return
        after = cursor


def by_ids(base: str, ids: list[str], fields: tuple[str, ...], client: Client, size: int = 500) -> Iterator[dict]:
    """Records by id, at most `size` per request; the field id always comes too."""
    wanted = ",".join(dict.fromkeys(("id", *[f.strip() for f in fields])))
    for a in range(0, len(ids), min(size, 500)):
        yield from json.loads(client.get(f"{base}?{urlencode({'ids': ','.join(ids[a : a + min(size, 500)]), 'fields': wanted})}").text).get("data") or []


class _Author(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


def author_source(base: str, authors: list[str], client: Client) -> type[DataSource]:
    """A data source of (author, raw), one author per task."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Author(a) for a in authors]

        def read(self, partition: _Author) -> Iterator[tuple]:
            for r in author_pages(base, partition.name, client):
                yield partition.name, json.dumps(r, ensure_ascii=False)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "author_pages"

        def schema(self) -> str:
            return "author string, raw string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def fetch_ids(ids: DataFrame, base: str, fields: tuple[str, ...], client: Client) -> DataFrame:
    """(id, raw) of the ids (id), fetched in batches by the tasks that hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(by_ids(base, b["id"].tolist(), fields, client))
            yield pd.DataFrame({"id": [r["id"] for r in rows], "raw": [json.dumps(r, ensure_ascii=False) for r in rows]})

    return ids.select("id").mapInPandas(run, "id string, raw string")


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.inside = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.rows[-1][-1] += data


def table_rows(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of the tables in pages (page, html): page, place and the columns, found by their header. columns: header in lower
    case -> name. Values are text; number() reads those with thousands separators."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b["page"], b["html"]):
                p = _Rows()
                p.feed(html or "")
                head: dict = {}
                for place, row in enumerate(r for r in p.rows if r):
                    cells = [" ".join(c.split()) for c in row]
                    low = [c.lower() for c in cells]
                    if any(c in columns for c in low):
                        head = {columns[c]: i for i, c in enumerate(low) if c in columns}
                    elif head:
                        out.append([page, place, *(cells[head[n]] if n in head and head[n] < len(cells) else None for n in columns.values())])
            yield pd.DataFrame(out, columns=["page", "place", *columns.values()])

    return pages.mapInPandas(run, ", ".join(["page int", "place int", *(f"`{n}` string" for n in columns.values())]))


def number(c: Column | str, kind: str = "bigint") -> Column:
    return F.expr(f"try_cast(regexp_replace(`{c}`, '[,\\\\s]', '') AS {kind})") if isinstance(c, str) else F.regexp_replace(c, r"[,\s]", "").try_cast(kind)
