"""Mail as a Spark data source: pages of a search as a batch, the history of a mailbox as a stream.

    spark.dataSource.register(MailSource)
    spark.read.format("mail").option("path", folder).load()
    spark.readStream.format("mail").option("path", folder).load()

A partition is a page: the driver follows page tokens only, tasks fetch the messages. The stream's offset is the mailbox's history
id. A start that the mailbox no longer knows makes that batch a full search again, so its messages can come twice: put
``deduplicated`` or ``append_once`` behind it, as after any source that delivers at least once.
"""

from __future__ import annotations

import base64
import binascii
import importlib
import json
import time
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerloom.functions.messages import plain_body
from ledgerloom.functions.text import html_text

SCHEMA = "id string, thread_id string, history_id long, internal_date long, snippet string, payload string"
#: A search is followed over so many pages; a wider one has to be split.
MAX_PAGES = 500
#: What a request costs, and the units that all tasks may use in a second.
REQUEST_UNITS, UNITS_PER_SECOND = 5, 250


class UnknownHistory(Exception):
    """The mailbox doesn't know, or no longer knows, the history id."""


class RecordedMailbox:
    """Answers of a mail service kept as files of JSON: ``profile``, ``search/<page>``, ``history/<start>[-<page>]``, ``messages/<id>``.

    A page of a search or a history has ``nextPageToken`` unless it is the last; the first page of a search is ``first``.
    """

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _read(self, name: str) -> dict | None:
        try:
            with self.files.open_input_file(f"{self.path}/{name}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def history_id(self) -> int:
        return int((self._read("profile") or {}).get("historyId") or 0)

    def search(self, token: str | None) -> tuple[list[str], str | None]:
        page = self._read(f"search/{token or 'first'}") or {}
        return [m["id"] for m in page.get("messages") or []], page.get("nextPageToken")

    def history(self, start: int, token: str | None) -> tuple[list[tuple[int, str]], str | None]:
        """(history id, message id) of what was added after ``start``."""
        page = self._read(f"history/{start}" + (f"-{token}" if token else ""))
        if page is None:
            raise UnknownHistory(start)
        return [(int(r["id"]), a["message"]["id"]) for r in page.get("history") or [] for a in r.get("messagesAdded") or []], page.get("nextPageToken")

    def message(self, name: str) -> dict | None:
        return self._read(f"messages/{name}")


class Quota:
    """A bucket of units that fills at a steady rate; ``take`` waits until there are enough."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.units, self.at = rate, clock()

    def take(self, units: float) -> None:
        now = self.clock()
        self.units, self.at = min(self.rate, self.units + (now - self.at) * self.rate) - units, now
        if self.units < 0:
            self.sleep(-self.units / self.rate)


@dataclass
class Page(InputPartition):
    start: int | None  # None: a page of the search
    end: int
    token: str | None


class _Pages:
    """What batches and streams have in common."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        module, name = options.get("client", f"{__name__}:RecordedMailbox").split(":")
        self.client_at = module, name
        self.max_pages = int(options.get("maxpages", MAX_PAGES))
        # The driver doesn't know how many tasks run at once; this says among how many the units are shared.
        self.rate = float(options.get("unitspersecond", UNITS_PER_SECOND)) / int(options.get("tasks", 8))

    def client(self):
        module, name = self.client_at
        return getattr(importlib.import_module(module), name)(self.path)

    def search_pages(self, end: int) -> list[Page]:
        client, quota, out, token = self.client(), Quota(self.rate), [], None
        while True:
            out.append(Page(None, end, token))
            quota.take(REQUEST_UNITS)
            token = client.search(token)[1]
            if token is None:
                return out
            if len(out) >= self.max_pages:
                warnings.warn(f"the search has more than {self.max_pages} pages: split its range", stacklevel=2)
                return out

    def history_pages(self, start: int, end: int) -> list[Page]:
        client, quota, out, token = self.client(), Quota(self.rate), [], None
        while True:
            quota.take(REQUEST_UNITS)
            following = client.history(start, token)[1]
            out.append(Page(start, end, token))
            token = following
            if token is None:
                return out

    def rows(self, page: Page) -> Iterator[tuple]:
        client, quota = self.client(), Quota(self.rate)
        quota.take(REQUEST_UNITS)
        if page.start is None:
            names = client.search(page.token)[0]
        else:
            names = [name for at, name in client.history(page.start, page.token)[0] if page.start < at <= page.end]
        for name in dict.fromkeys(names):
            quota.take(REQUEST_UNITS)
            m = client.message(name)
            if m is not None:  # deleted meanwhile
                number = lambda k: int(m[k]) if m.get(k) is not None else None
                yield name, m.get("threadId"), number("historyId"), number("internalDate"), m.get("snippet"), json.dumps(m.get("payload"), ensure_ascii=False)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = _Pages(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.pages.search_pages(0)

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are history ids; 0 stands for a mailbox that was never read."""

    def __init__(self, options: dict[str, str]):
        self.pages = _Pages(options)
        self.first = int(options.get("starthistoryid", 0))

    def initialOffset(self) -> dict:
        return {"history": self.first}

    def latestOffset(self) -> dict:
        return {"history": self.pages.client().history_id()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["history"] == end["history"]:
            return []
        if not start["history"]:
            return self.pages.search_pages(end["history"])
        try:
            return self.pages.history_pages(start["history"], end["history"])
        except UnknownHistory:
            return self.pages.search_pages(end["history"])

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition)


class MailSource(DataSource):
    """Options: path; client (module:class, ``RecordedMailbox`` by default); maxPages; unitsPerSecond and tasks; startHistoryId."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _decoded(data: str | None) -> bytes | None:
    if data is None:
        return None
    try:
        return base64.b64decode(data + "=" * (-len(data) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None


def walk_parts(payload: str | None) -> dict:
    """The first plain and the first HTML text of a message's tree of parts, and its PDFs in order, whatever their depth."""
    out: dict = {"plain": None, "html": None, "pdfs": [], "skipped": []}
    try:
        root = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        root = None
    waiting = [root]
    while waiting:
        part = waiting.pop()
        if not isinstance(part, dict):
            continue
        kind, name = part.get("mimeType") or "", part.get("filename")
        body = part.get("body") if isinstance(part.get("body"), dict) else {}
        if kind in ("text/plain", "text/html"):
            at, data = kind.removeprefix("text/"), _decoded(body.get("data"))
            if out[at] is None and data is not None:
                out[at] = data.decode("utf-8", "replace")
        elif kind == "application/pdf" or name and name.lower().endswith(".pdf"):
            name, data = name if name is not None else "statement.pdf", _decoded(body.get("data"))
            if body.get("attachmentId") is None and data is None:
                out["skipped"].append(name)
            else:
                out["pdfs"].append({"filename": name, "attachment_id": body.get("attachmentId"), "content": data})
        waiting.extend(reversed(part.get("parts") or []))
    return out


_PDF = T.StructType([T.StructField("filename", T.StringType()), T.StructField("attachment_id", T.StringType()), T.StructField("content", T.BinaryType())])
_PARTS = T.StructType([T.StructField("plain", T.StringType()), T.StructField("html", T.StringType()), T.StructField("pdfs", T.ArrayType(_PDF)), T.StructField("skipped", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARTS)
def _walked(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([walk_parts(p) for p in payload], columns=["plain", "html", "pdfs", "skipped"])


def message_parts(payload: Column) -> Column:
    """struct(plain, html, pdfs, skipped) of a message's JSON tree of parts: decoded, but not cleaned; nulls where there is none."""
    return _walked(payload)


def body_text(parts: Column) -> Column:
    """What is read of a message: its plain text, or the text of its HTML where that is missing or blank, without quotes and signature."""
    blank = F.coalesce(F.trim(F.regexp_replace(parts["plain"], r"\s+", " ")), F.lit("")) == ""
    return plain_body(F.when(blank, F.coalesce(html_text(parts["html"]), parts["plain"])).otherwise(parts["plain"]))


def read_bodies(messages: DataFrame) -> DataFrame:
    """id, text, pdfs (filename, attachment_id, content), skipped (PDFs with neither) of messages as ``MailSource`` gives them."""
    # The walk stands in a column of its own, so that it is made once.
    walked = messages.select("id", message_parts(F.col("payload")).alias("_parts"))
    return walked.select("id", body_text(F.col("_parts")).alias("text"), "_parts.pdfs", "_parts.skipped")
