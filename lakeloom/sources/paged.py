"""A paged REST feed as a data source: spark.read.format("paged_json") after register(spark).

Nobody says reliably how many pages there are, only an empty one marks the end. So a partition reads every n-th page, beginning with its own number,
until it meets an empty one: n partitions read at a time and ask at most once each beyond the end. They share the calls that the provider
allows in equal parts. A page that another run has landed is not asked for again.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

# Keys of a response that hold no rows, and the code that says there are none left.
ENVELOPE = frozenset({"meta", "user", "error", "query", "success", "credits"})
NO_DATA = "NO_DATA"


class ApiError(Exception):
    """The provider answered, but with an error."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def whole(x: object) -> int | None:
    """A number that may come as text."""
    try:
        return int(str(x))
    except ValueError:
        return None


def page_size(body: Mapping) -> int | None:
    meta = body.get("meta")
    return whole(meta.get("results-max")) if isinstance(meta, Mapping) else None


def calls_left(body: Mapping) -> int | None:
    user = body.get("user")
    return whole(user.get("ratelimit-remaining")) if isinstance(user, Mapping) else None


def is_empty(body: object) -> bool:
    """Whether a response holds no row: nothing but its envelope, or nothing in what is not."""
    return not isinstance(body, Mapping) or not any((len(v) if isinstance(v, (Mapping, list)) else v is not None) for k, v in body.items() if k not in ENVELOPE)


def checked(body: Mapping) -> Mapping:
    """The body, unless it says that it is an error: a code as text or as an object's message, or success 0."""
    said = body.get("error") if isinstance(body, Mapping) else None
    code = said if isinstance(said, str) else said.get("message") if isinstance(said, Mapping) else None
    if code or (isinstance(body, Mapping) and str(body.get("success")).lower() in ("0", "false")):
        meta = body.get("meta") if isinstance(body.get("meta"), Mapping) else {}
        raise ApiError(code or "API_ERROR", str((said.get("detail") if isinstance(said, Mapping) else None) or meta.get("description") or ""))
    return body


class Budget:
    """Calls spread over an hour: up to `calls` at once, then as they come free again."""

    def __init__(self, calls: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most = self.left = max(calls, 1.0)
        self.rate, self.clock, self.sleep, self.then = max(calls, 1e-9) / 3600, clock, sleep, clock()

    def take(self) -> None:
        now = self.clock()
        self.left, self.then = min(self.most, self.left + (now - self.then) * self.rate), now
        if self.left < 1:
            wait = (1 - self.left) / self.rate
            self.sleep(wait)
            self.left, self.then = 1.0, self.clock()
        self.left -= 1


def http_get(url: str, timeout: float) -> tuple[int, str]:
    """Status and text; a status that is an error is no exception."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


class Client:
    """Asks for pages. Connection faults and 5xx of the first base make it go over to the fallback at once and for good; these, 429 and broken bodies are
    tried again up to `retries` times, each after twice the wait. Other statuses and errors that the provider names are final."""

    def __init__(self, bases: list[str], budget: Budget, retries: int = 5, wait: float = 1.0, timeout: float = 30.0, get: Callable[[str, float], tuple[int, str]] = http_get, sleep: Callable[[float], None] = time.sleep):
        self.bases, self.at, self.budget, self.retries, self.wait, self.timeout, self.get, self.sleep = bases, 0, budget, retries, wait, timeout, get, sleep

    def url(self, endpoint: str, span: str | None, offset: int) -> str:
        parts = [self.bases[self.at].rstrip("/"), urllib.parse.quote(endpoint, safe=";,")]
        if span or offset:
            parts.append(urllib.parse.quote(span or "_", safe=",-"))
        return "/".join([*parts, str(offset)] if offset else parts)

    def page(self, endpoint: str, span: str | None, offset: int) -> tuple[str, Mapping]:
        """The page's text and what it holds."""
        attempt, last = 0, None
        while attempt <= self.retries:
            self.budget.take()
            try:
                status, text = self.get(self.url(endpoint, span, offset), self.timeout)
            except OSError as e:
                status, text, last = 599, "", e
            if status >= 500 and self.at + 1 < len(self.bases):
                self.at += 1
                continue
            if status == 200:
                try:
                    return text, checked(json.loads(text))
                except json.JSONDecodeError as e:
                    last = e
            elif status == 429 or status >= 500:
                last = last or OSError(f"status {status}")
            else:
                raise OSError(f"status {status}: {text[:200]}")
            self.sleep(self.wait * 2**attempt)
            attempt += 1
        raise OSError(f"{endpoint} {span or '_'} at {offset}: {self.retries} retries were in vain") from last


class Stride(InputPartition):
    def __init__(self, span: str, first: int, step: int, size: int):
        self.span, self.first, self.step, self.size = span, first, step, size


def _client(o: Mapping[str, str], share: int) -> Client:
    bases = [o["base"], *([o["fallback"]] if o.get("fallback") else [])]
    return Client(bases, Budget(float(o.get("calls_per_hour", "500")) / share), int(o.get("retries", "5")), float(o.get("wait", "1")), float(o.get("timeout", "30")))


def _row(o: Mapping[str, str], span: str, page: int, text: str) -> tuple:
    return (o["endpoint"], span, page, text, datetime.datetime.now(datetime.timezone.utc))


class PagedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.o = dict(options)
        self.spans = [s for s in self.o.get("ranges", "").split("|") if s] or [""]
        self.readers = int(self.o.get("readers", "4"))
        self.landed = {(s, int(p)) for s, p in json.loads(self.o.get("landed", "[]"))}

    def partitions(self) -> list[InputPartition]:
        size = whole(self.o.get("page_size"))
        if size is None:  # one call tells
            try:
                _, body = _client(self.o, 1).page(self.o["endpoint"], self.spans[0] or None, 0)
                size = page_size(body) or 100
            except ApiError as e:
                if e.code != NO_DATA:
                    raise
                size = 100
        return [Stride(s, k, self.readers, size) for s in self.spans for k in range(self.readers)]

    def read(self, partition: Stride) -> Iterator[tuple]:
        client = _client(self.o, self.readers * len(self.spans))
        most, page = int(self.o.get("max_pages", "2000")), partition.first
        while True:
            if (partition.span, page) not in self.landed:
                if page >= most:
                    raise OSError(f"{self.o['endpoint']} {partition.span or '_'} has more than max_pages = {most} pages")
                try:
                    text, body = client.page(self.o["endpoint"], partition.span or None, page * partition.size)
                except ApiError as e:
                    if e.code == NO_DATA:
                        return
                    raise
                if is_empty(body):
                    return
                yield _row(self.o, partition.span, page, text)
            page += partition.step


class PagedStream(SimpleDataSourceStreamReader):
    """Pages that were not there before, in order; the checkpoint holds the next page, so a run goes on where the last one ended."""

    def __init__(self, options: Mapping[str, str]):
        self.o = dict(options)
        self.span, self.size = self.o.get("ranges", "").split("|")[0], int(self.o.get("page_size", "100"))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def _pages(self, first: int, last: int | None) -> Iterator[tuple]:
        client = _client(self.o, 1)
        most = first + int(self.o.get("pages_per_batch", "50")) if last is None else last
        for page in range(first, most):
            try:
                text, body = client.page(self.o["endpoint"], self.span or None, page * self.size)
            except ApiError as e:
                if e.code == NO_DATA:
                    return
                raise
            if is_empty(body):
                return
            yield _row(self.o, self.span, page, text)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self._pages(start["page"], None))
        return iter(rows), {"page": start["page"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._pages(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        pass


class PagedJson(DataSource):
    """Options: endpoint, base, fallback (another base), ranges (joined by |), readers, page_size (asked for if not given), calls_per_hour (for all readers
    together), retries, wait, timeout (seconds), max_pages (more are an error), landed (JSON list of [range, page]). `base` holds the key."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "endpoint string, range string, page long, response string, fetched_at timestamp"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
