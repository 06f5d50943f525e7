"""Payloads for callers: small results as plain dicts, request rules, and a result cache."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from sufragio.functions.labels import MUNICIPAL_OFFICES
from sufragio.operators.filters import Scope, folded, search_key

DEFAULT_PAGE, MAX_PAGE, BROAD_PAGE, MAX_DISTRIBUTION = 20, 100, 50, 500


class RequestError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def one_year(ano: int | None, year: int | None) -> int | None:
    """The year under either name; two different ones are an error."""
    if ano is not None and year is not None and ano != year:
        raise RequestError(400, "ano and year differ")
    return ano if ano is not None else year


def checked_round(turno: int | None) -> int | None:
    if turno not in (None, 1, 2):
        raise RequestError(422, "turno must be 1 or 2")
    return turno


def page_size(scope: Scope, asked: int | None, limit: int = MAX_PAGE) -> int:
    """At least 1, at most the limit, and less where nothing narrows the query."""
    size = min(max(asked or DEFAULT_PAGE, 1), limit)
    return min(size, BROAD_PAGE) if scope.broad else size


def needs_year(office: str | None, year: int | None) -> None:
    if folded(office or "") in MUNICIPAL_OFFICES and year is None:
        raise RequestError(400, "a municipal office needs a year")


def search_text(q: str, scope: Scope) -> str | None:
    """Folded query; None where it is too short to search the whole country."""
    if len(folded(q)) < 2:
        raise RequestError(422, "q needs two letters")
    key = search_key(q, scope)
    return key and key.lower()


#: Rows of a payload at most; more are the caller's error, not a reason to fill the driver.
MAX_ROWS = 10_000


def payload(df: DataFrame, digits: int | None = None) -> list[dict]:
    """A result of at most MAX_ROWS rows as dicts, doubles rounded as Python rounds."""
    rows = [r.asDict(recursive=True) for r in df.take(MAX_ROWS + 1)]
    if len(rows) > MAX_ROWS:
        raise RequestError(413, f"more than {MAX_ROWS} rows; ask for a page")
    return [{k: round(v, digits) if digits is not None and isinstance(v, float) else v for k, v in r.items()} for r in rows]


def paged(df: DataFrame, total: int, page: int, size: int) -> dict:
    return {"page": page, "page_size": size, "total": total, "total_pages": -(-total // size), "items": payload(df)}


def failure(code: str, message: str, trace: str, retryable: bool = False) -> dict:
    return {"code": code, "message": message, "traceId": trace, "retryable": retryable}


class ResultCache:
    """Least recently used results with a lifetime, bounded in entries and bytes. A key names the
    data version, the endpoint and the parameters in order; after a failure the stale value of a
    key is still served."""

    def __init__(self, entries: int = 256, total: int = 16 << 20, each: int = 256 << 10, clock: Callable[[], float] = time.monotonic):
        self.entries, self.total, self.each, self.clock = entries, total, each, clock
        self.held: OrderedDict[str, tuple[float, bytes]] = OrderedDict()
        self.size = 0

    @staticmethod
    def key(version: str, endpoint: str, parameters: dict) -> str:
        return f"{version}:{endpoint}:{json.dumps(parameters, sort_keys=True, ensure_ascii=False, default=str)}"

    def get(self, key: str, stale: bool = False):
        if key not in self.held or (not stale and self.held[key][0] < self.clock()):
            return None
        self.held.move_to_end(key)
        return json.loads(self.held[key][1])

    def put(self, key: str, value: object, seconds: float) -> None:
        body = json.dumps(value, ensure_ascii=False, default=str).encode()
        if len(body) > self.each:
            return
        if key in self.held:
            self.size -= len(self.held.pop(key)[1])
        self.held[key] = (self.clock() + seconds, body)
        self.size += len(body)
        while len(self.held) > self.entries or self.size > self.total:
            self.size -= len(self.held.popitem(last=False)[1][1])

    def run(self, key: str, seconds: float, query: Callable[[], object], empty: object = None):
        """The cached value, else the query's; if that fails, the stale value, else `empty`."""
        found = self.get(key)
        if found is not None:
            return found
        try:
            value = query()
        except RequestError:
            raise
        except Exception:
            old = self.get(key, stale=True)
            if old is None and empty is None:
                raise
            return old if old is not None else empty
        self.put(key, value, seconds)
        return value


def etag(value: object) -> str:
    return hashlib.sha1(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()
