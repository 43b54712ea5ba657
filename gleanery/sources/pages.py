"""Fetched pages as a data source: one partition per host, so that the pace per host is kept within a task."""

from __future__ import annotations

import http.client
import ipaddress
import os
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "url string, host string, status string, body string, final_url string"
MAX_BYTES, PAUSE_S, PAUSE_AFTER_S, RETRIES, TIMEOUT_S = 3 << 20, 0.8, 1.5, 2, 20.0
AGENT = {"User-Agent": "gleanery/1", "Accept": "text/html,application/xhtml+xml,application/xml,application/json;q=0.9,*/*;q=0.8"}


def blocked(address: str, allow_private: bool = False) -> bool:
    """Whether an address must not be fetched: link-local and metadata addresses always, private ones unless allowed."""
    ip = ipaddress.ip_address(address)
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.is_link_local or ip.is_multicast or ip.is_unspecified or str(ip) in ("169.254.169.254", "fd00:ec2::254", "100.100.100.200"):
        return True
    return not allow_private and (ip.is_loopback or ip.is_private)


def connector(allow_private: bool) -> Callable[..., socket.socket]:
    """Opens connections; every address a name stands for is checked, and the one that was checked is the one connected to.

    As it is asked for each connection, redirects are covered and a name cannot change between the check and the connection.
    """

    def connect(address: tuple[str, int], timeout: float | None = None, source_address: tuple[str, int] | None = None) -> socket.socket:
        found = socket.getaddrinfo(*address, type=socket.SOCK_STREAM)
        if any(blocked(info[4][0], allow_private) for info in found):
            raise PermissionError(f"{address[0]} is not to be fetched")
        error: OSError | None = None
        for family, kind, protocol, _, where in found:
            s = socket.socket(family, kind, protocol)
            try:
                s.settimeout(timeout)
                s.connect(where)
                return s
            except OSError as e:
                s.close()
                error = e
        raise error or OSError(f"{address[0]} has no address")

    return connect


def _opener(allow_private: bool) -> urllib.request.OpenerDirector:
    connect = connector(allow_private)

    def guarded(kind: type) -> Callable[..., http.client.HTTPConnection]:
        def make(*args: object, **kwargs: object) -> http.client.HTTPConnection:
            connection = kind(*args, **kwargs)
            connection._create_connection = connect
            return connection

        return make

    class Plain(urllib.request.HTTPHandler):
        def http_open(self, req: urllib.request.Request) -> object:
            return self.do_open(guarded(http.client.HTTPConnection), req)

    class Secure(urllib.request.HTTPSHandler):
        def https_open(self, req: urllib.request.Request) -> object:
            return self.do_open(guarded(http.client.HTTPSConnection), req, context=ssl.create_default_context())

    return urllib.request.build_opener(urllib.request.ProxyHandler({}), Plain, Secure)


def fetch_http(url: str, allow_private: bool = False, headers: dict[str, str] | None = None) -> tuple[str, str]:
    """The body of a page, of MAX_BYTES at most, and the URL it came from in the end; tried again after errors and 5xx, with growing pauses."""
    opener = _opener(allow_private)
    for attempt in range(RETRIES + 1):
        try:
            with opener.open(urllib.request.Request(url, headers={**AGENT, **(headers or {})}), timeout=TIMEOUT_S) as r:
                return r.read(MAX_BYTES).decode(r.headers.get_content_charset() or "utf-8", "replace"), r.geturl()
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == RETRIES:
                raise
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt == RETRIES or isinstance(getattr(e, "reason", None), PermissionError):
                raise
        time.sleep(PAUSE_AFTER_S * 2**attempt)
    raise AssertionError


def fetch_file(url: str, root: str) -> str:
    """The body kept for a URL in a folder, by its quoted name; for tests and replays."""
    with open(os.path.join(root, quote(url, safe="")), encoding="utf-8", errors="replace") as f:
        return f.read(MAX_BYTES)


class _Host(InputPartition):
    def __init__(self, host: str, urls: list[str]) -> None:
        super().__init__(host)
        self.host, self.urls = host, urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.root, self.private = options.get("root"), options.get("allowprivate", "false") == "true"

    def partitions(self) -> list[_Host]:
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).hostname or "", []).append(u)
        return [_Host(h, us) for h, us in by.items()] or [_Host("", [])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            if i and not self.root:
                time.sleep(PAUSE_S)
            try:  # a page that fails is a row that says so, and no other page suffers
                body, final = (fetch_file(url, self.root), url) if self.root else fetch_http(url, self.private)
                yield url, partition.host, "ok", body, final
            except Exception as e:
                yield url, partition.host, f"error: {type(e).__name__}", None, None


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", ...)``; ``root`` reads kept bodies from a folder instead of the network."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
