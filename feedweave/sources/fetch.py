"""Fetching feeds: conditional requests, checked addresses, bounded redirects."""

from __future__ import annotations

import http.client
import socket
import ssl
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.functions.urls import is_public, is_safe

ACCEPT = "application/rss+xml, application/atom+xml, application/feed+json, application/json;q=0.9, application/xml;q=0.8, text/xml;q=0.8, */*;q=0.1"
MOST_REDIRECTS, MOST_AGENT, MOST_ETAG, MOST_MODIFIED = 10, 512, 1024, 64
#: Answers are sent on when they come to this many bytes, or the first of them has waited for this many seconds.
BATCH_BYTES, BATCH_SECONDS = 1 << 20, 1.0
RESPONSE = "status int, href string, etag string, modified string, content_type string, headers map<string,string>, body binary, fetch_error string"


@dataclass
class Response:
    """What a transport returns for one request."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


Transport = Callable[[str, dict[str, str], float, int], Response]


def addresses(host: str, port: int) -> list[str]:
    """The public addresses of a host; an error if it has none."""
    found = [x[4][0] for x in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
    public = [a for a in dict.fromkeys(found) if is_public(a.split("%")[0])]
    if not public:
        raise OSError(f"no public address for {host}")
    return public


def over_network(url: str, headers: dict[str, str], timeout: float, most: int) -> Response:
    """One GET to an address that was checked, so that a name cannot change meanwhile."""
    until = time.monotonic() + timeout
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    sock = socket.create_connection((addresses(parts.hostname, port)[0], port), timeout)
    if parts.scheme == "https":
        sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
    connection = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
    connection.sock = sock
    try:
        sock.settimeout(left(until))
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
        answer = connection.getresponse()
        return Response(answer.status, dict(answer.getheaders()), received(answer.read1, sock.settimeout, until, most))
    finally:
        connection.close()


def left(until: float) -> float:
    """The seconds until a moment; an error if it has passed."""
    now = until - time.monotonic()
    if now <= 0:
        raise TimeoutError("the exchange took too long")
    return now


def received(read: Callable[[int], bytes], wait: Callable[[float], None], until: float, most: int) -> bytes:
    """A body in the pieces that arrive, until its end, ``most`` bytes and one more, or a moment."""
    body = bytearray()
    while len(body) <= most:
        wait(left(until))
        part = read(min(1 << 16, most + 1 - len(body)))
        if not part:
            break
        body += part
    return bytes(body)


def inflated(body: bytes, kind: int, most: int) -> bytes:
    """One or more compressed streams; an error as soon as there are more than ``most`` bytes."""
    out = bytearray()
    while body:
        stream = zlib.decompressobj(kind)
        out += stream.decompress(body, most + 1 - len(out))
        if len(out) > most:
            raise ValueError(f"body exceeds {most} bytes")
        if not stream.eof:
            raise EOFError("the compressed body ends early")
        body = stream.unused_data.lstrip(b"\0")
    return bytes(out)


def unpacked(body: bytes, coding: str, most: int) -> bytes:
    """A body without its content coding, of at most ``most`` bytes; no more is ever held."""
    if coding in ("gzip", "x-gzip"):
        return inflated(body, 31, most)
    if coding == "deflate":
        try:
            return inflated(body, 15, most)
        except zlib.error:
            return inflated(body, -15, most)
    if len(body) > most:
        raise ValueError(f"body exceeds {most} bytes")
    return body


def fetch(url: str, etag: str | None, modified: str | None, transport: Transport, agent: str, timeout: float, most: int, extra: dict[str, str]) -> dict:
    """One document, as a row of :data:`RESPONSE`. Every hop's address is checked.

    ``timeout`` is for all hops together.
    """
    until = time.monotonic() + timeout
    row = {n.split()[0]: None for n in RESPONSE.split(", ")}
    headers = {"User-Agent": agent[:MOST_AGENT], "Accept": ACCEPT, "Accept-Encoding": "gzip, deflate", **extra}
    if etag and len(etag) <= MOST_ETAG:
        headers["If-None-Match"] = etag
    if modified and len(modified) <= MOST_MODIFIED:
        headers["If-Modified-Since"] = modified
    try:
        for _ in range(MOST_REDIRECTS + 1):
            if not is_safe(url):
                raise ValueError(f"address not allowed: {url}")
            answer = transport(url, headers | {"Host": urlsplit(url).netloc}, left(until), most)
            low = {k.lower(): v for k, v in answer.headers.items()}
            if answer.status in (301, 302, 303, 307, 308) and "location" in low:
                url = urljoin(url, low["location"])
                continue
            row |= {"status": answer.status, "href": url, "headers": list(low.items()), "content_type": low.get("content-type")}
            if answer.status == 304:
                return row | {"etag": etag, "modified": modified}
            if answer.status >= 400:
                raise ValueError(f"HTTP status {answer.status}")
            return row | {"etag": low.get("etag"), "modified": low.get("last-modified"), "body": unpacked(answer.body, low.get("content-encoding", "").lower(), most)}
        raise ValueError(f"over {MOST_REDIRECTS} redirects")
    except Exception as e:  # noqa: BLE001  an answer of any kind is a row, not the end of the job
        return row | {"fetch_error": causes(e)}


def causes(error: BaseException | None) -> str:
    """An error and all that it came from, as text."""
    parts = []
    while error is not None:
        parts.append(str(error) or type(error).__name__)
        error = error.__cause__ or error.__context__
    return ": ".join(dict.fromkeys(parts))


def weight(row: dict) -> int:
    """About the bytes that an answer takes."""
    return len(row["body"] or b"") + sum(len(k) + len(v or "") for k, v in row["headers"] or ()) + len(row["href"] or "") + len(row["fetch_error"] or "")


def fetch_feeds(urls: DataFrame, url: str = "url", etag: str | None = None, modified: str | None = None, transport: Transport = over_network, agent: str = "feedweave/0.1", timeout: float = 30.0, most: int = 100 << 20, extra: dict[str, str] | None = None, partitions: int = 64) -> DataFrame:
    """``urls`` with the answer to a GET of each: see :data:`RESPONSE`.

    Requests of one host go through at most four tasks, in each one after another. ``etag`` and
    ``modified`` name columns of the last answer's validators: an unchanged
    document has status 304, no body and these again. A failed request has a
    ``fetch_error``; nothing ends the job.
    """
    host = F.expr(f"try_parse_url(`{url}`, 'HOST')")
    # hosts with very many feeds are dealt over a few tasks
    rows = urls.repartition(partitions, host, F.pmod(F.xxhash64(url), F.lit(4)))
    names = [f.split()[0] for f in RESPONSE.split(", ")]
    agent, timeout, extra = agent[:MOST_AGENT], min(timeout, 3600.0), extra or {}
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    keep, nothing = urls.columns, dict.fromkeys(names)

    def packed(asked: pa.RecordBatch, answers: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(asked.column(c) for c in keep), *(pa.array([a[n] for a in answers], t) for n, t in zip(names, kinds))], names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [batch.column(c).to_pylist() if c else [None] * batch.num_rows for c in (url, etag, modified)]
            first, size, answers, began = 0, 0, [], time.monotonic()
            for k, (address, tag, since) in enumerate(zip(*asked)):
                got = fetch(address, tag, since, transport, agent, timeout, most, extra) if address else nothing
                more = weight(got)
                if answers and size + more > BATCH_BYTES:  # a large body goes alone
                    yield packed(batch.slice(first, len(answers)), answers)
                    first, size, answers, began = k, 0, [], time.monotonic()
                answers.append(got)
                size += more
                if k + 1 == batch.num_rows or size >= BATCH_BYTES or time.monotonic() - began >= BATCH_SECONDS:
                    yield packed(batch.slice(first, len(answers)), answers)
                    first, size, answers, began = k + 1, 0, [], time.monotonic()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields), RESPONSE])
    return rows.mapInArrow(run, schema)
