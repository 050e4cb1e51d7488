"""URL resolution and the check against addresses that are not public.

Both are columns, made of Spark's functions alone, and Python functions that give the same
answers inside tasks that are Python anyway: the lexer and the requests.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.columns import let, search

#: Address ranges, host names and domains that are not public.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24",
    "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
    "240.0.0.0/4",
)
BLOCKED_V6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "100:0:0:1::/64", "2001::/23", "2001:db8::/32", "2620:4f:8000::/48", "3fff::/20", "5f00::/16",
    "fc00::/7", "fe80::/10", "ff00::/8",
)
EMBEDDED_V4 = (
    "::ffff:0:0/96", "::/96", "64:ff9b::/96",
)
BLOCKED_HOSTS = (
    "localhost", "localhost.localdomain", "metadata", "metadata.google.internal", "metadata.azure.com",
)
BLOCKED_DOMAINS = (
    ".local", ".localhost", ".internal", ".intranet", ".corp", ".home", ".lan",
)
FORBIDDEN_SCHEMES = ("file://", "data:", "javascript:", "ftp://", "gopher://")
ABSOLUTE = ("http://", "https://", "mailto:", "tel:")

WEB = ("http", "https")

_V4, _V6, _EMBEDDED = ([ipaddress.ip_network(x) for x in ranges] for ranges in (BLOCKED_V4, BLOCKED_V6, EMBEDDED_V4))
#: Scheme, authority, path, query and fragment of a reference.
_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_PARTS = re.compile(_REFERENCE.removesuffix("$"), re.S)
_EDGES, _BREAKS = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\r\n]"
_AUTHORITY = r"^(?i)https?://([^/?#]*)"
_BRACKETED = r"^\[([^\]%]*)(?:%[^\]]*)?\](?::[0-9]*)?$"
#: A host of plain letters and numbers, as most are, directly behind the scheme.
_PLAIN = re.compile(r"https?://([A-Za-z0-9.-]+)(?:[/?#]|\Z)", re.I)
_BREAK = re.compile(_BREAKS)
_HEX, _OCTAL, _DECIMAL = r"^0x[0-9a-f]+$", r"^0[0-7]*$", r"^[1-9][0-9]*$"


# Python ----------------------------------------------------------------------


def is_public(address: str) -> bool:
    """Whether an IP address is outside all blocked ranges."""
    ip = ipaddress.ip_address(address)
    if ip.version == 6:
        low = int(ip) & 0xFFFFFFFF
        inside = [n for n in _EMBEDDED if ip in n]
        if inside and not (inside[0].network_address == ipaddress.ip_address("::") and low <= 1):
            ip = ipaddress.IPv4Address(low)
    return not any(ip in n for n in (_V4 if ip.version == 4 else _V6))


def _as_v4(host: str) -> ipaddress.IPv4Address | None:
    """A host of one to four numbers, decimal, octal or hexadecimal, as an address."""
    numbers = [int(x, base) for x in host.rstrip(".").split(".") for p, base in ((_HEX, 16), (_OCTAL, 8), (_DECIMAL, 10)) if len(x) < 40 and re.match(p, x)]
    *high, low = numbers or [-1]
    if len(numbers) != host.rstrip(".").count(".") + 1 or len(numbers) > 4 or any(x >= 256 for x in high) or not 0 <= low < 256 ** (5 - len(numbers)):
        return None
    return ipaddress.IPv4Address(sum(x << 8 * (3 - k) for k, x in enumerate(high)) + low)


def is_safe(url: str) -> bool:
    """Whether a URL is http or https and its host is not known to be internal."""
    m = _PLAIN.match(url)
    return _is_safe_host(m[1].lower()) if m else _is_safe(url)


@lru_cache(1 << 16)
def _is_safe(url: str) -> bool:
    m = re.match(_AUTHORITY.replace("^(?i)", "(?i)"), re.sub(_BREAKS, "", re.sub(_EDGES, "", url)))
    if m is None or "\\" in m[1]:
        return False
    host = m[1].rpartition("@")[2].lower()
    if "[" in host or "]" in host:
        m = re.match(_BRACKETED, host)
        try:
            return m is not None and ":" in m[1] and is_public(m[1])
        except ValueError:
            return False
    return _is_safe_host(host.partition(":")[0])


@lru_cache(1 << 16)
def _is_safe_host(host: str) -> bool:
    """As :func:`is_safe`, of a host in small letters without brackets and port."""
    address = _as_v4(host)
    if address is not None:
        return is_public(str(address))
    name = host.rstrip(".")
    return bool(name) and name not in BLOCKED_HOSTS and not name.endswith(BLOCKED_DOMAINS)


def without_dots(path: str) -> str:
    """A path from the root without segments of one or two dots."""
    if "/." not in path and path.startswith("/"):
        return path
    parts = path.split("/")[1:]
    kept: list[str] = []
    for part in parts:
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    if parts[-1] in (".", ".."):
        kept.append("")
    return "/" + "/".join(kept)


@lru_cache(64)
def _parts_of(base: str) -> tuple:
    return _PARTS.match(_BREAK.sub("", base)).groups()


def join(href: str, base: str | None) -> str:
    """``href`` made absolute against ``base``; unchanged if it is or cannot be."""
    if href.startswith(ABSOLUTE) or not base:
        return href
    scheme, host, path, query, _ = _parts_of(base)
    if scheme is None or host is None and not path.startswith("/"):
        return href
    if href == "":
        return base.split("#")[0]
    scheme = scheme.lower()
    ref = _BREAK.sub("", href)
    if scheme in WEB:
        ref = ref.replace("\\", "/")
    own_scheme, own_host, own_path, own_query, fragment = _PARTS.match(ref).groups()
    if own_scheme is not None and not (scheme in WEB and own_scheme.lower() == scheme and own_host is None):
        return href
    if own_host is not None or own_path:
        if own_host is None:
            own_path = own_path if own_path.startswith("/") else (path[: path.rfind("/") + 1] or "/") + own_path
        host = host if own_host is None else own_host
        path, query = without_dots(own_path) if own_path else "", own_query
    elif own_query is not None:
        query = own_query
    if host and not path:
        path = "/"
    return f"{scheme}:{'' if host is None else f'//{host}'}{path}{query or ''}{fragment or ''}"


def join_safe(href: str, base: str | None, resolve: bool = True) -> str:
    """``href`` joined to ``base`` unless that would reach a forbidden place.

    A join to a forbidden scheme or an internal host gives ``href`` back; an
    ``href`` that is itself the URL of an internal host gives the empty text.
    """
    return _joined(href, base, resolve) if href else _joined_empty(base, resolve)


@lru_cache(64)
def _joined_empty(base: str | None, resolve: bool) -> str:
    return _joined("", base, resolve)


def _joined(href: str, base: str | None, resolve: bool) -> str:
    found = join(href, base) if resolve else href
    low = found.lower()
    if low.startswith(FORBIDDEN_SCHEMES):
        return href
    if not low.startswith(("http://", "https://")) or is_safe(found):
        return found
    return "" if href.strip().lower().startswith(("http://", "https://")) and not is_safe(href) else href


# Columns ---------------------------------------------------------------------


def _v4_number(host: Column) -> Column:
    """A host of one to four numbers as an address of 32 bits, else null."""
    def number(x: Column) -> Column:
        text = F.when(x.rlike(_HEX), F.conv(F.substring(x, 3, 40), 16, 10)).when(x.rlike(_OCTAL), F.conv(x, 8, 10)).when(x.rlike(_DECIMAL), x)
        return F.when(F.length(x) < 40, text).try_cast("decimal(38,0)")

    def whole(x: Column) -> Column:
        n, last = F.size(x), F.try_element_at(x, F.lit(-1))
        high = F.slice(x, 1, F.greatest(n - 1, F.lit(0)))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1 << 24).cast("long").alias("one"))
        added = F.aggregate(high, start, lambda acc, y: F.struct((acc["sum"] + y.cast("long") * acc["one"]).alias("sum"), (acc["one"] / 256).cast("long").alias("one")))
        most = F.element_at(F.array(*[F.lit(256 ** (5 - k)) for k in range(1, 5)]), F.least(n, F.lit(4)))
        fine = F.forall(x, lambda y: y.isNotNull()) & (n <= 4) & F.forall(high, lambda y: y < 256) & (last < most)
        return F.when(fine, added["sum"] + last.cast("long"))

    return let(F.transform(F.split(host, r"\."), number), whole)


def _v6_digits(host: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, null if it is none."""
    quad = r"^((?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
    last = F.regexp_extract(host, r"(?:^|:)([0-9.]*\.[0-9.]*)$", 1)
    two = lambda a, b: F.lower(F.lpad(F.hex(a.try_cast("long") * 256 + b.try_cast("long")), 4, "0"))
    octet = lambda k: F.split_part(last, F.lit("."), F.lit(k))
    plain = F.when(~host.contains("."), host).when(last.rlike(quad), F.concat(F.left(host, F.length(host) - F.length(last)), two(octet(1), octet(2)), F.lit(":"), two(octet(3), octet(4))))

    def padded(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(half, ":"), lambda g: F.when(g.rlike("^[0-9a-f]{1,4}$"), F.lpad(g, 4, "0"))))

    def digits(halves: Column) -> Column:
        left, right = padded(F.get(halves, F.lit(0))), padded(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        groups, n = F.concat(left, right), F.size(left) + F.size(right)
        filled = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), F.lit(8) - n), F.array_join(right, ""))
        fine = F.forall(groups, lambda g: g.isNotNull()) & ((F.size(halves) == 2) & (n <= 7) | (F.size(halves) == 1) & (n == 8))
        return F.when(fine, filled)

    return let(plain, lambda p: F.when(~p.contains(":::"), let(F.split(p, "::"), digits)))


def _bounds(networks: list, write) -> list[tuple]:
    """The first and last addresses of networks, in order."""
    return sorted((write(int(n.network_address)), write(int(n.broadcast_address))) for n in networks)


def _public_v4(number: Column) -> Column:
    return ~search(number, _bounds(_V4, int))


def _public_v6(digits: Column) -> Column:
    """By comparison of digits, as addresses of 128 bits fit no number."""
    low = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long")
    inside = F.lit(False)
    for n in _EMBEDDED:
        head = f"{int(n.network_address):032x}"[:24]
        inside |= digits.startswith(head) & ((low > 1) if int(n.network_address) == 0 else F.lit(True))
    return F.when(inside, _public_v4(low)).otherwise(~search(digits, _bounds(_V6, lambda x: f"{x:032x}")))


def is_safe_url(url: Column) -> Column:
    """Whether a URL is http or https and its host is not known to be internal; null for null."""
    plain = F.regexp_replace(F.regexp_replace(url, _EDGES, ""), _BREAKS, "")
    authority = F.regexp_extract(plain, _AUTHORITY, 1)

    def named(host: Column) -> Column:
        name = F.regexp_replace(host, r"\.+$", "")
        listed = name.isin(*BLOCKED_HOSTS)
        for domain in BLOCKED_DOMAINS:
            listed |= name.endswith(domain)
        return let(_v4_number(name), lambda v: F.when(v.isNotNull(), _public_v4(v)).otherwise((name != "") & ~listed))

    def checked(host: Column) -> Column:
        inner = F.regexp_extract(host, _BRACKETED, 1)
        v6 = let(F.when(inner.contains(":"), _v6_digits(inner)), lambda d: d.isNotNull() & _public_v6(d))
        return F.when(host.contains("[") | host.contains("]"), F.coalesce(v6, F.lit(False))).otherwise(let(F.split_part(host, F.lit(":"), F.lit(1)), named))

    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    return F.when(url.isNull(), F.lit(None).cast("boolean")).when(~plain.rlike(_AUTHORITY) | authority.contains("\\"), F.lit(False)).otherwise(let(host, checked))


def _split(url: Column) -> Column:
    """The parts of a reference; those that it lacks are null, but for the path."""
    part = lambda k: F.regexp_extract(url, f"(?s){_REFERENCE}", k)
    rest = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:", "")).otherwise(url)
    return F.struct(F.nullif(part(1), F.lit("")).alias("scheme"), F.when(rest.startswith("//"), part(2)).alias("host"), part(3).alias("path"), F.nullif(part(4), F.lit("")).alias("query"), part(5).alias("fragment"))


def _dotless(path: Column) -> Column:
    """As :func:`without_dots`: a fold over the segments."""
    def folded(parts: Column) -> Column:
        step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.array_append(acc, p))
        kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
        last = F.try_element_at(parts, F.lit(-1))
        return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, "")).otherwise(kept), "/"))

    return let(F.split(path, "/"), folded)


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` made absolute against ``base``, by RFC 3986; unchanged if it is or cannot be."""
    web = lambda b: F.lower(b["scheme"]).isin(*WEB)

    def joined(b: Column, r: Column) -> Column:
        foreign = r["scheme"].isNotNull() & ~(web(b) & (F.lower(r["scheme"]) == F.lower(b["scheme"])) & r["host"].isNull())
        has_path = r["path"] != ""
        folder = F.regexp_extract(b["path"], r"(?s)^(.*/)", 1)
        merged = F.when(r["host"].isNotNull() | r["path"].startswith("/"), r["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), r["path"]))
        own = r["host"].isNotNull() | has_path
        host = F.coalesce(r["host"], b["host"])
        path = F.when(~own, b["path"]).when(has_path, _dotless(merged)).otherwise("")
        path = F.when((host != "") & (path == ""), "/").otherwise(path)
        query = F.when(own, r["query"]).otherwise(F.coalesce(r["query"], b["query"]))
        whole = F.concat(F.lower(b["scheme"]), F.lit(":"), F.coalesce(F.concat(F.lit("//"), host), F.lit("")), path, F.coalesce(query, F.lit("")), r["fragment"])
        return F.when(~foreign, whole)

    def against(b: Column) -> Column:
        plain = F.regexp_replace(href, _BREAKS, "")
        ref = F.when(web(b), F.replace(plain, F.lit("\\"), F.lit("/"))).otherwise(plain)
        flat = b["scheme"].isNull() | b["host"].isNull() & ~b["path"].startswith("/")
        return F.when(flat, href).when(href == "", F.split_part(base, F.lit("#"), F.lit(1))).otherwise(F.coalesce(let(_split(ref), lambda r: joined(b, r)), href))

    fixed = F.lit(False)
    for start in ABSOLUTE:
        fixed |= href.startswith(start)
    return F.when(fixed | base.isNull() | (base == ""), href).otherwise(let(_split(F.regexp_replace(base, _BREAKS, "")), against))


def resolve_safe(href: Column, base: Column) -> Column:
    """As :func:`resolve_url`, without reaching forbidden places; see :func:`join_safe`."""
    def starts(c: Column, marks: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for m in marks:
            found |= F.lower(c).startswith(m)
        return found

    def judged(found: Column) -> Column:
        own = F.regexp_replace(href, r"^\s+|\s+$", "")
        return F.when(starts(found, FORBIDDEN_SCHEMES), href).when(~starts(found, ("http://", "https://")) | is_safe_url(found), found).when(starts(own, ("http://", "https://")) & ~is_safe_url(href), "").otherwise(href)

    return let(resolve_url(href, base), judged)


def combine_bases(parent: Column, child: Column) -> Column:
    """The base URL inside an element that has a base of its own."""
    return F.when(child.isNotNull(), resolve_url(child, parent)).otherwise(parent)
