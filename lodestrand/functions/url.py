"""Url scalars as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F


def hostname(url: Column) -> Column:
    """FN-10: the lower-cased host without port and credentials; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def registered_domain(url: Column) -> Column:
    """FN-10: the last two labels of the host."""
    labels = F.split(hostname(url), "[.]")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(hostname(url))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_pdf(url: Column) -> Column:
    """FN-10"""
    return F.lower(url_path(url)).endswith(".pdf")


def on_domain(host: Column, domain: Column) -> Column:
    """FLT-10: the host is the domain or a subdomain of it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def without_dots(path: Column) -> Column:
    """A path from the root without its . and .. segments; .. at the root is dropped."""

    def step(done: Column, segment: Column) -> Column:
        shorter = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(segment == "..", shorter).when(segment == ".", done).otherwise(F.array_append(done, segment))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    plain = F.concat(joined, F.when(path.rlike(r"/[.]{1,2}$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/[.]{1,2}(/|$)"), plain).otherwise(path)


def resolve(link: Column, base: Column) -> Column:
    """Joins a link to its page's url: absolute, protocol-relative, root-relative or relative, also with . and .. segments."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.when(url_path(base) == "", F.lit("/")).otherwise(url_path(base)), r"(?<=/)[^/]*$", "")
    path, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, without_dots(path), tail))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), tail))
    )


def page_links(html: Column, base: Column) -> Column:
    """FN-08: the distinct http links of a page, absolute, in order of first appearance."""
    raw = F.regexp_extract_all(html, F.lit(r"""href=["'](.*?)["']"""), F.lit(1))
    kept = F.filter(raw, lambda x: ~x.rlike(r"^(#|javascript:|mailto:|tel:)"))
    return F.array_distinct(F.filter(F.transform(kept, lambda x: resolve(x, base)), lambda x: x.rlike("^https?://")))


def followed(link: Column, follow: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """FLT-06: no excluded pattern is found, and one of the follow patterns is, if there are any."""
    out = F.lit(True)
    for p in exclude:
        out = out & ~link.rlike(p)
    if follow:
        found = F.lit(False)
        for p in follow:
            found = found | link.rlike(p)
        out = out & found
    return out


#: Ranges that a fetched host may not lie in: fixed values.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")


def safe_url(url: Column) -> Column:
    """FLT-08: an http url with a host, without credentials, that isn't local, private or reserved.

    A host whose last label is a number is an address, and only four plain octets are taken for one: 10.0.0.1234, 127.1 and
    0x7f000001 are read in ways that differ.
    """
    host = hostname(url)
    octets = F.split(host, "[.]")
    number = sum((F.get(octets, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    private = F.lit(False)
    for net in map(ipaddress.ip_network, PRIVATE):
        private = private | number.between(int(net.network_address), int(net.broadcast_address))
    address = host.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)\.?$")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    public = host.rlike(rf"^{octet}([.]{octet}){{3}}$") & ~F.coalesce(private, F.lit(True))
    plain = url.rlike(r"(?i)^https?://[^/?#]") & ~F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1).contains("@")
    local = host.rlike(r"(^|\.)localhost\.?$") | host.startswith("[")
    return F.coalesce(plain & (host != "") & ~local & (~address | public), F.lit(False))


def dead(status: Column, valid: Column) -> Column:
    """FLT-09: not valid, or answered with 404, 410 or 451; a null status (network error) is alive."""
    return ~valid | F.coalesce(status.isin(404, 410, 451), F.lit(False))
