"""URLs, headers, cookies and bodies of pages and responses as Column expressions."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import stripped

# Headers to keep, to redact, and marks of pages that only scripts fill.
KEEP = ("content-type", "content-length", "content-encoding", "transfer-encoding", "location", "date", "server", "retry-after", "last-modified", "etag")
KEEP_PREFIXES = ("x-ratelimit-", "x-rate-limit-", "ratelimit-", "x-request-id", "x-correlation-")
REDACT = ("set-cookie", "cookie", "authorization")
TEXT_TYPES = ("text/", "application/json", "application/xml", "application/xhtml", "application/javascript", "application/ld+json")
SHELL = r"""(?is)<div\s+id="root"\s*>\s*</div>|<div\s+id="app"\s*>\s*</div>|Please enable JavaScript|You need to enable JavaScript|<noscript>.*?</noscript>"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
MIN_TEXT, SERVER_CHARS = 200, 200


def normal_url(url: Column) -> Column:
    """The URL with https:// where it has no scheme; null if it is empty, not http(s), or has no proper host."""
    s = stripped(url)
    full = F.when(s.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = F.regexp_extract(full, r"^(?i:https?)://([^/?#]*)", 1)
    return F.when((s != "") & (host != "") & ~host.rlike(r"\s"), full)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(normal_url(url), r"^[^:]+://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def content_type(header: Column) -> Column:
    return F.lower(stripped(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def is_downloadable(type_: Column) -> Column:
    low = F.lower(type_)
    return low.startswith("text/html") | low.startswith("text/plain") | low.startswith("application/xhtml+xml")


def html_title(html: Column) -> Column:
    """The title's text with its entities resolved, at most 200 characters; null without a title or text in it."""
    return _shown(F.when(html.rlike(TITLE), F.regexp_extract(html, TITLE, 1)))


def _plain(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: unescape(t).strip()[:200] or None, na_action="ignore")


def _shown(title: Column) -> Column:
    return F.pandas_udf(_plain, T.StringType())(title)


def bare_text(html: Column) -> Column:
    """A page without its tags."""
    return stripped(F.regexp_replace(html, r"<[^>]+>", ""))


def needs_script(html: Column) -> Column:
    """Whether a page shows little or nothing before its scripts run."""
    return (F.length(bare_text(html)) < MIN_TEXT) | html.rlike(SHELL)


def redacted_cookie(value: Column) -> Column:
    """Set-Cookie values without the cookies' values; attributes stay."""

    def one(segment: Column) -> Column:
        parts = F.transform(F.split(segment, ";"), stripped)
        name = F.substring_index(parts[0], "=", 1)
        first = F.when(parts[0].contains("="), F.concat(name, F.lit("=<redacted>"))).otherwise(parts[0])
        return F.concat_ws("; ", F.array(first), F.slice(parts, F.lit(2), F.size(parts)))

    return F.concat_ws(", ", F.transform(F.split(value, ", "), one))


def kept_headers(headers: Column, everything: bool = False, redact: bool = True) -> Column:
    """Headers to show of an array of (name, value): an array of (name, value, redacted)."""

    def shown(h: Column) -> Column:
        low = F.lower(h["name"])
        secret = low.isin(*REDACT)
        hidden = F.when(low == "set-cookie", redacted_cookie(h["value"])).otherwise("<redacted>")
        value = F.when(secret, hidden if redact else h["value"]).when(
            (low == "server") & F.lit(not everything), F.substring(h["value"], 1, SERVER_CHARS)
        ).otherwise(h["value"])
        return F.struct(h["name"].alias("name"), value.alias("value"), (secret & F.lit(redact)).alias("redacted"))

    def keep(h: Column) -> Column:
        low = F.lower(h["name"])
        prefix = F.lit(False)
        for p in KEEP_PREFIXES:
            prefix = prefix | low.startswith(p)
        return low.isin(*REDACT) | F.lit(everything) | low.isin(*KEEP) | prefix

    return F.transform(F.filter(headers, keep), shown)


def is_binary(type_: Column, body: Column) -> Column:
    """Whether a body (binary) of a content type isn't text."""
    textual = F.lit(False)
    for t in TEXT_TYPES:
        textual = textual | type_.startswith(t)
    textual = textual | type_.contains("+json") | type_.contains("+xml")
    nul = F.hex(F.substring(body, 1, 512)).rlike("^(..)*00")
    return ~textual & F.when(type_.isin("", "application/octet-stream"), nul).otherwise(True)


def body_format(type_: Column, body: Column) -> Column:
    """binary, json, html, xml or text: by type, else by how the text begins; HTML comes before XML."""
    text = F.regexp_replace(body.cast("string"), r"(?U)^\s+", "")
    begin = F.lower(F.substring(text, 1, 256))
    return (
        F.when(is_binary(type_, body), "binary")
        .when(type_.contains("json") | text.startswith("{") | text.startswith("["), "json")
        .when(type_.isin("text/html", "application/xhtml+xml") | begin.startswith("<!doctype html") | begin.contains("<html"), "html")
        .when(type_.contains("xml") | text.startswith("<"), "xml").otherwise("text")
    )


def preview(text: Column, lines: int = 50) -> Column:
    """A text's first lines with the number of all lines and of those left out."""
    every = F.split(F.regexp_replace(text, r"(\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029])$", ""), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")
    n = F.when(text == "", 0).otherwise(F.size(every))
    return F.struct(
        F.array_join(F.slice(every, 1, lines), "\n").alias("text_preview"), n.alias("total_lines"), F.greatest(n - lines, F.lit(0)).alias("suppressed_lines")
    )


def severity(scores: Column, label: Column) -> Column:
    """critical, high, medium or low by the greatest numeric score; without one the given label, moderate as medium."""
    top = F.array_max(F.filter(F.transform(scores, lambda s: s.try_cast("double")), lambda s: s.isNotNull()))
    low = F.lower(label)
    by_label = F.when(low == "moderate", "medium").when(low.isin("critical", "high", "medium", "low"), low).otherwise("unknown")
    return F.when(top >= 9, "critical").when(top >= 7, "high").when(top >= 4, "medium").when(top.isNotNull(), "low").otherwise(by_label)
