"""A frontier over sitemaps: indexes lead to sitemaps, those to pages, until nothing new is named.

Landed files are bytes by address, plain or gzip. Each round reads the files of the frontier's addresses, and what their
indexes name, less what was looked at before, is the next frontier; so a cycle ends, and a file is read once. A file is
inflated in pieces as it is read, and refused, whole, when it grows beyond a limit or a ratio, when it is broken, or when it
brings a document type. An address that no file was landed for is MISSING.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.session import written

MOST_BYTES, MOST_RATIO, PIECE = 50_000_000, 200, 65_536
LOC = re.compile(rb"(?is)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc>")
INDEX = re.compile(rb"(?i)<(?:\w+:)?sitemapindex\b")
#: An opened address that is longer than this is none.
LONGEST = 8_192
FOUND = "sitemap string, is_index boolean, loc string, reason string"


def pieces(content: bytes, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> Iterator[bytes]:
    """A file's text in bounded pieces. Raises ValueError with the reason why it is refused."""
    if content[:2] != b"\x1f\x8b":
        if len(content) > most_bytes:
            raise ValueError("TOO_LARGE")
        yield content
        return
    inflate, out, rest = zlib.decompressobj(zlib.MAX_WBITS | 16), 0, content
    while rest and not inflate.eof:
        try:
            piece = inflate.decompress(rest, PIECE)
        except zlib.error:
            raise ValueError("BROKEN") from None
        rest, out = inflate.unconsumed_tail, out + len(piece)
        if out > most_bytes:
            raise ValueError("TOO_LARGE")
        if out > most_ratio * len(content):
            raise ValueError("BOMB")
        yield piece
    if not inflate.eof:
        raise ValueError("BROKEN")


def locations(content: bytes, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> tuple[bool, list[str], str | None]:
    """(whether it is an index, addresses in order, why it is refused)."""
    held, found, index, whole = b"", [], False, 0
    try:
        for piece in pieces(content, most_bytes, most_ratio):
            held += piece
            whole += len(piece)
            index = index or bool(INDEX.search(held))
            if b"<!DOCTYPE" in held.upper():
                return index, [], "DOCTYPE"
            end = 0
            for m in LOC.finditer(held):
                found.append(html.unescape(m[1].decode("utf-8", "replace")).strip())
                end = m.end()
            # what may be the beginning of an address is kept for the next piece
            held = held[end:][-LONGEST:]
    except ValueError as e:
        return index, [], str(e)
    if not whole or not (index or found):
        return index, [], "NO_LOCATIONS"
    return index, [x for x in dict.fromkeys(found) if x], None


def read(files: DataFrame, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> DataFrame:
    """FOUND of files (url, content): a row for each address, or one with the reason why there are none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, content in zip(batch["url"], batch["content"], strict=True):
                index, found, reason = (False, [], "MISSING") if content is None else locations(bytes(content), most_bytes, most_ratio)
                yield pd.DataFrame({"sitemap": url, "is_index": index, "loc": found or [None], "reason": reason})

    return files.select("url", "content").mapInPandas(rows, FOUND)


def crawl(files: DataFrame, roots: DataFrame, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> DataFrame:
    """(sitemap, depth, is_index, loc, reason) of all that roots (url) lead to. files: (url, content binary), each url once."""
    frontier = written(roots.where("url is not null").select("url").distinct(), "frontier")
    seen, out, depth = frontier, None, 0
    while not frontier.isEmpty():
        # the frontier is small beside the files: only its addresses' contents are read on
        found = written(read(frontier.join(files, "url", "left"), most_bytes, most_ratio).withColumn("depth", F.lit(depth)), "sitemaps")
        out = found if out is None else out.unionByName(found)
        named = found.where("is_index and loc is not null").select(F.col("loc").alias("url")).distinct()
        frontier = written(named.join(seen, "url", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        depth += 1
    empty = roots.sparkSession.createDataFrame([], f"{FOUND}, depth int")
    return (empty if out is None else out).select("sitemap", "depth", "is_index", "loc", "reason")
