"""Help containers: entities of the binary file, the packed table of contents, page archives.

A container begins with a header of 18 bytes and one block of file records (header address, body address, 2**31 - 1; 12 bytes each).  Sizes are eight hexadecimal
digits and a separator.  Names are UTF-16LE behind the record of their header address.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = 2**31 - 1


class BadContainer(ValueError):
    pass


def _size(data: bytes, at: int) -> int:
    try:
        return int(data[at : at + 8].decode("ascii").strip(), 16)
    except ValueError as e:
        raise BadContainer(f"no size at {at}") from e


def entities(data: bytes) -> dict[str, bytes]:
    """Bodies by name."""
    size = _size(data, 18)
    records = data[18 + 9 + 9 + 11 :][:size]
    if len(records) < size:
        raise BadContainer("cut short")
    out = {}
    for head, body, reserved in struct.iter_unpack("<iii", records[: size // 12 * 12]):
        if reserved != RESERVED:
            raise BadContainer(f"reserved field is {reserved}")
        name_size = _size(data, head + 2) - 24
        name = data[head + 2 + 9 + 40 :][:name_size].decode("utf-16-le")
        body_size = _size(data, body + 2)
        out[name] = data[body + 2 + 9 + 20 :][:body_size]
        if len(out[name]) < body_size:
            raise BadContainer(f"{name} is cut short")
    return out


def inflate_block(data: bytes) -> str:
    """Text of the first entry of a zip stream without a directory."""
    if data[:4] != b"PK\x03\x04":
        raise BadContainer("no local header")
    name, extra = struct.unpack("<HH", data[26:30])
    return zlib.decompressobj(-15).decompress(data[30 + name + extra :]).decode("utf-8-sig")


def pages(archive: bytes, paths: list[str]) -> Iterator[tuple[str, str]]:
    """(path, html) of the pages that the archive has."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        names = set(z.namelist())
        for path in paths:
            if path.lstrip("/") in names:
                yield path, z.read(path.lstrip("/")).decode("utf-8-sig", "replace")


_TOKEN = re.compile(r'"((?:[^"]|"")*)"|([{}])|([^\s,{}"]+)')


def contents(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(id, parent, order, Russian title, English title, page) of a table of contents; entry 0 is left out."""
    flat = [m[1].replace('""', '"') if m[1] is not None else m[2] or m[3] for m in _TOKEN.finditer(text.replace("﻿", ""))]
    at = 0

    def take(n: int = 1) -> list[str]:
        nonlocal at
        if at + n > len(flat):
            raise BadContainer("contents are cut short")
        at += n
        return flat[at - n : at]

    def need(sign: str) -> None:
        if take() != [sign]:
            raise BadContainer(f"{sign} expected at token {at - 1}")

    out = []
    need("{")
    take()
    while at < len(flat) and flat[at] != "}":
        need("{")
        node, parent, n = map(int, take(3))
        take(max(0, n))
        need("{")
        take(2)
        need("{")
        take(2)
        titles = {}
        while flat[at] == "{":
            need("{")
            code, title = take(2)
            titles.setdefault(code, title)
            need("}")
        need("}")
        (page,) = take()
        need("}")
        need("}")
        if node:
            first = next(iter(titles.values()), "")
            out.append((node, parent, len(out), titles.get("ru", first), titles.get("en", ""), page.replace('"', "")))
    return out


TOC = "id int, parent_id int, ord int, ru string, en string, html_path string"
BROKEN = (BadContainer, KeyError, zlib.error, IndexError, struct.error, zipfile.BadZipFile, UnicodeDecodeError, ValueError)


def containers(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def contents_of(files: DataFrame, entity: str = "PackBlock") -> DataFrame:
    """``path`` and the rows of ``TOC`` of all containers among ``files(path, content)``; files that are no containers give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(p, *row) for row in contents(inflate_block(entities(bytes(data))[entity]))]
                except BROKEN:
                    continue
            yield pd.DataFrame(rows, columns=["path", "id", "parent_id", "ord", "ru", "en", "html_path"])

    return files.select("path", "content").mapInPandas(run, f"path string, {TOC}")


def read_contents(spark: SparkSession, path: str, entity: str = "PackBlock") -> DataFrame:
    return contents_of(containers(spark, path), entity)


def pages_of(files: DataFrame, toc: DataFrame | None = None, entity: str = "FileStorage") -> DataFrame:
    """``path, html_path, html``: pages in the archives of containers; with ``toc(path, html_path)`` those that it names, under its spelling of their paths."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = entities(bytes(data))[entity]
                    with zipfile.ZipFile(io.BytesIO(archive)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                    rows = [(p, *row) for row in pages(archive, names)]
                except BROKEN:
                    continue
                yield pd.DataFrame(rows, columns=["path", "html_path", "html"])

    every = files.select("path", "content").mapInPandas(run, "path string, html_path string, html string")
    if toc is None:
        return every
    bare = F.regexp_replace("html_path", "^/+", "")
    named = toc.where("html_path <> ''").select("path", bare.alias("bare"), "html_path").distinct()
    return named.join(every.select("path", bare.alias("bare"), "html"), ["path", "bare"]).select("path", "html_path", "html")


def pack(bodies: dict[str, bytes]) -> bytes:
    """A container with these entities (the format in the other direction)."""
    number = lambda n: b"%08x\r" % n
    head = bytes(18) + number(12 * len(bodies)) + number(12 * len(bodies)) + bytes(11)
    at, records, tail = len(head) + 12 * len(bodies), b"", b""
    for name, body in bodies.items():
        raw = name.encode("utf-16-le")
        first, second = bytes(2) + number(len(raw) + 24) + bytes(40) + raw, bytes(2) + number(len(body)) + bytes(20) + body
        records += struct.pack("<iii", at, at + len(first), RESERVED)
        tail += first + second
        at += len(first) + len(second)
    return head + records + tail


def deflate_block(text: str) -> bytes:
    """A zip stream of one entry, without a directory."""
    c = zlib.compressobj(wbits=-15)
    return b"PK\x03\x04" + bytes(22) + struct.pack("<HH", 0, 0) + c.compress(text.encode()) + c.flush()
