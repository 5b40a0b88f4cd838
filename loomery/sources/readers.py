"""Readers of file formats: bytes to a title, a text and tables.

A reader takes a file's name and bytes and gives (title, content, tables).
Whatever it raises becomes the ``error`` of that file's row; the other files
are read on.  New formats are registered with :func:`reader`.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import _Page, scan_folder

Parsed = tuple[str | None, str, list[list[list[str]]]]
Reader = Callable[[str, bytes], Parsed]

READERS: dict[str, Reader] = {}
#: Characters of an error that are kept.
ERROR_CHARS = 500
#: Most files, and bytes of them unless one has more, whose rows leave together.
BATCH_FILES, BATCH_BYTES = 4_096, 1 << 22


def reader(*formats: str) -> Callable[[Reader], Reader]:
    """Register a function for the formats that :func:`loomery.sources.files.file_format` names."""

    def add(f: Reader) -> Reader:
        READERS.update(dict.fromkeys(formats, f))
        return f

    return add


def encoding_of(content: bytes) -> str:
    """utf-8-sig, utf-8, utf-16 (by its mark) or euc-kr; an error if none can read the bytes."""
    if content.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if content.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    for name, codec in (("utf-8", "utf-8"), ("euc-kr", "cp949")):
        try:
            content.decode(codec)
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError("the bytes are no text of a known encoding")


def decode(content: bytes) -> str:
    name = encoding_of(content)
    return content.decode("cp949" if name == "euc-kr" else name)


def stem_of(name: str) -> str:
    return name.rpartition(".")[0] or name


@reader("txt")
def read_text(name: str, content: bytes) -> Parsed:
    return stem_of(name), decode(content), []


@reader("md")
def read_markdown(name: str, content: bytes) -> Parsed:
    text = decode(content)
    heading = next((line[2:].strip() for line in text.split("\n") if line.startswith("# ")), "")
    return heading or stem_of(name), text, []


@reader("html")
def read_html(name: str, content: bytes) -> Parsed:
    page = _Page()
    page.feed(decode(content))
    page.close()
    page.flush()
    return page.title or page.first or stem_of(name), "\n".join(page.lines), [[r for r in t if r] for t in page.tables]


@reader("json")
def read_json(name: str, content: bytes) -> Parsed:
    """The fields title and content of an object, if it has them, else the JSON as it is."""
    text = decode(content)
    value = json.loads(text)
    fields = value if isinstance(value, dict) else {}
    pick = lambda key, other: fields[key] if isinstance(fields.get(key), str) else other
    return pick("title", stem_of(name)), pick("content", text), []


@reader("jsonl")
def read_json_lines(name: str, content: bytes) -> Parsed:
    text = decode(content)
    for line in text.splitlines():
        if line.strip():
            json.loads(line)
    return stem_of(name), text, []


@reader("csv")
def read_csv(name: str, content: bytes) -> Parsed:
    """One table; a row of another width than the first is an error."""
    text = decode(content)
    rows = [r for r in csv.reader(io.StringIO(text), strict=True) if r]
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("rows of different widths")
    return stem_of(name), text, [rows] if rows else []


def gathered(items: Iterable[tuple], size: Callable[[tuple], int], most: int, total: int) -> Iterator[list[tuple]]:
    """``items`` in order, in lists of at most ``most`` that have a ``size`` of at most ``total`` unless one alone has more."""
    held: list[tuple] = []
    have = 0
    for item in items:
        if held and (len(held) >= most or have + size(item) > total):
            yield held
            held, have = [], 0
        held.append(item)
        have += size(item)
    if held:
        yield held


def read_files(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(name, format, title, content, tables, error) of (name, format, content); of a file that fails only the first two and the error.

    Null bytes are those of an empty file; a format without a reader is an error.
    """
    known = dict(READERS if readers is None else readers)
    several = pa.list_(pa.list_(pa.list_(pa.string())))

    def parse(name: str | None, kind: str | None, content: bytes | None) -> tuple:
        try:
            if kind not in known:
                raise LookupError(f"no reader for {kind}")
            return (*known[kind](name or "", content or b""), None)
        except Exception as error:  # noqa: BLE001  a file must not stop the others
            return None, None, None, f"{type(error).__name__}: {error}"[:ERROR_CHARS]

    names = ["name", "format", "title", "content", "tables", "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), several, pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # files are parsed one by one and leave together while they are small: a text is no larger than a few times its bytes
            each = zip(*(batch.column(c) for c in ("name", "format", "content")), strict=True)
            for some in gathered(((n.as_py(), k.as_py(), c.as_py()) for n, k, c in each), lambda x: len(x[2] or b""), BATCH_FILES, BATCH_BYTES):
                yield made([(name, kind, *parse(name, kind, content)) for name, kind, content in some])

    return files.select("name", "format", "content").mapInArrow(run, "name string, format string, title string, content string, tables array<array<array<string>>>, error string")


def read_folder(spark: SparkSession, folder: str, formats: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """The files right below ``folder``, as :func:`read_files`; by format or by name if asked for."""
    return read_files(scan_folder(spark, folder, formats, names))
