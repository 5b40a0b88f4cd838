"""Folders of files as tables: scanning, formats, texts with titles, pairs, question lists and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: First bytes of formats, as hexadecimal digits.
MAGIC = (("pdf", "255044462D"), ("zip", "504B0304"), ("ole", "D0CF11E0A1B11AE1"))
#: Formats that the first bytes only narrow down to a container, by extension.
CONTAINERS = {"zip": ("docx", "pptx", "xlsx", "hwpx"), "ole": ("doc", "ppt", "xls", "hwp")}
TEXT_FORMATS = {"txt": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "json": "json", "jsonl": "jsonl", "csv": "csv"}


def file_format(name: Column, content: Column) -> Column:
    """A file's format by its first bytes, then by its extension; null if neither says."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    out = F.element_at(F.create_map(*(F.lit(x) for pair in TEXT_FORMATS.items() for x in pair)), F.nullif(ext, F.lit("")))
    for kind, start in reversed(MAGIC):
        own = F.when(ext.isin(*CONTAINERS[kind]), ext).otherwise(kind) if kind in CONTAINERS else F.lit(kind)
        out = F.when(F.startswith(head, F.lit(start)), own).otherwise(out)
    return out


def scan_folder(spark: SparkSession, folder: str, formats: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """(name, format, sha256, content) of the files right below ``folder``, by format or by name if asked for; a file without bytes is not listed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    rows = rows.select(name.alias("name"), "content").withColumns({"format": file_format(F.col("name"), F.col("content")), "sha256": F.sha2("content", 256)})
    if formats is not None:
        rows = rows.where(F.col("format").isin(*formats))
    if names is not None:
        rows = rows.where(F.col("name").isin(*names))
    return rows.select("name", "format", "sha256", "content")


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with ``text``: UTF-8 without its mark, else Korean (what cannot be read is replaced)."""
    body = F.when(F.startswith(F.hex(F.substring("content", 1, 3)), F.lit("EFBBBF")), F.substring(F.col("content"), 4, 2_000_000_000)).otherwise(F.col("content"))
    rows = files.withColumn("content", body).withColumn("good", F.is_valid_utf8(F.col("content").cast("string")))
    plain = rows.where("good").withColumn("text", F.col("content").cast("string")).drop("good")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[bytes(c).decode("cp949", errors="replace") for c in batch["content"]])

    odd = rows.where("not good").drop("good")
    return plain.unionByName(odd.mapInPandas(run, plain.schema))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def text_documents(files: DataFrame) -> DataFrame:
    """(doc_id, title, content) of text and markdown files; the title of markdown is its first ``# `` line, else the stem."""
    rows = decoded(files.where(F.col("format").isin("txt", "md")))
    heading = strip(F.regexp_extract("text", r"(?m)^# (.*)$", 1))
    title = F.when((F.col("format") == "md") & (heading != ""), heading).otherwise(stem(F.col("name")))
    return rows.select(F.col("name").alias("doc_id"), title.alias("title"), F.col("text").alias("content"))


class _Page(HTMLParser):
    """Collects lines of text, with headings and tables as markdown."""

    SKIP = ("script", "style", "nav")
    BREAKS = ("p", "div", "br", "li", "ul", "ol", "section", "article", "header", "footer", "main", "body", "html", "title", "head")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.title = self.first = ""
        self.held, self.skipped, self.heading, self.cell = "", 0, 0, None
        self.in_title = False

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", self.held).strip()
        self.held = ""
        if not text:
            return
        if self.in_title:
            self.title = self.title or text
            return
        if self.heading == 1 and not self.first:
            self.first = text
        self.lines.append("#" * self.heading + " " * bool(self.heading) + text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        level = re.fullmatch(r"h([1-6])", tag)
        if level or tag in self.BREAKS or tag in ("table", "tr", "td", "th"):
            self.flush()
        if level:
            self.heading = int(level[1])
        if tag == "title":
            self.in_title = True
        if tag == "table":
            self.tables.append([])
        if self.tables and tag == "tr":
            self.tables[-1].append([])
        if self.tables and self.tables[-1] and tag in ("td", "th"):
            self.cell = ""

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        if tag in ("td", "th") and self.cell is not None:
            text = re.sub(r"\s+", " ", self.cell).strip()
            self.tables[-1][-1].append(text)
            self.cell = None
            if text:
                self.lines.append(text)
        level = re.fullmatch(r"h[1-6]", tag)
        if level or tag in self.BREAKS:
            self.flush()
        if level:
            self.heading = 0
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.cell is not None:
            self.cell += data
        else:
            self.held += data


def html_documents(pages: DataFrame, key: str = "name", html: str = "text") -> DataFrame:
    """(``key``, title, content, tables) of HTML texts.

    Scripts, styles and navigation go, headings become markdown headings, each
    block of text is a line.  The title is that of the page, else its first
    top heading, else null.  ``tables`` holds the cells of each table, whose
    texts are in the content too.  A null page is an empty one.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[html], strict=True):
                page = _Page()
                page.feed(text if isinstance(text, str) else "")
                page.close()
                page.flush()
                rows.append((k, page.title or page.first or None, "\n".join(page.lines), [[r for r in t if r] for t in page.tables]))
            yield pd.DataFrame(rows, columns=[key, "title", "content", "tables"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, title string, content string, tables array<array<array<string>>>")


PAIR_FIELDS = ("question", "answer", "instruction", "source_doc", "category")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer, instruction, source_doc, category) of a JSON list of pairs or of instructions; rows of neither kind go."""
    wanted = ", ".join(f"{c} string" for c in (*PAIR_FIELDS, "output"))
    rows = spark.read.schema(wanted).json(path, multiLine=True)
    native = F.col("question").isNotNull()
    rows = rows.where(native | F.col("instruction").isNotNull())
    blank = lambda c: F.coalesce(c, F.lit(""))
    answer = F.when(native, F.col("answer")).otherwise(blank(F.col("output")))
    question = F.coalesce("question", "instruction")
    return rows.select(question.alias("question"), blank(answer).alias("answer"), F.coalesce("instruction", "question").alias("instruction"), *(blank(F.col(c)).alias(c) for c in ("source_doc", "category")))


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer, instruction) of a JSON list with instruction, input and output; the question is the first two, a line each."""
    rows = spark.read.schema("instruction string, input string, output string").json(path, multiLine=True)
    instruction, more = F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit(""))
    question = F.when(more != "", strip(F.concat(instruction, F.lit("\n"), more))).otherwise(instruction)
    return rows.select(question.alias("question"), F.coalesce("output", F.lit("")).alias("answer"), instruction.alias("instruction"))


def read_training(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a file with one JSON object a line."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question) of a text file: its lines that are not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("question")).where("question <> ''")


def flatten_categories(rows: DataFrame, by_category: str) -> DataFrame:
    """(category, question) of a map from categories to lists of questions."""
    each = rows.select(F.explode(by_category).alias("category", "questions"))
    return each.select("category", F.explode("questions").alias("question"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of a JSON object of file hashes; one that cannot be read, or is not there, is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "name string, sha256 string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, string>")).alias("name", "sha256")).where("sha256 is not null")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(name, summary, keywords) of a corpus profile; nulls where the JSON says nothing or cannot be read."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", "name string, summary string, keywords array<string>").alias("p")).select("p.*")
