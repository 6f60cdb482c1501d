"""Files to documents: one reader per format, routed by suffix, each a distributed scan of whole files."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.functions import text as tx

# The suffixes that are read, and the elements that are no content.
SUFFIXES = {".pdf": "pdf", ".txt": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".csv": "csv", ".docx": "docx"}
BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "script", "style", "form"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def decode(content: Column | str) -> Column:
    """UTF-8 with replacement characters for what isn't."""
    return F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))


def markdown_title(text: Column | str) -> Column:
    return F.trim(F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"(?m)^# (.*)$", 1))


class _Text(HTMLParser):
    """Strings of a page outside boilerplate, by the root they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.found: list[tuple[frozenset, str]] = []
        self.title = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if "title" in self.stack:
            self.title += data
        elif not BOILERPLATE.intersection(self.stack) and data.strip():
            self.found.append((frozenset(self.stack), data.strip()))


def page_text(page: str | None) -> tuple[str, str]:
    """(title, text): strings below main, else article, else body, else all, a line each."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    root = next((r for r in ("main", "article", "body") if any(r in s for s, _ in parser.found)), None)
    return parser.title.strip(), "\n".join(t for s, t in parser.found if root is None or root in s)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def html_text(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in it:
        yield pd.DataFrame([page_text(p) for p in pages], columns=["title", "text"])


def csv_text(rows: DataFrame, order: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """A table as sentences: its columns, then a line per row of ``column: value`` pairs without blank values.

    With an order the lines of a group come together; a group is one file, so its size is a file's.
    """
    columns = [c for c in rows.columns if c not in (by or [])]
    value = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string"))))
    line = F.concat_ws("; ", *[value(c) for c in columns])
    lines = rows.select(*(by or []), line.alias("line"), (order if order is not None else F.monotonically_increasing_id()).alias("__o"))
    listed = lines.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(F.struct("__o", "line"))).alias("l"), F.count("*").alias("row_count"))
    head = F.lit(f"Table with columns: {', '.join(columns)}.")
    return listed.select(*(by or []), F.concat_ws("\n", head, F.array_join("l.line", "\n")).alias("text"), "row_count", F.lit(", ".join(columns)).alias("columns"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file; headings stand between blank lines."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{ns}p"):
        said = "".join(t.text or "" for t in p.iter(f"{ns}t"))
        style = p.find(f"{ns}pPr/{ns}pStyle")
        out.append(f"\n{said}\n" if style is not None and (style.get(f"{ns}val") or "").startswith("Heading") else said)
    return "\n".join(out)


def pdf_text(content: bytes) -> tuple[str, int]:
    """Pages with text, and their number in the file. Needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the package pypdf") from e
    pages = [p.extract_text() or "" for p in PdfReader(BytesIO(content)).pages]
    return "\n\n".join(p for p in pages if p.strip()), len(pages)


def _csv_file(content: bytes) -> tuple[str, dict[str, str]]:
    import csv

    rows = list(csv.reader(content.decode("utf-8", "replace").splitlines()))
    if not rows:
        return "", {"row_count": "0", "columns": ""}
    head = [c.strip() for c in rows[0]]
    lines = ["; ".join(f"{c}: {v.strip()}" for c, v in zip(head, row, strict=False) if v.strip()) for row in rows[1:]]
    return "\n".join([f"Table with columns: {', '.join(head)}.", *(x for x in lines if x)]), {"row_count": str(len(rows) - 1), "columns": ", ".join(head)}


def parse_file(name: str, content: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata) of one file by its suffix; other suffixes raise ValueError."""
    suffix = re.search(r"\.[^./]*$", name.lower())
    kind = SUFFIXES.get(suffix[0] if suffix else "")
    if kind is None:
        raise ValueError(f"no reader for {name}")
    meta: dict[str, str] = {}
    if kind == "pdf":
        text, pages = pdf_text(content)
        meta["page_count"] = str(pages)
    elif kind == "docx":
        text = docx_text(content)
    elif kind == "csv":
        text, meta = _csv_file(content)
    else:
        text = content.decode("utf-8", "replace")
        if kind == "html":
            title, text = page_text(text)
            meta = {"title": title} if title else {}
        elif kind == "markdown" and (m := re.search(r"(?m)^# (.*)$", text)):
            meta["title"] = m[1].strip()
    return text, {**meta, "source": name.rsplit("/", 1)[-1]}


def load_documents(spark: SparkSession, path: str, *, clean: bool = True) -> DataFrame:
    """(path, text, metadata) of all files below a path; a suffix without a reader fails the load."""

    @F.pandas_udf("text string, metadata map<string,string>")
    def parse(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_file(n, c) for n, c in zip(names, contents, strict=True)], columns=["text", "metadata"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", parse("path", "content").alias("p"))
    return files.select("path", (tx.clean_text("p.text") if clean else F.col("p.text")).alias("text"), "p.metadata")


def load_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) as they are: the minimal loader."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from a JSON file that is a list or an object with ``cases``; older key names are accepted."""
    case = schemas.GOLDEN
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    cases = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{_fields(case)}>>")).otherwise(F.from_json("v", f"cases array<struct<{_fields(case)}>>")["cases"])
    c = F.col("c")
    return raw.select(F.posexplode(cases).alias("i", "c")).select(
        F.coalesce(c["case_id"], c["id"], F.concat(F.lit("case-"), F.col("i").cast("string"))).alias("case_id"), F.coalesce(c["question"], c["query"]).alias("question"),
        F.coalesce(c["expected_answer"], F.lit("")).alias("expected_answer"), F.coalesce(c["segment"], F.lit("general")).alias("segment"),
        F.coalesce(c["is_answerable"], F.lit(True)).alias("is_answerable"), F.coalesce(c["relevant_chunk_ids"], c["relevant_keywords"], F.array().cast("array<string>")).alias("relevant_chunk_ids"),
        c["relevance_grades"].alias("relevance_grades"), c["history"].alias("history"),
    )


def _fields(ddl: str) -> str:
    return re.sub(r"(\w+) (\w[\w<>:,]*)", r"\1:\2", ddl)


def static_results(rows: DataFrame, queries: DataFrame, top_k: int = 5, metadata_filter: dict[str, str] | None = None) -> DataFrame:
    """A fixed set of results scored by the share of the question's tokens in them; empty contents are left out.

    rows is small by definition (a literal set), queries(query_id, question) is the other side.
    """
    held = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    for key, value in (metadata_filter or {}).items():
        held = held.where(F.col("metadata")[key] == value)
    tokens = held.withColumn("__t", tx.token_set("content")).withColumn("__e", F.explode("__t"))
    asked = queries.withColumn("__q", tx.token_set("question"))
    hits = asked.select("query_id", F.explode("__q").alias("__e"), F.size("__q").alias("__n")).join(tokens, "__e")
    scored = hits.groupBy("query_id", "chunk_id").agg((F.count("*") / F.greatest(F.lit(1), F.first("__n"))).alias("s"), *[F.first(c).alias(c) for c in rows.columns if c not in ("chunk_id", "score")])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("score", F.round("s", 4)).drop("s").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def graph_view(nodes: DataFrame, edges: DataFrame, chapter: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with their properties and relationships with the names of their ends, of a chapter or all; limit: rows of each at most, by name."""
    if chapter is not None:
        nodes, edges = nodes.where(F.col("chapter") == chapter), edges.where(F.col("chapter") == chapter)
    names = nodes.select("tenant_id", F.col("canonical_name").alias("k"), F.coalesce("name", "canonical_name").alias("n"))
    ends = edges.join(names.select("tenant_id", F.col("k").alias("src"), F.col("n").alias("source")), ["tenant_id", "src"])
    ends = ends.join(names.select("tenant_id", F.col("k").alias("dst"), F.col("n").alias("target")), ["tenant_id", "dst"])
    shown = nodes.select("tenant_id", F.col("canonical_name").alias("id"), F.coalesce("name", "canonical_name").alias("label"), "entity_type", "confidence")
    ends = ends.select("tenant_id", "source", "rel_type", "target", "source_uri", "confidence")
    return (shown, ends) if limit is None else (shown.orderBy("tenant_id", "id").limit(limit), ends.orderBy("tenant_id", "source", "rel_type", "target", "source_uri").limit(limit))


def register_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> None:
    """Temporary views kg_nodes and kg_edges, for query_graph."""
    nodes.createOrReplaceTempView("kg_nodes")
    edges.createOrReplaceTempView("kg_edges")


def query_graph(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    return spark.sql(sql, args=args)
