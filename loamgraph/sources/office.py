"""Texts of word-processor files and presentations, each file read whole from ``binaryFile``.

Pictures need character recognition, which is an external service; their texts come in as a table of their own.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import table_text

#: The name spaces of the two formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: Runs of characters that are taken for text in an old presentation.
PRINTABLE = r"[\w一-鿿，。；：！？、（）《》【】\s.,;:!?()\-+/=]{8,}"


def _said(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx_text(data: bytes) -> str:
    """The paragraphs that say something, a line each, then the tables as Markdown."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    lines = [s for p in body.findall(f"{W}p") if (s := _said(p, f"{W}t").strip())]
    tables = [table_text([[_said(c, f"{W}t").strip() for c in row.findall(f"{W}tc")] for row in t.findall(f"{W}tr")]) for t in body.findall(f"{W}tbl")]
    return "\n\n".join(x for x in ["\n".join(lines), *tables] if x)


def _paragraphs(node) -> str:
    return "\n".join(_said(p, f"{A}t") for p in node.iter(f"{A}p")).strip()


def pptx_text(data: bytes) -> str:
    """A section for each slide that says something: its shapes' texts, its tables as Markdown, and its notes."""
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        slides = sorted((int(m[1]), name) for name in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))
        for place, (n, name) in enumerate(slides, 1):
            own = []
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if shape.tag == f"{P}sp" and (frame := shape.find(f"{P}txBody")) is not None and (s := _paragraphs(frame)):
                    own.append(s)
                elif shape.tag == f"{A}tbl":
                    own.append(table_text([[_paragraphs(c) for c in row.findall(f"{A}tc")] for row in shape.findall(f"{A}tr")]))
            notes = f"ppt/notesSlides/notesSlide{n}.xml"
            if notes in names and (s := _paragraphs(ElementTree.fromstring(z.read(notes)))):
                own.append(f"Notes:\n{s}")
            if own := [x for x in own if x]:
                parts.append(f"# Slide {place}\n\n" + "\n\n".join(own))
    return "\n\n".join(parts)


def legacy_ppt_text(data: bytes) -> str:
    """The printable runs of an old presentation, read as UTF-16 and as Latin-1, each once and with single spaces, a line each."""
    runs = [m for charset in ("utf-16le", "latin-1") for m in re.findall(PRINTABLE, data.decode(charset, "ignore"))]
    return "\n".join(dict.fromkeys(s for run in runs if (s := " ".join(run.split()))))


def extract_texts(spark: SparkSession, root: str, *, recognised: DataFrame | None = None) -> DataFrame:
    """``(path, kind, text)`` of the files below ``root``: texts as they are, documents and presentations by their own readers.

    PDFs and images take their text from ``recognised(path, text)``, and documents and presentations are followed by theirs; files of
    another kind, and those without any text, have ''. A file that can't be read has a null text.
    """
    from loamgraph.sources.manifest import kind_of

    def of(paths: pa.Array, kinds: pa.Array, contents: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for path, kind, data in zip(paths.to_pylist(), kinds.to_pylist(), contents.to_pylist()):
            try:
                out.append(docx_text(data) if kind == "docx" else legacy_ppt_text(data) if path.lower().endswith(".ppt") else pptx_text(data))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                out.append(None)
        return pa.array(out, pa.string())

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content").withColumn("kind", kind_of(F.col("path")))
    office = F.col("kind").isin("docx", "presentation")
    read = files.where(office).select("path", "kind", F.arrow_udf(of, "string")("path", "kind", "content").alias("text"))
    rest = files.where(~office).select("path", "kind", F.when(F.col("kind") == "text", F.make_valid_utf8(F.col("content").cast("string"))).otherwise("").alias("text"))
    rows = read.unionByName(rest)
    if recognised is None:
        return rows
    more = recognised.groupBy("path").agg(F.first("text").alias("more"))
    both = F.filter(F.array("text", "more"), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.join(more, "path", "left").select("path", "kind", F.when(F.col("text").isNotNull(), F.array_join(both, "\n\n")).alias("text"))
