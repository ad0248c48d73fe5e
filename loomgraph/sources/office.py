"""Binary documents: DOCX by its paragraphs and simple PDF files by their text operators (SRC-3, SRC-6, CHK-4)."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_REFS = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOW = re.compile(rb"\((?:[^()\\]|\\.)*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|\bT[dD]\b|\bTm\b|\bET\b", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|(-?\d+(?:\.\d+)?)", re.S)
_ESCAPE = re.compile(rb"\\(\d{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def docx_markdown(data: bytes) -> str:
    """The paragraphs of a DOCX file as Markdown: heading styles as `#` lines, other paragraphs as they are, blank ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(_W + "p"):
        text = "".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" for t in p.iter() if t.tag in (_W + "t", _W + "tab", _W + "br")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"(?i)heading\s*([1-6])|(title)", style.get(_W + "val", "")) if style is not None else None
        if text and level:
            out.append("#" * int(level.group(1) or 1) + " " + " ".join(text.split()))
        elif text:
            out.append(re.sub(r"(?m)^#", r"\\#", text))
    return "\n\n".join(out)


def _unescape(s: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x.isdigit() else _NAMED.get(x, b"" if x == b"\n" else x)

    return _ESCAPE.sub(one, s).decode("cp1252", "replace")


def _page_text(content: bytes) -> str:
    out: list[str] = []
    for m in _SHOW.finditer(content):
        op = m.group(0)
        if op[:1] not in b"([":
            if out and not out[-1].endswith("\n"):
                out.append("\n")
            continue
        if op[:1] == b"(" and op[-1:] in b"'\"" and out and not out[-1].endswith("\n"):
            out.append("\n")
        for s, gap in _STRING.findall(op):
            if gap:
                if float(gap) < -200:  # a wide gap inside a line is a blank
                    out.append(" ")
            else:
                out.append(_unescape(s))
    return "".join(out).strip()


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page of a PDF file that keeps its pages in plain objects and its text in single-byte fonts; [] where that isn't so."""
    objects = {int(n): body for n, body in _OBJECT.findall(data)}

    def stream(k: int) -> bytes:
        body = objects.get(k, b"")
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"FlateDecode" not in body[: m.start()]:
            return m.group(1)
        try:
            return zlib.decompressobj().decompress(m.group(1))
        except zlib.error:
            return b""

    pages = []
    for _, body in sorted(objects.items()):
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        at = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        pages.append(_page_text(b"\n".join(stream(int(k)) for k in _REFS.findall(at.group(1)))) if at else "")
    return pages


def _pages(batches):
    for batch in batches:
        ids, nos, texts, errors = [], [], [], []
        for doc, suffix, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            try:
                got = [docx_markdown(data)] if suffix == "docx" else pdf_pages(data)
                error = None if got else "no readable page"
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                got, error = [], type(e).__name__
            for no, text in enumerate(got or [None], 1):
                ids.append(doc)
                nos.append(no)
                texts.append(text)
                errors.append(error)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "page_number", "text", "error"])


def office_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, error) of the DOCX and PDF files of (doc_id, suffix, content): a DOCX file is one page of Markdown; a file that can't be
    read has one row with a null text and the reason, so none is lost silently."""
    return files.where(F.col("suffix").isin("docx", "pdf")).select("doc_id", "suffix", "content").mapInArrow(_pages, "doc_id string, page_number int, text string, error string")
