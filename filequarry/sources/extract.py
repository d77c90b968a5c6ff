"""Text and metadata of files: a registry of extractors by type, run in Arrow batches, with failures as rows."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Content types by suffix.
CONTENT_TYPES = {
    ".txt": "text/plain", ".md": "text/x-web-markdown", ".html": "text/html", ".htm": "text/html", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".odt": "application/vnd.oasis.opendocument.text", ".epub": "application/epub+zip", ".pdf": "application/pdf", ".doc": "application/msword", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".png": "image/png", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".heic": "image/heic", ".gif": "image/gif", ".mov": "video/quicktime", ".mp4": "video/mp4", ".avi": "video/x-msvideo", ".mkv": "video/x-matroska",
}
_SKIPPED = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "main", "pre", "blockquote", "hr", "dt", "dd", "title"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class Unsupported(ValueError):
    """A type without an extractor."""


class _Html(HTMLParser):
    def __init__(self, main_only: bool):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.main: list[str] | None = None
        self.meta: dict[str, list[str]] = {}
        self.title: list[str] = []
        self.skipped = self.inside = 0
        self.open: list[tuple[str, bool, bool]] = []
        self.main_only = main_only

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "meta" and found.get("name") and found.get("content") is not None:
            self.meta.setdefault(found["name"], []).append(found["content"])
        if tag == "html" and found.get("lang"):
            self.meta.setdefault("dc:language", []).append(found["lang"])
        if tag in _BLOCKS:
            self._add("\n")
        if tag in _VOID:
            return
        skip = tag in _SKIPPED or "headerlink" in (found.get("class") or "").split()
        main = found.get("role") == "main" or tag == "main"
        self.open.append((tag, skip, main))
        self.skipped += skip
        self.inside += main

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._add("\n")
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                t, skip, main = self.open.pop()
                self.skipped -= skip
                self.inside -= main
                if t == tag:
                    break

    def handle_data(self, data):
        if any(t == "title" for t, _, _ in self.open):
            self.title.append(data)
        elif not self.skipped:
            self._add(data)

    def _add(self, data: str):
        if self.skipped:
            return
        self.parts.append(data)
        if self.inside:
            self.main = (self.main or [])
            self.main.append(data)


def html_text(html: str, main_only: bool = True) -> tuple[str, dict[str, list[str]]]:
    """Text and metadata of an HTML page: without scripts, styles and heading links; of the part with the role main where there is one."""
    parser = _Html(main_only)
    parser.feed(html)
    parser.close()
    parts = parser.main if main_only and parser.main is not None else parser.parts
    text = re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parts))).strip()
    title = "".join(parser.title).strip()
    return text, {**({"dc:title": [title]} if title else {}), **parser.meta}


def decoded(data: bytes) -> str:
    """Bytes of a text file: by their byte order mark, else UTF-8, else Windows-1252 with what it leaves undefined as control characters."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def _plain(data: bytes) -> tuple[str, dict]:
    return decoded(data), {}


def _html(data: bytes) -> tuple[str, dict]:
    return html_text(decoded(data))


def _xml_text(data: bytes, paragraphs: tuple[str, ...], breaks: tuple[str, ...] = (), tabs: tuple[str, ...] = ()) -> str:
    out: list[str] = []

    def walk(e):
        name = e.tag.rpartition("}")[2]
        if e.text:
            out.append(e.text)
        if name in tabs:
            out.append("\t")
        if name in breaks:
            out.append("\n")
        for child in e:
            walk(child)
            if child.tail:
                out.append(child.tail)
        if name in paragraphs:
            out.append("\n")

    walk(ElementTree.fromstring(data))
    return "".join(out).strip()


def _properties(data: bytes) -> dict[str, list[str]]:
    """Dublin Core entries of an office document's metadata part."""
    names = {"title": "dc:title", "creator": "dc:creator", "initial-creator": "dc:creator", "subject": "dc:subject", "description": "dc:description", "language": "dc:language", "created": "dcterms:created", "creation-date": "dcterms:created", "modified": "dcterms:modified"}
    found: dict[str, list[str]] = {}
    for e in ElementTree.fromstring(data).iter():
        name = names.get(e.tag.rpartition("}")[2])
        if name and e.text and e.text.strip():
            found.setdefault(name, []).append(e.text.strip())
    return found


def _docx(data: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _xml_text(z.read("word/document.xml"), ("p",), ("br", "cr"), ("tab",)), _properties(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else {}


def _odt(data: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _xml_text(z.read("content.xml"), ("p", "h"), ("line-break",), ("tab",)), _properties(z.read("meta.xml")) if "meta.xml" in z.namelist() else {}


def _epub(data: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        package = next((n for n in names if n.endswith(".opf")), None)
        if package is None:
            raise ValueError("no package document")
        tree, base = ElementTree.fromstring(z.read(package)), package.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in tree.iter() if e.tag.endswith("}item")}
        order = [items[e.get("idref")] for e in tree.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        pages = [html_text(decoded(z.read(f"{base}/{h}" if base else h)), main_only=False)[0] for h in order if (f"{base}/{h}" if base else h) in names]
        return "\n\n".join(p for p in pages if p), _properties(z.read(package))


EXTRACTORS: dict[str, Callable[[bytes], tuple[str, dict]]] = {".txt": _plain, ".md": _plain, ".html": _html, ".htm": _html, ".docx": _docx, ".odt": _odt, ".epub": _epub}


def register(suffix: str, extractor: Callable[[bytes], tuple[str, dict]]) -> None:
    """Use extractor (bytes -> text and metadata) for a suffix, for example of PDF, where a library for it is installed."""
    EXTRACTORS[suffix.lower()] = extractor


def extracted(files: DataFrame, suffix: str = "suffix") -> DataFrame:
    """files (path, content, suffix …) with page_content, meta_data (JSON of lists) and error. One row for each row.

    Without content, or of a type without extractor, there is no text but the content type; a file that can't be read has error set.
    Binary content comes in small batches, so that a task holds few files at a time.
    """
    known = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(batch[c] if c in batch else [None] * len(batch)) for c in ("path", "modificationTime", "length")]
            rows = [_one(known, data, suf, _of_file(*of)) for data, suf, *of in zip(batch["content"], batch[suffix], *told, strict=True)]
            yield batch.drop(columns="content").assign(page_content=[r[0] for r in rows], meta_data=[r[1] for r in rows], error=[e if isinstance(e, str) else r[2] for e, r in zip(batch["error"], rows, strict=True)])

    carried = files.select(*[c for c in files.columns if c not in ("page_content", "meta_data")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.drop("content", "error").schema)
    ordered = carried.select(*[c for c in carried.columns if c not in ("content", "error")], "content", "error")
    return ordered.mapInPandas(run, f"{kinds}, error string, page_content string, meta_data string")


def _of_file(path, changed, size) -> dict:
    """What the file system tells of a file, under the keys file, fdate and fsize."""
    told = {"file": path, "fdate": None if pd.isna(changed) else pd.Timestamp(changed).isoformat(), "fsize": None if pd.isna(size) else int(size)}
    return {k: v for k, v in told.items() if v is not None}


def _one(known: dict, data, suf, of_file: dict) -> tuple[str, str, str | None]:
    low = (suf or "").lower()
    meta: dict = {"Content-Type": [CONTENT_TYPES[low]]} if low in CONTENT_TYPES else {}
    meta |= of_file
    if data is None:
        return "", json.dumps(meta, ensure_ascii=False), None
    meta["Content-Length"] = [str(len(data))]
    try:
        if low not in known:
            raise Unsupported("unsupported")
        text, found = known[low](bytes(data))
        return text.replace("\x00", "null"), json.dumps(meta | found, ensure_ascii=False).replace("\\u0000", "null"), None
    except Unsupported as e:
        return "", json.dumps(meta, ensure_ascii=False), str(e)
    except Exception as e:  # noqa: BLE001  a file that breaks its extractor is one row, not the end of the run
        return "", json.dumps(meta, ensure_ascii=False), f"{type(e).__name__}: {e}"[:500]


def html_column(html):
    """Text of a column of HTML pages, in Arrow batches."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else html_text(p)[0])

    return F.pandas_udf(run, "string")(html)
