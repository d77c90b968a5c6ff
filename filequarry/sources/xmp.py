"""XMP packets of image files as maps."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_PACKET = re.compile(rb"<x:xmpmeta\b.*?</x:xmpmeta\s*>", re.S)
# Usual prefixes of XMP namespaces.
PREFIXES = {
    "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/photoshop/1.0/": "photoshop", "http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/exif/1.0/": "exif", "http://ns.adobe.com/tiff/1.0/": "tiff",
    "http://ns.adobe.com/xap/1.0/mm/": "xmpMM", "http://ns.adobe.com/xap/1.0/rights/": "xmpRights", "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "Iptc4xmpCore",
}


def entries(data: bytes) -> list[tuple[str, str]]:
    """(prefix:name, value) of a file's first XMP packet, in order; items of lists are numbered from 1, as name[1]. Empty without a packet."""
    found = _PACKET.search(data)
    if not found:
        return []
    named = {uri.decode(): prefix.decode() for prefix, uri in re.findall(rb"xmlns:([\w.-]+)\s*=\s*[\"']([^\"']+)[\"']", found.group())}

    def name(tag: str) -> str:
        uri, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
        prefix = PREFIXES.get(uri) or named.get(uri)
        return f"{prefix}:{local}" if prefix else local

    out: list[tuple[str, str]] = []

    def add(key: str, e) -> None:
        items = [li for box in e if box.tag in (f"{_RDF}Seq", f"{_RDF}Bag", f"{_RDF}Alt") for li in box]
        if items:
            for n, li in enumerate(items, 1):
                add(f"{key}[{n}]", li)
        elif len(e):
            for child in e:
                for k, v in child.attrib.items():
                    if not k.startswith(_RDF):
                        out.append((f"{key}/{name(k)}", v))
                add(key if child.tag == f"{_RDF}Description" else f"{key}/{name(child.tag)}", child)
        else:
            out.append((key, (e.text or "").strip()))

    for description in ElementTree.fromstring(found.group()).iter(f"{_RDF}Description"):
        out += [(name(k), v) for k, v in description.attrib.items() if not k.startswith(_RDF)]
        for e in description:
            add(name(e.tag), e)
    return out


def flat(data: bytes | None) -> dict[str, str] | None:
    """The entries as a map, of a key given twice the last; None for null and for a broken packet."""
    try:
        return None if data is None else {k: v.replace("\x00", "null") for k, v in entries(bytes(data))}
    except ElementTree.ParseError:
        return None


def xmp(content: Column) -> Column:
    def run(files: pd.Series) -> pd.Series:
        return files.map(flat)

    return F.pandas_udf(run, "map<string,string>")(content)
