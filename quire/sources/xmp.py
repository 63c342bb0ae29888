"""XMP packets: properties from RDF/XML and back, with the standard library's parser and without entities."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

#: Namespaces of XMP and the prefixes they usually have.
NAMESPACES = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "pdf": "http://ns.adobe.com/pdf/1.3/",
    "pdfaid": "http://www.aiim.org/pdfa/ns/id/",
    "pdfxid": "http://www.npes.org/pdfx/ns/id/",
    "pdfaExtension": "http://www.aiim.org/pdfa/ns/extension/",
    "pdfaProperty": "http://www.aiim.org/pdfa/ns/property#",
    "pdfaSchema": "http://www.aiim.org/pdfa/ns/schema#",
    "pdfuaid": "http://www.aiim.org/pdfua/ns/id/",
    "pdfx": "http://ns.adobe.com/pdfx/1.3/",
    "crossmark": "http://crossref.org/crossmark/1.0/",
    "jav": "http://www.niso.org/schemas/jav/1.0/",
    "ali": "http://www.niso.org/schemas/ali/1.0/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "x": "adobe:ns:meta/",
    "xml": "http://www.w3.org/XML/1998/namespace",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "xmpMM": "http://ns.adobe.com/xap/1.0/mm/",
    "xmpRights": "http://ns.adobe.com/xap/1.0/rights/",
}
_PREFIX = {uri: p for p, uri in NAMESPACES.items()}
_RDF = "{" + NAMESPACES["rdf"] + "}"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def register_namespace(prefix: str, uri: str) -> None:
    """A namespace's prefix, for reading and writing; one that stands for another namespace is an error."""
    if NAMESPACES.get(prefix, uri) != uri:
        raise ValueError(f"{prefix} stands for {NAMESPACES[prefix]}")
    NAMESPACES[prefix] = uri
    _PREFIX[uri] = prefix


def _qname(tag: str) -> str:
    uri, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    return f"{_PREFIX[uri]}:{local}" if uri in _PREFIX else tag


def parsed(data: bytes) -> ET.Element | None:
    """The packet's tree; tried as it is, then without illegal characters; null if neither can be read."""
    for text in (data.decode("utf-8", "replace"), _ILLEGAL.sub("", data.decode("utf-8", "ignore"))):
        text = text.strip("﻿ \t\r\n\0")
        if "<!DOCTYPE" in text or "<!ENTITY" in text:
            return None
        try:
            return ET.fromstring(text)
        except ET.ParseError:
            continue
    return None


def properties(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """Names and values, in order: attributes, simple elements, of alternatives the first, of bags and sequences all."""
    root = parsed(data)
    if root is None:
        return
    for about in root.iter(_RDF + "Description"):
        if about.get(_RDF + "about", "") != "":
            continue
        for key, value in about.attrib.items():
            if not key.startswith(_RDF):
                yield _qname(key), [value]
        for node in about:
            items = node.findall(f"{_RDF}Alt/{_RDF}li")[:1] or node.findall(f"{_RDF}Seq/{_RDF}li")
            bag = node.findall(f"{_RDF}Bag/{_RDF}li")
            if bag:
                yield _qname(node.tag), sorted({x.text or "" for x in bag})
            else:
                yield _qname(node.tag), [x.text or "" for x in items] or [(node.text or "").strip()]


#: Properties whose value depends on the language, and those that are sequences or bags.
ALTERNATIVES = {"dc:title", "dc:description", "dc:rights", "xmpRights:UsageTerms"}
SEQUENCES, BAGS = {"dc:creator", "dc:date"}, {"dc:subject", "dc:contributor", "dc:language", "dc:publisher", "dc:relation", "dc:type"}


def packet(props: dict[str, list[str]]) -> bytes:
    """A packet of properties by name."""
    for p, uri in NAMESPACES.items():
        if p != "xml":
            ET.register_namespace(p, uri)
    meta = ET.Element(f"{{{NAMESPACES['x']}}}xmpmeta")
    about = ET.SubElement(ET.SubElement(meta, _RDF + "RDF"), _RDF + "Description", {_RDF + "about": ""})
    for name, values in props.items():
        p, _, local = name.partition(":")
        node = ET.SubElement(about, name if name.startswith("{") else f"{{{NAMESPACES[p]}}}{local}")
        kind = "Alt" if name in ALTERNATIVES else "Seq" if name in SEQUENCES else "Bag" if name in BAGS or len(values) > 1 else None
        clean = [_ILLEGAL.sub("", v) for v in values]
        if kind is None:
            node.text = clean[0] if clean else ""
            continue
        group = ET.SubElement(node, _RDF + kind)
        for v in clean:
            ET.SubElement(group, _RDF + "li", {f"{{{NAMESPACES['xml']}}}lang": "x-default"} if kind == "Alt" else {}).text = v
    body = ET.tostring(meta, encoding="utf-8")
    return b'<?xpacket begin="\xef\xbb\xbf" id="W5M0MpCehiHzreSzNTczkc9d"?>\n' + body + b'\n<?xpacket end="w"?>'
