"""Texts of document formats, with the standard library only: office files, PDF, RTF, CSV, HTML, JSON, XML, plain text."""

from __future__ import annotations

import csv
import html as _html
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(raw: bytes) -> str:
    """Paragraphs, headings by their style, and tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = next(x for x in _xml(archive, "word/document.xml") if _local(x.tag) == "body")
    text = lambda e: "".join("\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else x.text or "" for x in e.iter() if _local(x.tag) in ("t", "tab", "br"))
    out = []
    for part in body:
        if _local(part.tag) == "p":
            style = next((v for x in part.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"Heading(\d)", style)
            out.append("#" * min(int(level[1]), 6) + " " + text(part) if level else text(part))
        elif _local(part.tag) == "tbl":
            rows = [[text(c).replace("\n", " ") for c in r if _local(c.tag) == "tc"] for r in part if _local(r.tag) == "tr"]
            out.append(_table(rows))
    return "\n\n".join(x for x in out if x.strip())


def pptx(raw: bytes) -> str:
    """The slides' paragraphs, a heading for each slide."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        out = []
        for i, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
            lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in _xml(archive, name).iter() if _local(p.tag) == "p"]
            out.append("\n\n".join([f"## Slide {i}", *(x for x in lines if x.strip())]))
    return "\n\n".join(out)


def xlsx(raw: bytes) -> str:
    """The sheets as tables, a heading for each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _xml(archive, "xl/sharedStrings.xml")]
        names = [x.attrib.get("name", "") for x in _xml(archive, "xl/workbook.xml").iter() if _local(x.tag) == "sheet"]
        out = []
        for i, name in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")):
            rows = []
            for row in (x for x in _xml(archive, name).iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for cell in row:
                    column = 0
                    for c in re.match(r"[A-Z]*", cell.attrib.get("r", ""))[0]:
                        column = column * 26 + ord(c) - 64
                    value = "".join(x.text or "" for x in cell.iter() if _local(x.tag) in ("v", "t"))
                    cells += [""] * (max(column, len(cells) + 1) - len(cells) - 1)
                    cells.append(shared[int(value)] if cell.attrib.get("t") == "s" and value else value)
                rows.append(cells)
            out.append(f"## {names[i] if i < len(names) else f'Sheet {i + 1}'}\n\n" + _table(rows))
    return "\n\n".join(out)


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(x.replace("|", "\\|") for x in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def csv_table(raw: bytes) -> str:
    return _table([r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"))) if r])


def rtf(raw: bytes) -> str:
    """The text between the control words; destinations such as font tables are left out."""
    text = raw.decode("latin-1")
    out: list[str] = []
    stack, hidden, skip, at = [], False, 0, 0
    for m in re.finditer(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", text, re.S):
        code, byte, word, _, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer") or symbol == "*":
            hidden = True
        elif hidden:
            continue
        elif code:
            out.append(chr(int(code) % 65536))
            skip = 1
        elif byte:
            out.append("" if skip else bytes.fromhex(byte).decode("cp1252", "replace"))
            skip = 0
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif symbol and symbol in "\\{}":
            out.append(symbol)
        elif plain:
            out.append(plain[skip:])
            skip = 0
    return "".join(out).strip()


# PDF: enough of the format for texts with simple fonts. Others give no text, as a scanned page does.
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex((token[1:-1].decode("latin-1").replace(" ", "") + "0")[: 2 * ((len(token) - 1) // 2)])
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else names.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+|/[^\s/\[\]()<>]+", re.S)


def _pdf_text(content: bytes) -> str:
    out: list[str] = []
    held: list[bytes] = []
    for m in _PDF_TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<" or re.fullmatch(rb"-?\d*\.?\d+|\[|\]|/.+", token, re.S):
            held.append(token)
            continue
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in b"(<":
                    out.append(_pdf_string(x))
                elif token == b"TJ" and re.fullmatch(rb"-?\d*\.?\d+", x) and float(x) < -200:
                    out.append(" ")
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        held = []
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def pdf_pages(raw: bytes) -> list[str]:
    """SRC-07: the text of each page, in the order of the page tree."""
    objects: dict[int, bytes] = {int(n): body for n, body in _OBJECT.findall(raw)}

    def stream(body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        data = found[1]
        if b"FlateDecode" in body[: found.start()]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
        return data

    for body in list(objects.values()):  # objects that are kept in compressed streams
        if re.search(rb"/Type\s*/ObjStm", body) and (head := re.search(rb"/First\s+(\d+)", body)):
            data, first = stream(body), int(head[1])
            numbers = list(map(int, data[:first].split()))
            for k in range(0, len(numbers) - 1, 2):
                end = numbers[k + 3] if k + 3 < len(numbers) else len(data) - first
                objects.setdefault(numbers[k], data[first + numbers[k + 1] : first + end])
    refs = lambda text: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", text)]

    def leaves(number: int, seen: set[int]) -> Iterator[bytes]:
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            for child in refs(kids[1]):
                yield from leaves(child, seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body

    root = next((refs(m[1])[0] for body in objects.values() if re.search(rb"/Type\s*/Catalog", body) and (m := re.search(rb"/Pages\s+(\d+\s+\d+\s+R)", body))), None)
    pages = list(leaves(root, set())) if root is not None else [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for page in pages:
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        out.append(_pdf_text(b"\n".join(stream(objects.get(n, b"")) for n in refs(found[1]))) if found else "")
    return out


def _as_json(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def _as_html(raw: bytes) -> str:
    from .files import markdown

    return markdown(raw.decode("utf-8", "replace")) or ""


def _plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


#: SRC-05: suffixes and what reads them. Others need a registered extractor.
READERS: dict[str, Callable[[bytes], str]] = {
    "txt": _plain,
    "md": _plain,
    "csv": csv_table,
    "xml": lambda raw: _html.unescape(re.sub(r"<[^>]+>", "", _plain(raw))),
    "rtf": rtf,
    "html": _as_html,
    "htm": _as_html,
    "json": _as_json,
    "docx": docx,
    "pptx": pptx,
    "xlsx": xlsx,
    "pdf": lambda raw: "\n\n".join(x for x in pdf_pages(raw) if x),
}


def decode(kind: str, raw: bytes) -> str:
    """The text of a file of this kind."""
    return READERS[kind](raw)
