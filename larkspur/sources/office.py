"""PDF and DOCX files: text of pages, plain writers, and conversions from one to the other by a ladder of methods."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

#: Widths of the standard sans-serif font's characters from 32 to 126, in thousandths of its size.
_WIDTHS = (278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556,
    278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611,
    722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,)
PAGE, MARGIN, SIZE, LEADING = (612, 792), 72, 12, 14


def text_width(text: str, size: float = SIZE) -> float:
    """How wide a line is; characters beyond ASCII count as a digit."""
    return sum(_WIDTHS[ord(c) - 32] if 32 <= ord(c) <= 126 else 556 for c in text) * size / 1000


def wrap(text: str, width: float, size: float = SIZE) -> list[str]:
    """Words in lines that fit ``width``, a space after each word counted; a word that doesn't fit has a line of its own."""
    lines: list[list[str]] = []
    room = -1.0
    for word in text.split():
        need = text_width(word + " ", size)
        if need > room:
            lines.append([])
            room = width
        lines[-1].append(word)
        room -= need
    return [" ".join(line) for line in lines]


def paragraph_style(name: str) -> str:
    """heading1, heading2 or normal, by a DOCX style's name."""
    low = name.lower()
    if "heading" not in low and "title" not in low:
        return "normal"
    return "heading1" if "1" in low or "title" in low else "heading2"


#: Sizes of the styles' fonts.
STYLE_SIZES = {"heading1": 16, "heading2": 14, "normal": SIZE}


def docx_paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs and, as normal ones, of the tables' rows of a DOCX file, in the body's order; blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{{{_W}}}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{_W}}}t"))
    out = []
    for node in body:
        if node.tag == f"{{{_W}}}p":
            style = node.find(f"{{{_W}}}pPr/{{{_W}}}pStyle")
            out.append((paragraph_style(style.get(f"{{{_W}}}val", "") if style is not None else ""), text(node)))
        elif node.tag == f"{{{_W}}}tbl":
            out += [("normal", " | ".join(text(c) for c in row.findall(f"{{{_W}}}tc"))) for row in node.findall(f"{{{_W}}}tr")]
    return [(s, t) for s, t in out if t.strip()]


def write_docx(paragraphs: list[tuple[str, str]]) -> bytes:
    """A DOCX file of (style, text)."""
    names = {"heading1": "Heading1", "heading2": "Heading2"}
    styled = lambda s: f'<w:pPr><w:pStyle w:val="{names[s]}"/></w:pPr>' if s in names else ""
    clean = lambda t: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t))
    body = "".join(f'<w:p>{styled(s)}<w:r><w:t xml:space="preserve">{clean(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    files = {"[Content_Types].xml":
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" '
        'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>', "_rels/.rels":
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
        'Target="word/document.xml"/></Relationships>', "word/document.xml":
        f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>',}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return out.getvalue()


def write_pdf(paragraphs: list[tuple[str, str]]) -> bytes:
    """A PDF file of (style, text) in the standard sans-serif font; characters beyond Latin-1 are question marks."""
    room = PAGE[0] - 2 * MARGIN
    lines = [(STYLE_SIZES[s], line) for s, t in paragraphs for piece in t.split("\n") for line in [*wrap(piece, room, STYLE_SIZES[s])]] or [(SIZE, "")]
    per_page = (PAGE[1] - 2 * MARGIN) // LEADING
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)]
    shown = lambda t: t.encode("latin-1", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for page in pages:
        drawn = b"".join(b"/F1 %d Tf (%s) Tj T*\n" % (size, shown(line)) for size, line in page)
        stream = zlib.compress(b"BT %d TL %d %d Td\n%sET" % (LEADING, MARGIN, PAGE[1] - MARGIN, drawn))
        objects.append(
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*PAGE,
                len(objects) + 2))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages))
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(at) + 1, table, len(at) + 1, len(out))


_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/%]*|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")

    def plain(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c.isdigit() else b"" if c in (b"\n", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S).decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """The text that a page's operators show; a move to another line begins a new one."""
    out, stack = [], []
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", token):
            stack.append(token)
            continue
        if token in (b"T*", b"'", b'"') or token in (b"Td", b"TD") and stack and float(stack[-1]) != 0 or token in (b"Tm", b"ET"):
            out.append("\n")
        if token in (b"Tj", b"'", b'"') and stack:
            out.append(_string(stack[-1]))
        elif token == b"TJ":
            # a large step back between pieces is a blank
            out += [_string(t) if t[:1] in b"(<" else " " if re.fullmatch(rb"-[0-9.]+", t) and float(t) < -200 else "" for t in stack]
        stack = []
    return "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page of a PDF file without encryption and object streams, whose fonts are Latin."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)\b(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", data)}
    refs = lambda key, body: [int(n) for m in re.findall(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) for n in re.findall(
            rb"(\d+)\s+\d+\s+R", m)]

    def stream(number: int) -> bytes:
        body = objects.get(number, b"")
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        return b"" if m is None else zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    todo, out, seen = roots[::-1], [], set()
    while todo:
        number = todo.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if re.search(rb"/Type\s*/Pages\b", body):
            todo += refs(b"Kids", body)[::-1]
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(_shown(b"\n".join(map(stream, refs(b"Contents", body)))))
    return out


def pdf_text(data: bytes) -> str:
    return "\n".join(t for t in pdf_pages(data) if t)


def _paragraphs(text: str) -> list[tuple[str, str]]:
    """Lines as paragraphs; a short one in capitals or with a colon at its end is a heading."""
    head = lambda t: len(t) < 100 and ((t.isupper() or t.endswith(":")) and not t.endswith((".", ",")))
    return [("heading2" if head(t) else "normal", t) for t in text.split("\n") if t.strip()]


#: Methods of a conversion, the best first; each returns a file's bytes or raises.
LADDERS: dict[tuple[str, str], list[tuple[str, Callable[[bytes], bytes]]]] = {(".docx", ".pdf"): [("styled",
            lambda data: write_pdf(docx_paragraphs(data))), ("plain", lambda data: write_pdf([("normal", t) for _,
                t in docx_paragraphs(data)])), ("fallback", lambda data: write_pdf([("normal", re.sub(r"<[^>]+>", " ",
                zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "replace")))])),], (".pdf", ".docx"): [(
            "structured", lambda data: write_docx([p for page in pdf_pages(data) for p in _paragraphs(page)] or _nothing())), ("plain",
            lambda data: write_docx([("normal", t) for t in pdf_text(data).split("\n")])),],}


def _nothing() -> list:
    raise ValueError("no text was found")


def methods(source: str, target: str) -> list[str]:
    """The names of the methods for a pair of extensions, the best first."""
    return [name for name, _ in LADDERS.get((source, target), ())]


def convert(data: bytes, source: str, target: str) -> tuple[bytes | None, str | None, list[str]]:
    """(bytes, the method that made them, warnings) by the first method of the ladder that works."""
    warnings = []
    for name, method in LADDERS.get((source, target), ()):
        try:
            return method(data), name, warnings
        except Exception as e:  # whatever a method raises sends the file to the next one
            warnings.append(f"{name} failed: {e}")
    return None, None, warnings or [f"no method converts {source} to {target}"]


def convert_files(files: DataFrame, target: str, most_bytes: int = 100 << 20) -> DataFrame:
    """path, method, output (bytes) and warnings of converting files (path, content), one at a time.

    Empty and too large files, and those that no method converts, have no output and a warning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                extension = "." + path.rpartition(".")[2].lower()
                wrong = "File is empty" if not data else "File too large" if len(data) > most_bytes else None
                out, method, warnings = (None, None, [wrong]) if wrong else convert(data, extension, target)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([method], pa.string()), pa.array([out], pa.binary()),
                        pa.array([warnings], pa.list_(pa.string()))], ["path", "method", "output", "warnings"])

    return files.select("path", "content").mapInArrow(run, "path string, method string, output binary, warnings array<string>")
