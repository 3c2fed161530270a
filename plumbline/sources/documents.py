"""Office documents, images and PDF pages on the standard library alone."""

from __future__ import annotations

import re
import struct
import unicodedata
import zipfile
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree as ET

from ..errors import BadInput, MissingDependency, NotFound
from ..operators.html import markdown, table, tree
from .tabular import excel_sheets

# Formats by extension, and where other formats go.
FORMATS = {".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".epub": "epub", ".msg": "msg"}
ELSEWHERE = {".pdf": "extract_pdf_text", ".ipynb": "extract_notebook", ".csv": "summarize_data", ".json": "summarize_data", ".parquet": "summarize_data", ".log": "summarize_log"}
MAX_CHARS = 200_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


@dataclass
class Document:
    source: str
    format: str
    markdown: str
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)


def read_document(path: str | Path, max_chars: int = MAX_CHARS) -> Document:
    path = Path(path)
    if not path.exists():
        raise NotFound(f"File not found: {path}")
    kind = FORMATS.get(path.suffix.lower())
    if kind is None:
        other = ELSEWHERE.get(path.suffix.lower())
        raise BadInput(f"{path.suffix} files are handled by {other}" if other else f"unsupported extension {path.suffix!r}; supported: {', '.join(sorted(FORMATS))}")
    if kind == "msg":
        raise MissingDependency("extract-msg", "MSG files")
    try:
        text = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "epub": epub}[kind](path).strip()
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise BadInput(f"{path.name} can't be read: {e}") from e
    out = Document(str(path), kind, text[:max_chars], len(text) > max_chars)
    if out.truncated:
        out.warnings.append(f"Output truncated to {max_chars:,} chars")
    if not text:
        out.warnings.append("no text was found")
    return out


def docx(path: Path) -> str:
    with zipfile.ZipFile(path) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")

    def paragraph(p: ET.Element) -> str:
        text = "".join("\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else t.text or "" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val", "") if style is not None else ""
        if m := re.match(r"(?i)heading\s*([1-6])", name):
            return f"{'#' * int(m[1])} {text}"
        if name.lower() == "title":
            return f"# {text}"
        return f"- {text}" if p.find(f"{W}pPr/{W}numPr") is not None else text

    parts = []
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            parts.append(paragraph(node))
        elif node.tag == f"{W}tbl":
            parts.append(table([[" ".join(paragraph(p) for p in c.iter(f"{W}p")).replace("|", "\\|") for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(p for p in parts if p.strip()))


def pptx(path: Path) -> str:
    out = []
    with zipfile.ZipFile(path) as z:
        slides = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for k, name in enumerate(sorted(slides, key=lambda n: int(re.findall(r"\d+", n)[-1])), 1):
            lines = ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in ET.fromstring(z.read(name)).iter(f"{A}p")]
            out.append(f"## Slide {k}\n\n" + "\n".join(x for x in lines if x.strip()))
    return "\n\n".join(out)


def xlsx(path: Path) -> str:
    return "\n\n".join(f"## {name}\n\n{table([[c or '' for c in r] for r in rows])}" for name, rows in excel_sheets(path))


def epub(path: Path) -> str:
    with zipfile.ZipFile(path) as z:
        opf = next(e.get("full-path", "") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        package = ET.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href", "") for e in package.iter() if e.tag.endswith("}item")}
        base = opf.rpartition("/")[0]
        names = [f"{base}/{items[e.get('idref')]}".lstrip("/") for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        pages = [tree(z.read(n).decode("utf-8", "replace")) for n in names if n in z.namelist()]
    return "\n\n".join(markdown(p.find("body") or p) for p in pages)


def image_info(data: bytes) -> tuple[int, int, str, str]:
    """Width, height, mode and format from an image's header: PNG, GIF, JPEG, BMP or WebP."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        w, h, _, color = struct.unpack(">IIBB", data[16:26])
        return w, h, PNG_MODES.get(color, "?"), "PNG"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return *struct.unpack("<HH", data[6:10]), "P", "GIF"
    if data.startswith(b"BM"):
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return w, abs(h), {1: "1", 8: "P", 32: "RGBA"}.get(bits, "RGB"), "BMP"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "RGBA" if data[20] & 16 else "RGB", "WEBP"
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB", "WEBP"
        return *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30])), "RGB", "WEBP"
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(data[at + 9], "?"), "JPEG"
            at += 2 + size
    raise BadInput("not an image that can be recognised")


def page_set(text: str, total: int) -> list[int]:
    """Pages of a range such as 1-5,7; parts that make no sense are ignored."""
    out: set[int] = set()
    for part in text.split(","):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+))?\s*", part):
            out |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(p for p in out if 1 <= p <= total)


def clean_page(text: str) -> str:
    """A page's text: compatibility forms, no NUL, words joined over line ends, one blank line at most."""
    text = unicodedata.normalize("NFKC", text).replace("\x00", "").replace("\r", "")
    text = re.sub(r"(\w)-\n(\w)", r"\1\2", re.sub(r"[^\S\n\t ]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in text.splitlines())).strip()


def joined_paragraphs(text: str) -> str:
    """Lines of a paragraph as one: a line goes to the one before if that is long and doesn't end a sentence."""
    out: list[str] = []
    for line in text.splitlines():
        if out and line and len(out[-1]) > 40 and out[-1][-1] not in ".!?:":
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def mean_confidence(words: list[tuple[str, float]], least: float = 30) -> tuple[str, float]:
    """Text and mean confidence of recognised words that aren't blank and are sure enough."""
    kept = [(w, c) for w, c in words if w.strip() and c >= least]
    return " ".join(w for w, _ in kept), sum(c for _, c in kept) / len(kept) if kept else 0.0


def read_pdf(path: str | Path, pages: str | None = None, force_ocr: bool = False) -> list[tuple[int, str]]:
    """Page numbers and text of a PDF's text layer, where a PDF package is installed."""
    if not Path(path).exists():
        raise NotFound(f"File not found: {path}")
    if force_ocr:
        raise MissingDependency("pytesseract", "text recognition")
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise MissingDependency("pypdf", "PDF files") from e
    reader = PdfReader(str(path))
    if reader.is_encrypted:
        raise PermissionError(f"{path} is encrypted")
    wanted = page_set(pages, len(reader.pages)) if pages else range(1, len(reader.pages) + 1)
    return [(k, joined_paragraphs(clean_page(reader.pages[k - 1].extract_text() or ""))) for k in wanted]
