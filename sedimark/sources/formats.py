"""What a file is and what text it holds: detection by content and suffix, decoding, and the readers of single files.

These are small helpers of the tasks that scan() and extract() run; each takes the bytes of one file.
"""

from __future__ import annotations

import html.parser
import io
import posixpath
import re
import zipfile
from itertools import accumulate
from urllib.parse import unquote
from xml.etree import ElementTree

# Formats by suffix.
SUFFIXES = {
    "pdf": "pdf", "epub": "epub", "mobi": "mobi", "azw": "azw", "azw3": "azw3", "txt": "txt", "text": "txt", "md": "md", "markdown": "md",
    "docx": "docx", "html": "html", "htm": "html", "rtf": "rtf",
}
# How formats begin; zip archives are told apart by what they hold.
BEGINNINGS = ((b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"), (b"BOOKMOBI", "mobi"))
# Limits of a file's bytes and of an archive's compression, and bytes that detection reads.
MAX_BYTES, MAX_ZIP_RATIO, HEAD_BYTES, TEXT_HEAD_BYTES = 200 * 1024 * 1024, 100, 8, 4096
# Byte order marks, of which the longer come before those they begin with, and encodings to try without one.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
ENCODINGS = ("utf-8", "gbk", "gb2312", "cp1252", "latin-1")
# Groups of an RTF file that are no text.
RTF_SKIPPED = {"fonttbl", "stylesheet", "colortbl", "info", "pict", "header", "footer", "footerpar", "headerpar", "listtable", "listoverridetable", "rsidtbl", "latentstyles"}
#: Characters that no extracted text keeps: controls but for tab and line ends, zero-width characters and directional marks.
UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b-\u200d\u2060\ufeff\u202a-\u202e\u2066-\u2069]")


def looks_like_text(head: bytes) -> bool:
    """Whether a file's first bytes have a byte order mark or are printable to nine tenths; bytes from 0x80 on count for neither side."""
    if head.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        return True
    if len(head) < 4 or 0 in head:
        return False
    low = [b for b in head if b < 0x80]
    return bool(low) and 10 * sum(32 <= b < 127 or b in b"\t\n\r" for b in low) >= 9 * len(low)


def zip_format(data: bytes) -> str | None:
    """epub or docx by an archive's members, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            kind = z.read("mimetype").decode("utf-8", "replace").lower() if "mimetype" in names else ""
    except (zipfile.BadZipFile, OSError, RuntimeError, ValueError, NotImplementedError):
        return None
    if "epub" in kind or "META-INF/encryption.xml" in names:
        return "epub"
    return "docx" if "[Content_Types].xml" in names and any(n.startswith("word/") for n in names) else None


def content_format(data: bytes, suffix: str) -> str | None:
    """The format that a file's bytes tell; the suffix only tells kinds of plain text apart."""
    head = data[:HEAD_BYTES]
    for begin, kind in BEGINNINGS:
        if head.startswith(begin):
            return zip_format(data) if kind == "zip" else kind
    if not looks_like_text(head):
        return None
    text = data[:TEXT_HEAD_BYTES].decode("utf-8", "replace").lower().lstrip()
    if text.startswith(("<!doctype html", "<html")):
        return "html"
    if text.startswith("{\\rtf"):
        return "rtf"
    named = SUFFIXES.get(suffix)
    return named if named in ("md", "txt") else None if named else "txt"


def detect(data: bytes, suffix: str) -> tuple[str | None, str]:
    """(format, what told it: both, content or extension). Where they disagree the content counts."""
    named, found = SUFFIXES.get(suffix), content_format(data, suffix)
    if found:
        return found, "both" if found == named else "content"
    return named, "extension"


def archive_fault(data: bytes) -> bool:
    """Whether an archive is damaged or, at any of its entries, has grown to more than MAX_ZIP_RATIO times its size so far."""
    packed = unpacked = 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for entry in z.infolist():
                packed += entry.compress_size
                unpacked += entry.file_size
                if packed and unpacked > MAX_ZIP_RATIO * packed:
                    return True
    except (zipfile.BadZipFile, OSError):
        return True
    return False


def is_locked(data: bytes) -> bool:
    """Whether a MOBI file's first record says that it is encrypted."""
    if len(data) < 82 or not int.from_bytes(data[76:78], "big"):
        return False
    at = int.from_bytes(data[78:82], "big") + 12
    return at + 2 <= len(data) and data[at : at + 2] != b"\0\0"


def decode(data: bytes) -> str:
    """Text of unknown encoding: by its byte order mark, else the first encoding that reads all of it."""
    marked = next((e for mark, e in MARKS if data.startswith(mark)), None)
    for encoding in [*([marked] if marked else []), *ENCODINGS]:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("the last encoding reads any bytes")


class _Lines(html.parser.HTMLParser):
    """Text of block elements, without scripts, styles, navigation and the like."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "head"}
    BREAK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "section", "article", "blockquote", "pre", "td", "th", "ul", "ol", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.skipping = [], [], 0

    def cut(self):
        line = re.sub(r"\s+", " ", "".join(self.now)).strip()
        if line:
            self.out.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipping += 1
        if tag in self.BREAK:
            self.cut()

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skipping:
            self.skipping -= 1
        if tag in self.BREAK:
            self.cut()

    def handle_data(self, data):
        if not self.skipping:
            self.now.append(data)


def html_lines(text: str) -> list[str]:
    parser = _Lines()
    parser.feed(text)
    parser.close()
    parser.cut()
    return parser.out


def rtf_text(data: bytes) -> str:
    """The text of an RTF file.

    Open groups are a stack of booleans: whether what is inside is left out. A skipped destination opens a level of its own, which its group's brace closes,
    so text behind it is kept again. Every control word with an initial u stands for one character that is not shown, '?'.
    """
    text = data.decode("utf-8", "replace")
    word = re.compile(r"\\([^\W\d_]*)-?\d* ?")
    shown = re.compile(r"\\u-?\d* ?(?:\\'..(?=.)|\\'..$)?", re.S)
    plain = {"\\": "\\", "{": "{", "}": "}", "~": " ", "_": "\u2011", "\r": "", "\n": ""}
    breaks = {"par": "\n", "line": "\n", "tab": " "}
    levels, out, at = [False], [], 0
    while at < len(text):
        c = text[at]
        if c == "{":
            ignored = text.startswith("\\*", at + 1)
            levels.append(ignored or levels[-1])
            at += 3 if ignored else 1
        elif c == "}":
            if len(levels) > 1:
                levels.pop()
            at += 1
        elif c != "\\":
            end = re.compile(r"[^\\{}]+").match(text, at).end()
            if not levels[-1]:
                out.append(text[at:end])
            at = end
        else:
            found = word.match(text, at)
            name, follows = found[1], text[at + 1 : at + 2]
            if levels[-1]:
                at = found.end()
            elif name in RTF_SKIPPED:
                levels.append(True)
                at = found.end()
            elif not follows:
                out.append("\\")
                at += 1
            elif follows == "'" and at + 3 < len(text):
                digits = text[at + 2 : at + 4]
                out.append(chr(int(digits, 16)) if re.fullmatch("[0-9a-fA-F]{2}", digits) else "")
                at += 4
            elif follows == "u" and at + 2 < len(text):
                out.append("?")
                at = shown.match(text, at).end()
            elif follows in plain:
                out.append(plain[follows])
                at += 3 if text.startswith("\r\n", at + 1) else 2
            else:
                out.append(breaks.get(name, ""))
                at = found.end()
    return "".join(out)


def _xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data, re.I):
        raise ValueError("xml_unsafe")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def epub_chapters(data: bytes) -> list[str]:
    """The text of each document of an EPUB in the order of its spine; of all its pages by name where there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        spine: list[str] = []
        if "META-INF/container.xml" in names:
            package = next((e.get("full-path") for e in _xml(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile"), None)
            if package in names:
                opf = _xml(z.read(package))
                items = {e.get("id"): unquote(e.get("href", "")) for e in opf.iter() if _local(e) == "item"}
                places = [items.get(e.get("idref")) for e in opf.iter() if _local(e) == "itemref"]
                spine = [p for h in places if h and (p := posixpath.normpath(posixpath.join(posixpath.dirname(package), h))) in names]
        pages = spine or sorted(n for n in names if re.search(r"\.x?html?$", n))
        return ["\n".join(html_lines(z.read(n).decode("utf-8", "replace"))) for n in pages]


def docx_lines(data: bytes) -> list[str]:
    """A line for each paragraph and each table row (its cells between tabs) of a DOCX body."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next((e for e in _xml(z.read("word/document.xml")) if _local(e) == "body"), None)
    out = []
    pieces = {"tab": "\t", "br": "\n"}
    said = lambda e: "".join(x.text or "" if _local(x) == "t" else pieces.get(_local(x), "") for x in e.iter())
    for e in body if body is not None else []:
        if _local(e) == "p":
            out.append(said(e))
        elif _local(e) == "tbl":
            out += ["\t".join(said(cell).strip() for cell in row if _local(cell) == "tc") for row in e if _local(row) == "tr"]
    return out


def file_blocks(kind: str, data: bytes) -> list[tuple[str, str]]:
    """(locator, text) of a file's blocks: paragraphs of texts, Markdown and RTF, block elements of HTML, chapters of EPUB by their place in the spine, lines of DOCX."""
    if kind == "html":
        parts = html_lines(decode(data))
    elif kind == "epub":
        parts = epub_chapters(data)
    elif kind == "docx":
        parts = re.split(r"\n+", "\n".join(docx_lines(data)))
    elif kind in ("txt", "md", "rtf"):
        text = rtf_text(data) if kind == "rtf" else decode(data)
        parts = text.replace("\r\n", "\n").split("\n\n")
    else:
        raise ValueError("no_reader")
    clean = [UNSAFE.sub("", p).strip() for p in parts]
    named = "chapter" if kind == "epub" else "paragraph"
    # chapters are counted with the empty ones, paragraphs without
    numbers = range(1, len(clean) + 1) if kind == "epub" else accumulate(map(bool, clean))
    return [(f"{named} {n}", p) for n, p in zip(numbers, clean) if p]
