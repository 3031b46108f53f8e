"""Text of PDF files without a library: page streams are inflated and their text operators read in order.

Plain and Flate streams with simple (one byte a character) or UTF-16 strings are understood, which is what text tools
write; fonts with their own encodings, encrypted files and scans are not, and such files count as failures.  An
installed PDF library can be injected instead (``Config.pdf_text``)."""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<[^<]|>[^>]|<<[^<>]*>>)*)>>\s*stream\r?\n(?P<body>.*?)endstream", re.S)
_TEXT = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_TOKEN = re.compile(
    rb"(?P<string>\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<list>\[)|(?P<end>\])|(?P<number>[-+]?\d*\.?\d+)|(?P<name>/[^\s/<>\[\]()]+)|(?P<op>T\*|[A-Za-z'\"]+)", re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A step to the left in a list of strings, in thousandths of the font size, that stands for a space.
GAP = -200


def _plain(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _lines(block: bytes) -> list[tuple[float, str]]:
    """(font size, text) of the lines of a text block."""
    out, size, shown, line, held = [], 0.0, 0.0, "", []

    def close():
        nonlocal line
        if line.strip():
            out.append((shown, line.strip()))
        line = ""

    for m in _TOKEN.finditer(block):
        kind, token = m.lastgroup, m[0]
        if kind != "op":
            held.append((kind, token))
            continue
        strings = [_plain(t) if k != "number" else " " if float(t) < GAP else "" for k, t in held if k in ("string", "hex") or (token == b"TJ" and k == "number")]
        numbers = [float(t) for k, t in held if k == "number"]
        if token in (b"T*", b"'", b'"') or (token in (b"Td", b"TD") and numbers[-1:] != [0.0]) or token == b"Tm":
            close()
        if token == b"Tf" and numbers:
            size = numbers[-1]
        if token in (b"Tj", b"TJ", b"'", b'"'):
            shown = size if not line else shown
            line += "".join(strings)
        held = []
    close()
    return out


def pages(content: bytes) -> list[list[tuple[float, str]]]:
    """(font size, text) of the lines of each page that has text."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    if b"/Encrypt" in content:
        raise ValueError("encrypted PDF")
    found = []
    for m in _STREAM.finditer(content):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        lines = [line for block in _TEXT.findall(body) for line in _lines(block)]
        if lines:
            found.append(lines)
    if not found:
        raise ValueError("no text in this PDF")
    return found


def pdf_text(content: bytes) -> str:
    """The text of all pages, joined by line ends."""
    return "\n".join("\n".join(text for _, text in page) for page in pages(content))


def pdf_markdown(content: bytes) -> str:
    """The same as Markdown: lines in a larger font than most are headings; pages are joined by an empty line."""
    told = pages(content)
    sizes = sorted(size for page in told for size, text in page for _ in text)
    usual = sizes[len(sizes) // 2]
    return "\n\n".join("\n".join(("# " if size > 1.5 * usual else "## " if size > 1.15 * usual else "") + text for size, text in page) for page in told)
