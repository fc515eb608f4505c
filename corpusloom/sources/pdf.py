"""A reader of the text of plain PDF files, for where no PDF library is installed.

It follows the page tree, inflates streams and object streams and shows the
strings of text operators with single-byte codes or a ToUnicode table.  Files
that are encrypted raise an error; a page that can't be read is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_PART = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
WIDE = -200  # a shift beyond this (in thousandths of the font size) is a space between words


def _inflated(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]


def _objects(data: bytes) -> dict[int, bytes]:
    """Bodies by number, those in object streams too; a later one of a number replaces the earlier."""
    out = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            text, first = _inflated(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, text[:first].split()))
            places = [*numbers[1::2], len(text) - first]
            for n, a, b in zip(numbers[::2], places, places[1:]):
                out.setdefault(n, text[first + a : first + b])
    return out


def _refs(body: bytes, key: bytes) -> list[int]:
    """Numbers of the objects that an entry names, alone or in a list."""
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in _REF.findall(m[1])] if m else []


def _leaves(objects: dict[int, bytes], node: int, seen: set[int]) -> Iterator[int]:
    if node in seen or node not in objects:
        return
    seen.add(node)
    if kids := _refs(objects[node], b"Kids"):
        for k in kids:
            yield from _leaves(objects, k, seen)
    else:
        yield node


def _unicode(table: bytes) -> dict[int, str]:
    """Characters by code, of a ToUnicode table."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        out.update((int(a, 16), text(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out.update((int(a, 16) + i, chr(int(c, 16) + i)) for i in range(int(b, 16) - int(a, 16) + 1))
    return out


def _string(part: bytes, codes: dict[int, str]) -> str:
    if part[:1] == b"<":
        digits = b"".join(part[1:-1].split())
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", plain, part[1:-1], flags=re.S)
    if not codes:
        return raw.decode("cp1252", "replace")
    width = 2 if max(codes) > 255 else 1
    return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _shown(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    codes: dict[int, str] = {}
    for part in _PART.findall(content):
        if not part[:1].isalpha() and part not in (b"'", b'"', b"*"):
            held.append(part)
            continue
        if part == b"Tf":
            codes = next((fonts.get(x[1:], {}) for x in held if x[:1] == b"/"), {})
        elif part in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET"):
            level = part in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) == 0
            if out and not out[-1].endswith("\n"):
                out.append(" " if level else "\n")
        if part in (b"Tj", b"TJ", b"'", b'"'):
            for x in held:
                if x[:1] in (b"(", b"<"):
                    out.append(_string(x, codes))
                elif part == b"TJ" and re.fullmatch(rb"[-+.\d]+", x) and float(x) < WIDE:
                    out.append(" ")
        held.clear()
    return "".join(out).strip("\n")


def pages(data: bytes) -> list[str]:
    """The text of each page, in order."""
    if not data.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+", data):
        raise ValueError("encrypted")
    objects = _objects(data)
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    tree = _refs(objects[root], b"Pages") if root is not None else []
    out = []
    for leaf in _leaves(objects, tree[0], set()) if tree else ():
        try:
            body = objects[leaf]
            held = next((objects[r] for r in _refs(body, b"Resources")), body)
            named = re.search(rb"/Font\s*<<(.*?)>>", held, re.S) or next((re.search(rb"(.*)", objects[r], re.S) for r in _refs(held, b"Font")), None)
            fonts = {}
            for name, number in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", named[1]) if named else ():
                tables = _refs(objects.get(int(number), b""), b"ToUnicode")
                fonts[name] = _unicode(_inflated(objects[tables[0]])) if tables else {}
            out.append(_shown(b"\n".join(_inflated(objects[n]) for n in _refs(body, b"Contents")), fonts))
        except (KeyError, IndexError, ValueError, zlib.error):
            out.append("")
    return out
