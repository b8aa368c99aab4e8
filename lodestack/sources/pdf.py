"""Text of PDF files by page, with the standard library alone.

Read are classic and object-stream files with Flate or no compression, page trees with inherited
resources, simple fonts and composite ones with a ToUnicode map.  A new line begins where the
vertical position of the text changes.  Encrypted files and files without text are errors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"[ \t\r\n\f\0]*(?:%[^\r\n]*[\r\n ]*)*(?:(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<text>\()|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\s()<>\[\]{}/%])|(?P<bracket>[\[\]])|(?P<word>[^\s()<>\[\]{}/%]+))")
# Escapes of strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
GAP = -180  # thousandths of the font size: a greater step back between strings is a blank
Matrix = tuple[float, float, float, float, float, float]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string that begins at ``at`` (after its bracket) and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            at += 1
            octal = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
            if octal:
                out.append(int(octal.group(), 8) & 255)
                at = octal.end()
            elif c in b"\r\n":
                at += data[at - 1 : at + 1] == b"\r\n"
            else:
                out += ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes) -> Iterator[tuple[str, object]]:
    at = 0
    while m := TOKEN.match(data, at):
        at, kind = m.end(), m.lastgroup
        if kind == "text":
            value, at = _string(data, at)
            yield "string", value
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "number":
            yield "number", float(m["number"])
        else:
            yield kind, m[kind]


class Pdf:
    def __init__(self, data: bytes):
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("PDF converter: the file is encrypted")
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body[:400]):
                packed, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                numbers = [int(x) for x in packed[:first].split()]
                starts = [first + x for x in numbers[1::2]] + [len(packed)]
                for i, number in enumerate(numbers[::2]):
                    self.objects.setdefault(number, packed[starts[i] : starts[i + 1]])

    def stream(self, body: bytes) -> bytes:
        m = STREAM.match(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[2]) if re.search(rb"/Fl(?:ateDecode)?\b", m[1]) else m[2]

    def value(self, body: bytes, name: bytes) -> bytes:
        """The value of a key of a dictionary, a reference followed: text of the dictionary, array or number."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", STREAM.match(body)[1] if STREAM.match(body) else body)
        if not m:
            return b""
        rest = body[m.end() :]
        reference = REFERENCE.match(rest)
        if reference:
            return self.objects.get(int(reference[1]), b"")
        opening = next((o for o in (b"<<", b"[") if rest.startswith(o)), None)
        if not opening:
            return re.match(rb"/?[^\s/<>\[\]]*", rest)[0]
        closing, depth = (b">>", 0) if opening == b"<<" else (b"]", 0)
        for x in re.finditer(re.escape(opening) + rb"|" + re.escape(closing), rest):
            depth += 1 if x[0] == opening else -1
            if not depth:
                return rest[: x.end()]
        return rest

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """(page, resources) in reading order."""
        root = next((self.value(b, b"Pages") for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        todo, seen = [(root, b"")], 0
        while todo and seen < 10 * len(self.objects) + 10:
            node, inherited = todo.pop()
            seen += 1
            held = self.value(node, b"Resources") or inherited
            kids = self.value(node, b"Kids")
            if kids:
                todo += [(self.objects.get(int(m[1]), b""), held) for m in reversed(list(REFERENCE.finditer(kids)))]
            elif re.search(rb"/Type\s*/Page\b", node):
                yield node, held

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[bytes, str]]]:
        """(bytes a character, map to text) of each font."""
        out = {}
        for m in re.finditer(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            font = self.objects.get(int(m[2]), b"")
            wide = 2 if re.search(rb"/Subtype\s*/Type0\b", font) else 1
            out[m[1]] = (wide, self._characters(self.stream(self.value(font, b"ToUnicode"))))
        return out

    @staticmethod
    def _characters(cmap: bytes) -> dict[bytes, str]:
        def text(raw: bytes) -> str:
            return raw.decode("utf-16-be", "replace")

        out, held = {}, []
        for kind, value in _tokens(cmap):
            if kind == "word" and value in (b"beginbfchar", b"beginbfrange"):
                held = []
            elif kind == "word" and value == b"endbfchar":
                out.update(zip(held[::2], map(text, held[1::2]), strict=False))
            elif kind == "word" and value == b"endbfrange":
                at = 0
                while at + 2 < len(held):
                    low, high = held[at], held[at + 1]
                    codes = range(int.from_bytes(low), min(int.from_bytes(high), int.from_bytes(low) + 65535) + 1)
                    if held[at + 2] is None:  # a list of texts
                        end = held.index(None, at + 3)
                        targets, at = [text(x) for x in held[at + 3 : end]], end + 1
                    else:
                        base = held[at + 2]
                        targets, at = [text((int.from_bytes(base) + i).to_bytes(max(2, len(base)))) for i in range(len(codes))], at + 3
                    out.update((c.to_bytes(len(low)), x) for c, x in zip(codes, targets, strict=False))
            elif kind == "string":
                held.append(value)
            elif kind == "bracket":
                held.append(None)
        return out

    def text(self, page: bytes, resources: bytes) -> str:
        contents = self.value(page, b"Contents")
        parts = [self.stream(self.objects.get(int(m[1]), b"")) for m in REFERENCE.finditer(contents)] if contents.startswith(b"[") else [self.stream(contents)]
        fonts = self.fonts(resources)
        out: list[str] = []
        lasty = None

        def show(raw: bytes) -> None:
            nonlocal lasty
            wide, known = font
            shown = "".join(known.get(raw[i : i + wide], "" if wide == 2 else raw[i : i + 1].decode("cp1252", "replace")) for i in range(0, len(raw), wide))
            y = round(_times(line, place)[5], 3)
            out.append(shown if lasty is None or y == lasty else "\n" + shown)
            lasty = y

        unit: Matrix = (1, 0, 0, 1, 0, 0)
        place, saved, line, leading, font = unit, [], unit, 0.0, (1, {})
        operands: list = []
        array: list | None = None
        for kind, value in _tokens(b"\n".join(parts)):
            if kind == "bracket":
                if value == b"[":
                    array = []
                else:
                    operands.append(array or [])
                    array = None
                continue
            if kind != "word":
                (operands if array is None else array).append(value)
                continue
            numbers = [x for x in operands if isinstance(x, float)]
            if value == b"q":
                saved.append(place)
            elif value == b"Q" and saved:
                place = saved.pop()
            elif value == b"cm" and len(numbers) == 6:
                place = _times(tuple(numbers), place)
            elif value == b"BT":
                line = unit
            elif value == b"Tf" and operands:
                font = fonts.get(operands[0], (1, {})) if isinstance(operands[0], bytes) else (1, {})
            elif value == b"TL" and numbers:
                leading = numbers[0]
            elif value in (b"Td", b"TD") and len(numbers) == 2:
                line = _times((1, 0, 0, 1, numbers[0], numbers[1]), line)
                leading = -numbers[1] if value == b"TD" else leading
            elif value == b"Tm" and len(numbers) == 6:
                line = tuple(numbers)
            elif value in (b"T*", b"'", b'"'):
                line = _times((1, 0, 0, 1, 0, -leading), line)
            if value in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
                show(operands[-1])
            elif value == b"TJ" and operands and isinstance(operands[-1], list):
                for x in operands[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, float) and x < GAP and out and not out[-1].endswith(" "):
                        out.append(" ")
            operands = []
        return "".join(out).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page that has any."""
    if not data.startswith(b"%PDF"):
        raise ValueError("PDF converter: not a PDF file")
    file = Pdf(data)
    found = [t for t in (file.text(*p) for p in file.pages()) if t]
    if not found:
        raise ValueError("PDF converter: no text in the file")
    return found


def convert(data: bytes) -> list[tuple[str, str]]:
    return [("", "".join(pages(data)))]
