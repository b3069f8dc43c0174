"""Text of simple PDF files, read without any other program: objects, streams, page order, fonts' own maps to Unicode.

Meant for text that a program printed. A page whose fonts name no characters, or that is an image, gives what can be
read of it; an encrypted file is unreadable. Another reader can be put in the place of this one (see page_texts).
"""

from __future__ import annotations

import re
import zlib

#: Bytes a stream may unpack to.
UNPACKED = 64 << 20
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\]()/%]*|[^\s<>\[\]()/%]+", re.S)
# Escapes of a literal string.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1] in b"01234567":
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.S)


def _hex(raw: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", raw[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Pdf:
    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF") or b"/Encrypt" in content[-4096:]:
            raise ValueError("no readable PDF")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """Objects that a stream holds side by side."""
        data = self.stream(body)
        first = re.search(rb"/First\s+(\d+)", body)
        if data is None or not first:
            return
        start = int(first[1])
        numbers = [int(x) for x in data[:start].split()]
        places = list(zip(numbers[::2], numbers[1::2]))
        for (number, at), nxt in zip(places, [p for _, p in places[1:]] + [len(data) - start]):
            self.objects.setdefault(number, data[start + at : start + nxt])

    def stream(self, body: bytes) -> bytes | None:
        m = _STREAM.match(body)
        if not m:
            return None
        if b"/FlateDecode" not in m[1]:
            return m[2] if b"/Filter" not in m[1] else None
        try:
            return zlib.decompressobj().decompress(m[2], UNPACKED)
        except zlib.error:
            return None

    def referred(self, body: bytes, key: bytes) -> list[int]:
        """Numbers of the objects that a key of a dictionary names, one or an array of them."""
        m = re.search(rb"/" + key + rb"\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", body)
        if not m:
            return []
        return [int(m[2])] if m[2] else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]

    def pages(self) -> list[bytes]:
        """The page dictionaries in reading order."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        todo, seen = self.referred(root, b"Pages"), set()
        while todo:
            n = todo.pop(0)
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            body = self.objects[n]
            if re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
            else:
                todo = self.referred(body, b"Kids") + todo
        return out

    def fonts(self, page: bytes) -> dict[bytes, tuple[dict[bytes, str], int]]:
        """Per name of a font on a page: its map from codes to text, and the bytes of a code."""
        held = page
        for key in (b"Resources", b"Font"):
            for n in self.referred(held, key)[:1]:
                held += self.objects.get(n, b"")
        found = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", held):
            body = self.objects.get(int(number), b"")
            if b"/Font" not in body:
                continue
            to_text = next((self.stream(self.objects[n]) for n in self.referred(body, b"ToUnicode") if n in self.objects), None)
            found[name] = (_code_map(to_text or b""), 2 if b"/Type0" in body else 1)
        return found

    def page_text(self, page: bytes) -> str:
        content = b"\n".join(s for n in self.referred(page, b"Contents") if (s := self.stream(self.objects.get(n, b""))) is not None)
        fonts = self.fonts(page)
        font: tuple[dict[bytes, str], int] = ({}, 1)
        out: list[str] = []
        stack: list[bytes] = []
        line = None

        def show(raw: bytes) -> None:
            code = _literal(raw) if raw[:1] == b"(" else _hex(raw)
            codes, width = font
            if codes:
                out.append("".join(codes.get(code[i : i + width], "") for i in range(0, len(code), width)))
            else:
                out.append(code.decode("utf-16-be", "replace") if width == 2 else code.decode("cp1252", "replace"))

        for token in _TOKEN.findall(content):
            if token == b"Tf" and len(stack) >= 2:
                font = fonts.get(stack[-2][1:], ({}, 1))
            elif token in (b"Tj", b"'", b'"') and stack:
                if token != b"Tj":
                    out.append("\n")
                show(stack[-1])
            elif token == b"TJ":
                for part in stack[stack.index(b"[") if b"[" in stack else 0 :]:
                    if part[:1] in (b"(", b"<"):
                        show(part)
                    elif re.fullmatch(rb"-?\d+\.?\d*", part) and float(part) < -180:
                        out.append(" ")
            elif token == b"T*" or (token in (b"Td", b"TD") and len(stack) >= 2 and stack[-1] not in (b"0", b"0.0")):
                out.append("\n")
            elif token in (b"Td", b"TD"):
                out.append(" ")
            elif token == b"Tm" and len(stack) >= 6:
                out.append(" " if stack[-1] == line else "\n")
                line = stack[-1]
            elif token == b"ET":
                out.append("\n")
            else:
                stack.append(token)
                continue
            stack = []
        return "\n".join(x for x in (" ".join(t.split()) for t in "".join(out).split("\n")) if x)


def _code_map(stream: bytes) -> dict[bytes, str]:
    text = lambda raw: _hex(raw).decode("utf-16-be", "replace")
    found: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)", block):
            found[_hex(code)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for low, high, to in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)\s*(<[^>]*>|\[[^\]]*\])", block):
            a, b = _hex(low), _hex(high)
            codes = range(int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535) + 1)
            names = [text(x) for x in re.findall(rb"<[^>]*>", to)] if to[:1] == b"[" else None
            for i, c in enumerate(codes):
                first = text(to) if names is None else ""
                found[c.to_bytes(len(a), "big")] = names[i] if names and i < len(names) else first[:-1] + chr(ord(first[-1]) + i) if first else ""
    return found


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page in order."""
    pdf = Pdf(content)
    return [pdf.page_text(p) for p in pdf.pages()]


def pdf_text(content: bytes) -> str:
    return "\n\f\n".join(pdf_pages(content))
