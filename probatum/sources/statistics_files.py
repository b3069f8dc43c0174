"""Data frames of statistics programs: Stata files by their stored codes, R's serialised data frames parsed, never run.

Each reader gives (header, columns) of the wanted columns; what is no data frame raises Unreadable.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct

import numpy as np

from probatum.sources.trees import Unreadable

# Type codes of the serialisation format, and its markers of missing values.
NIL, GLOBALS, ALTERNATIVE, REFERENCE = 254, 253, 238, 255
SYMBOL, PAIRLIST, CHARACTERS, LOGICAL, INTEGER, REAL, STRINGS, LIST = 1, 2, 9, 10, 13, 14, 16, 19
NA_INTEGER, NA_REAL = -(1 << 31), 1954


def shortest_single(value: float) -> str:
    """The shortest text that reads back as the same value in single precision."""
    return str(np.float32(value)).removesuffix(".0")


def stata(content: bytes, wanted: frozenset[str] | None) -> tuple[list[str], list[list]]:
    """The columns of a .dta file; labelled values by the code stored, single-precision ones by their shortest text."""
    import pandas as pd

    try:
        frame = pd.read_stata(io.BytesIO(content), convert_categoricals=False, preserve_dtypes=True)
    except (ValueError, KeyError, IndexError, struct.error, UnicodeDecodeError) as e:
        raise Unreadable(str(e)[:200]) from e
    kept = [c for c in frame.columns if wanted is None or c in wanted]
    columns = []
    for c in kept:
        single = frame[c].dtype == np.float32
        columns.append([None if v is None or v is pd.NaT or v != v else shortest_single(v) if single else v.item() if hasattr(v, "item") else v for v in frame[c]])
    return kept, columns


class _Serialised:
    """Reads one object of the XDR form: only data, no closures, environments or calls."""

    def __init__(self, data: bytes):
        self.data, self.at, self.seen = data, 0, []

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data) or n < 0:
            raise Unreadable("ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def whole(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        n = self.whole()
        return n if n >= 0 else (self.whole() << 32) + self.whole()

    def attributes(self) -> dict:
        found, item = {}, self.item()
        while isinstance(item, tuple):
            tag, value, item = item
            found[tag] = value
        return found

    def item(self):
        flags = self.whole()
        kind, has_attributes, has_tag = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
        if kind in (NIL, GLOBALS, 0):
            return None
        if kind == REFERENCE:
            return self.seen[(flags >> 8 or self.whole()) - 1]
        if kind == SYMBOL:
            self.seen.append(self.item())
            return self.seen[-1]
        if kind == CHARACTERS:
            n = self.whole()
            return None if n < 0 else self.take(n).decode("utf-8", "replace")
        if kind == PAIRLIST:
            attributes = self.attributes() if has_attributes else {}  # noqa: F841
            tag = self.item() if has_tag else None
            return tag, self.item(), self.item()
        if kind == ALTERNATIVE:
            info, state, _ = self.item(), self.item(), self.item()
            name = info[1] if isinstance(info, tuple) else ""
            if name in ("compact_intseq", "compact_realseq"):
                n, first, step = state["values"]
                return {"values": [first + i * step for i in range(int(n))], "attributes": {}}
            held = state
            while isinstance(held, tuple):
                held = held[1]
            if name.startswith("wrap_") or name == "deferred_string":
                inner = held["values"][0] if isinstance(held, dict) and held.get("list") else held
                if name == "deferred_string":
                    inner = {"values": [None if v is None else str(v).removesuffix(".0") for v in inner["values"]], "attributes": {}}
                return inner
            raise Unreadable(f"holds {name}")
        if kind in (LOGICAL, INTEGER):
            n = self.count()
            raw = np.frombuffer(self.take(4 * n), ">i4")
            values = [None if v == NA_INTEGER else bool(v) if kind == LOGICAL else int(v) for v in raw]
        elif kind == REAL:
            n = self.count()
            block = self.take(8 * n)
            raw, low = np.frombuffer(block, ">f8"), np.frombuffer(block, ">u4")[1::2]
            values = [None if v != v and b == NA_REAL else float(v) for v, b in zip(raw, low)]
        elif kind in (STRINGS, LIST):
            values = [self.item() for _ in range(self.count())]
        else:
            raise Unreadable(f"holds an object of kind {kind}")
        return {"values": values, "attributes": self.attributes() if has_attributes else {}, "list": kind == LIST}


def r_frame(content: bytes, wanted: frozenset[str] | None) -> tuple[list[str], list[list]]:
    """The columns of an .rds file that holds a data frame; a factor gives its labels."""
    for magic, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if content.startswith(magic):
            try:
                content = unpack(content)
            except (OSError, EOFError, lzma.LZMAError) as e:
                raise Unreadable(str(e)) from e
    if content[:2] != b"X\n":
        raise Unreadable("not in the binary form")
    reader = _Serialised(content)
    reader.take(2)
    version = reader.whole()
    reader.take(8)
    if version == 3:
        reader.take(reader.whole())
    try:
        frame = reader.item()
    except (IndexError, TypeError, KeyError, ValueError, struct.error, RecursionError) as e:
        raise Unreadable(str(e)) from e
    attributes = frame.get("attributes", {}) if isinstance(frame, dict) else {}
    kind = attributes.get("class")
    if kind is None or "data.frame" not in kind["values"] or "names" not in attributes:
        raise Unreadable("holds no data frame")
    names, columns = [], []
    for name, column in zip(attributes["names"]["values"], frame["values"]):
        if wanted is not None and name not in wanted:
            continue
        levels = column["attributes"].get("levels")
        names.append(name)
        columns.append([None if v is None else levels["values"][v - 1] for v in column["values"]] if levels else column["values"])
    return names, columns
