"""R's serialization format (XDR, versions 2 and 3), as the R Internals manual describes it.

Objects are plain: None for NULL, ``Vector`` for atomic vectors and lists, ``Pairs`` for pairlists and calls,
``S4``, ``Symbol``, ``Environment``, ``Opaque`` for what holds no data here. Attributes are dicts in their order.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np

#: Type codes of the format.
NIL, SYM, LIST, CLO, ENV, PROM, LANG, SPECIAL, BUILTIN, CHAR, LGL, INT, REAL, CPLX, STR, DOT, VEC, EXPR, BCODE, EXTPTR, WEAKREF, RAW, S4_ = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15, 16, 17, 19, 20, 21, 22, 23, 24, 25
REF, NILVALUE, GLOBALENV, UNBOUND, MISSING, BASENS, NAMESPACE, PACKAGE, PERSIST, EMPTYENV, BASEENV, ATTRLANG, ATTRLIST, ALTREP = 255, 254, 253, 252, 251, 247, 249, 250, 248, 242, 241, 240, 239, 238
NA_INT = -(2**31)
KINDS = {LGL: "logical", INT: "integer", REAL: "double", CPLX: "complex", STR: "character", VEC: "list", EXPR: "expression", RAW: "raw"}
CODES = {v: k for k, v in KINDS.items()}
DTYPES = {"logical": ">i4", "integer": ">i4", "double": ">f8", "complex": ">c16"}


@dataclass
class Vector:
    """kind: one of KINDS. values: numpy array for numbers, list for strings (None is NA), lists and expressions, bytes for raw."""

    kind: str
    values: Any
    attrs: dict[str, Any] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.values)

    @property
    def names(self) -> list[str] | None:
        n = self.attrs.get("names")
        return None if n is None else list(n.values)

    @property
    def classes(self) -> list[str]:
        c = self.attrs.get("class")
        return [] if c is None else list(c.values)

    def __getitem__(self, name: str) -> Any:
        """The member of a list by name, None if there is none."""
        names = self.names or []
        return self.values[names.index(name)] if name in names else None


@dataclass(frozen=True)
class Symbol:
    name: str


@dataclass
class Pairs:
    """items: (tag or None, value). call: whether it is a call."""

    items: list[tuple[str | None, Any]]
    attrs: dict[str, Any] = field(default_factory=dict)
    call: bool = False


@dataclass
class S4:
    attrs: dict[str, Any]

    @property
    def classes(self) -> list[str]:
        c = self.attrs.get("class")
        return [] if c is None else list(c.values)


@dataclass
class Environment:
    content: dict[str, Any] = field(default_factory=dict)
    attrs: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Opaque:
    code: int


def strings(*values: str | None, **attrs) -> Vector:
    return Vector("character", list(values), attrs)


def ints(values, **attrs) -> Vector:
    return Vector("integer", np.asarray(values, np.int32), attrs)


def doubles(values, **attrs) -> Vector:
    return Vector("double", np.asarray(values, np.float64), attrs)


def named(members: dict[str, Any], **attrs) -> Vector:
    return Vector("list", list(members.values()), {"names": strings(*members), **attrs})


def unpack(data: bytes) -> bytes:
    """The stream of a file that may be compressed."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.decompress(data)
    return data


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.refs = memoryview(data), 0, []

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise EOFError("the stream ends within an object")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def length(self) -> int:
        n = self.int()
        return (self.int() << 32) + (self.int() & 0xFFFFFFFF) if n == -1 else n

    def header(self) -> None:
        if bytes(self.take(2)) != b"X\n":
            raise ValueError("only R's XDR serialization is read")
        version = self.int()
        self.int(), self.int()
        if version == 3:
            self.take(self.int())
        elif version != 2:
            raise ValueError(f"serialization version {version}")

    def keep(self, x: Any) -> Any:
        self.refs.append(x)
        return x

    def attributes(self) -> dict[str, Any]:
        pairs = self.item()
        return {} if pairs is None else {t: v for t, v in pairs.items if t is not None}

    def item(self, flags: int | None = None) -> Any:
        flags = self.int() if flags is None else flags
        code, has_attr, has_tag = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
        if code in (NIL, NILVALUE):
            return None
        if code == REF:
            return self.refs[((flags >> 8) or self.int()) - 1]
        if code in (GLOBALENV, UNBOUND, MISSING, BASENS, EMPTYENV, BASEENV):
            return Opaque(code)
        if code == SYM:
            return self.keep(Symbol(self.item() or "NA"))
        if code in (NAMESPACE, PACKAGE, PERSIST):
            self.int()
            return self.keep(Pairs([(None, self.item()) for _ in range(self.int())]))
        if code == ENV:
            self.int()
            env = self.keep(Environment())
            self.item()
            frame, table, attrs = self.item(), self.item(), self.item()
            for part in [frame, *(table.values if table is not None else [])]:
                if part is not None:
                    env.content.update({t: v for t, v in part.items})
            env.attrs = {} if attrs is None else dict(attrs.items)
            return env
        if code in (LIST, LANG, CLO, PROM, DOT, ATTRLANG, ATTRLIST):
            return self.pairs(code, has_attr or code in (ATTRLANG, ATTRLIST), has_tag)
        if code == ALTREP:
            return self.altrep()
        if code == CHAR:
            n = self.int()
            text = None if n == -1 else self.text(bytes(self.take(n)), flags >> 12)
            if has_attr:
                self.item()
            return text
        if code in (SPECIAL, BUILTIN):
            return Opaque(code if self.take(self.int()) is not None else code)
        if code in (EXTPTR, WEAKREF):
            out = self.keep(Opaque(code))
            if code == EXTPTR:
                self.item(), self.item()
            if has_attr:
                self.item()
            return out
        if code == S4_:
            return S4(self.attributes() if has_attr else {})
        if code not in KINDS:
            raise ValueError(f"objects of type {code} are not read")
        return self.vector(code, has_attr)

    def text(self, raw: bytes, levels: int) -> str:
        return raw.decode("latin-1") if levels & 4 else raw.decode("utf-8", "surrogateescape")

    def vector(self, code: int, has_attr: bool) -> Vector:
        kind = KINDS[code]
        values = self.values(kind, self.length())
        return Vector(kind, values, self.attributes() if has_attr else {})

    def values(self, kind: str, n: int) -> Any:
        if kind in DTYPES:
            dtype = np.dtype(DTYPES[kind])
            return np.frombuffer(self.take(n * dtype.itemsize), dtype).astype(dtype.newbyteorder("="))
        return bytes(self.take(n)) if kind == "raw" else [self.item() for _ in range(n)]

    def pairs(self, code: int, has_attr: bool, has_tag: bool) -> Pairs:
        out = Pairs([], call=code in (LANG, ATTRLANG))
        if has_attr:
            out.attrs = self.attributes()
        while True:
            tag = self.item() if has_tag else None
            out.items.append((tag.name if isinstance(tag, Symbol) else None, self.item()))
            flags = self.int()
            code, has_attr, has_tag = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
            if code != LIST or has_attr:  # a list without attributes goes on in this loop, however long it is
                rest = self.item(flags)
                if isinstance(rest, Pairs):
                    out.items += rest.items
                elif rest is not None:
                    out.items.append((None, rest))
                return out

    def altrep(self) -> Vector:
        info, state, attrs = self.item(), self.item(), self.item()
        name = info.items[0][1].name
        parts = [v for _, v in state.items] if isinstance(state, Pairs) else list(state.values) if isinstance(state, Vector) and state.kind == "list" else state
        if name in ("compact_intseq", "compact_realseq"):
            n, first, step = (float(x) for x in state.values)
            values = first + step * np.arange(int(n))
            out = Vector("integer", values.astype(np.int32)) if name == "compact_intseq" else Vector("double", values)
        elif name.startswith("wrap_"):
            out = Vector(parts[0].kind, parts[0].values, dict(parts[0].attrs))
        elif name == "deferred_string":
            of = parts[0]
            text = lambda v: None if (of.kind == "integer" and v == NA_INT) or v != v else f"{v:.15g}" if of.kind == "double" else str(v)
            out = Vector("character", [text(v) for v in getattr(of.values, "tolist", lambda: of.values)()], dict(of.attrs))
        else:
            raise ValueError(f"compact objects of class {name} are not read")
        if attrs is not None:
            out.attrs = dict(attrs.items)
        return out


#: Values from which a vector of a stream goes to ``keep``; bytes of the stream that are held at a time.
LONG, WINDOW = 1 << 12, 1 << 22
_HEAD = struct.Struct(">ii")


class _Stream(_Reader):
    """A reader that holds a window of the stream only. Long vectors of numbers and strings are given, block by block, to ``keep``, which returns what stands for their values."""

    def __init__(self, f: Any, keep: Any):
        self.f, self.put, self.data, self.at, self.refs = f, keep, b"", 0, []

    def fill(self, n: int) -> None:
        if len(self.data) - self.at >= n:
            return
        parts, have = [self.data[self.at :]], len(self.data) - self.at
        while have < n:
            more = self.f.read(max(WINDOW, n - have))
            if not more:
                raise EOFError("the stream ends within an object")
            parts.append(more)
            have += len(more)
        self.data, self.at = b"".join(parts), 0

    def take(self, n: int) -> memoryview:
        self.fill(n)
        self.at += n
        return memoryview(self.data)[self.at - n : self.at]

    def values(self, kind: str, n: int) -> Any:
        if n >= LONG and kind in DTYPES:
            size = n * np.dtype(DTYPES[kind]).itemsize
            return self.put.numbers((self.take(min(WINDOW, size - at)) for at in range(0, size, WINDOW)), kind, n)
        if n >= LONG and kind == "character":
            return self.put.strings(self.strings(n), n)
        return super().values(kind, n)

    def strings(self, n: int) -> Iterator[tuple[bytes, list[int]]]:
        """Text of n strings in UTF-8, and the size of each (-1: NA), block by block. Runs of strings of one size are taken at once."""
        data, sizes, held, width = [], [], 0, 64
        head = _HEAD.size
        while n > 0:
            self.fill(head)
            flags, size = _HEAD.unpack_from(self.data, self.at)
            if flags & 0x2FF != CHAR or flags >> 12 & 4:  # with attributes, or in another encoding
                text = self.item()
                raw = b"" if text is None else text.encode("utf-8", "surrogateescape")
                data.append(raw)
                sizes.append(-1 if text is None else len(raw))
                held, n = held + len(raw), n - 1
            elif size < 0:
                self.at += head
                sizes.append(-1)
                n -= 1
            else:
                step = head + size
                self.fill(step)
                at, m = self.at, min(n, (len(self.data) - self.at) // step, width)
                last, k = at + (m - 1) * step, 1
                if m >= 16 and self.data[last : last + head] == self.data[at : at + head]:
                    rows = np.frombuffer(self.data, "u1", m * step, at).reshape(m, step)
                    same = (rows[:, :head] == rows[0, :head]).all(1)
                    k = m if same.all() else int(same.argmin())
                    data.append(rows[:k, head:].tobytes())
                else:
                    data.append(self.data[at + head : at + step])
                width = min(1 << 14, 2 * width) if k == m else 64
                sizes += [size] * k
                self.at, held, n = at + k * step, held + k * size, n - k
            if len(sizes) >= 1 << 16 or held >= WINDOW:
                yield b"".join(data), sizes
                data, sizes, held = [], [], 0
        yield b"".join(data), sizes


def load(f: Any, keep: Any) -> Any:
    """The object of an open file, compressed or not, of which only a window is held (``_Stream``)."""
    data = f.read(6)
    f.seek(0)
    if data[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    elif data[:3] == b"BZh":
        f = bz2.BZ2File(f)
    elif data == b"\xfd7zXZ\0":
        f = lzma.LZMAFile(f)
    r = _Stream(f, keep)
    r.header()
    return r.item()


def loads(data: bytes) -> Any:
    """The object of a serialized stream, compressed or not."""
    r = _Reader(unpack(data))
    r.header()
    return r.item()


class _Writer:
    def __init__(self, parts: dict[int, list[bytes | str]] | None = None) -> None:
        self.out, self.symbols, self.parts, self.done = io.BytesIO(), {}, parts or {}, []

    def begin(self) -> None:
        self.out.write(b"X\n")
        self.int(2), self.int(4 << 16 | 3 << 8), self.int(2 << 16 | 3 << 8)

    def int(self, n: int) -> None:
        self.out.write(struct.pack(">i", n))

    def symbol(self, name: str) -> None:
        if name in self.symbols:
            self.int(self.symbols[name] << 8 | REF)
            return
        self.symbols[name] = len(self.symbols) + 1
        self.int(SYM)
        self.char(name)

    def char(self, text: str | None) -> None:
        if text is None:
            self.int(CHAR)
            self.int(-1)
            return
        raw = text.encode("utf-8", "surrogateescape")
        self.int(CHAR | (64 if raw.isascii() else 8) << 12)
        self.int(len(raw))
        self.out.write(raw)

    def pairs(self, items: list[tuple[str | None, Any]], code: int = LIST) -> None:
        for k, (tag, value) in enumerate(items):
            self.int((code if k == 0 else LIST) | (0x400 if tag is not None else 0))
            if tag is not None:
                self.symbol(tag)
            self.item(value)
        self.int(NILVALUE)

    def item(self, x: Any) -> None:
        if x is None:
            self.int(NILVALUE)
        elif isinstance(x, Symbol):
            self.symbol(x.name)
        elif isinstance(x, Opaque):
            self.int(x.code)
        elif isinstance(x, Pairs):
            self.pairs(x.items, LANG if x.call else LIST)
        elif isinstance(x, S4):
            self.int(S4_ | 0x100 | 0x200 | 1 << 16)
            self.pairs(list(x.attrs.items()))
        elif isinstance(x, Vector):
            self.vector(x)
        else:
            raise TypeError(f"{type(x).__name__} has no form in R")

    def vector(self, x: Vector) -> None:
        self.int(CODES[x.kind] | (0x200 if x.attrs else 0) | (0x100 if "class" in x.attrs else 0))
        n = len(x.values)
        if n < 2**31:
            self.int(n)
        else:
            self.int(-1), self.int(n >> 32), self.out.write(struct.pack(">I", n & 0xFFFFFFFF))
        if id(x.values) in self.parts:
            self.done += [self.out.getvalue(), *self.parts[id(x.values)]]
            self.out = io.BytesIO()
        elif x.kind in DTYPES:
            self.out.write(np.asarray(x.values).astype(DTYPES[x.kind]).tobytes())
        elif x.kind == "raw":
            self.out.write(x.values)
        else:
            for v in x.values:
                self.char(v) if x.kind == "character" else self.item(v)
        if x.attrs:
            self.pairs(list(x.attrs.items()))


def encoded(values: Any, kind: str) -> bytes:
    """Members of a vector of numbers or strings."""
    if kind in DTYPES:
        return np.asarray(values).astype(DTYPES[kind]).tobytes()
    w = _Writer()
    for v in values:
        w.char(v)
    return w.out.getvalue()


def pieces(x: Any, parts: dict[int, list[bytes | str]]) -> Iterator[bytes | str]:
    """The stream of an object, where the members of some vectors are elsewhere: bytes, and what ``parts`` has by the id of a vector's values."""
    w = _Writer(parts)
    w.begin()
    w.item(x)
    for data in [*w.done, w.out.getvalue()]:
        if len(data):
            yield data


def dumps(x: Any, compress: bool = True) -> bytes:
    """Version 2 of the format, which every R since 2.3 reads."""
    w = _Writer()
    w.begin()
    w.item(x)
    return gzip.compress(w.out.getvalue(), 6, mtime=0) if compress else w.out.getvalue()
