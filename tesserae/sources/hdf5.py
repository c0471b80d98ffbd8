"""HDF5 files: a reader that touches only what is asked for, and a writer that appends.

Reading: superblocks 0 to 3, object headers 1 and 2, groups by symbol table or by link messages in the header, compact,
contiguous and chunked data (B-tree index, single chunk), filters deflate, shuffle, Fletcher-32, LZF and zstandard,
all numeric classes, fixed and variable strings, enumerations, compounds, arrays and object references. A range of rows
reads the chunks that it meets. Not read: groups and attributes in fractal heaps, other chunk indices of the newest format
(``NotImplementedError`` says so).

Writing: superblock 0, symbol tables, contiguous or chunked (deflated) data, variable strings in global heaps. Data is written as it is
appended; what stays in memory is a chunk of each open dataset and the places of chunks.
"""

from __future__ import annotations

import os
import shutil
import struct
import threading
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from itertools import islice

import numpy as np

#: Fixed values of the format: signature, the undefined address, message types, filters.
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", 2**64 - 1
SPACE, LINK_INFO, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, SYMBOLS = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER, LZF, ZSTD = 1, 2, 3, 32000, 32015
#: Symbols of a leaf and children of an inner node of a group's tree, and of a chunk tree, by half.
LEAF_K, GROUP_K, CHUNK_K = 32, 16, 32


def _u(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "little")


def _up(n: int) -> int:
    return (n + 7) & ~7


class Kind:
    """A datatype: a numpy dtype, or strings of variable length (``vlen`` is str) or lists of them."""

    def __init__(self, dtype: np.dtype, vlen: type | None = None, members: dict[str, int] | None = None, base: Kind | None = None, reference: bool = False, utf8: bool = True, fields: dict[str, Kind] | None = None):
        self.dtype, self.vlen, self.members, self.base, self.reference, self.utf8, self.fields = dtype, vlen, members, base, reference, utf8, fields

    @property
    def boolean(self) -> bool:
        return self.members is not None and set(self.members) == {"FALSE", "TRUE"}


def _kind(data: bytes, at: int = 0) -> tuple[Kind, int]:
    """The datatype at a place, and where it ends."""
    head, size = data[at], _u(data, at + 4, 4)
    version, kind, bits = head >> 4, head & 15, _u(data, at + 1, 3)
    order, at = ">" if bits & 1 else "<", at + 8
    if kind == 0:
        return Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")), at + 4
    if kind == 1:
        return Kind(np.dtype(f"{order}f{size}")), at + 12
    if kind == 3:
        return Kind(np.dtype(f"S{size}"), utf8=bool(bits >> 4 & 1)), at
    if kind == 4:
        return Kind(np.dtype(f"{order}u{size}")), at + 4
    if kind == 5:
        return Kind(np.dtype(f"V{size}")), at + _up(bits & 0xFF)
    if kind == 6:
        names, kinds, places = [], [], []
        for _ in range(bits & 0xFFFF):
            end = data.index(b"\0", at)
            name = data[at:end].decode()
            at = end + 1 if version >= 3 else at + _up(end + 1 - at)
            wide = 4 if version < 3 else max(1, (size.bit_length() + 7) // 8)
            places.append(_u(data, at, wide))
            at += wide
            shape: tuple = ()
            if version == 1:
                rank = data[at]
                shape = tuple(_u(data, at + 12 + 4 * i, 4) for i in range(rank))
                at += 28
            member, at = _kind(data, at)
            names.append(name)
            kinds.append(Kind(np.dtype((member.dtype, shape)), member.vlen, member.members, member.base) if shape else member)
        fields = dict(zip(names, kinds, strict=True))
        return Kind(np.dtype({"names": names, "formats": [k.dtype for k in kinds], "offsets": places, "itemsize": size}), fields=fields), at
    if kind == 7:
        return Kind(np.dtype("<u8") if size == 8 else np.dtype(f"V{size}"), reference=True), at
    if kind == 8:
        base, at = _kind(data, at)
        names = []
        for _ in range(bits & 0xFFFF):
            end = data.index(b"\0", at)
            names.append(data[at:end].decode())
            at = end + 1 if version >= 3 else at + _up(end + 1 - at)
        values = np.frombuffer(data, base.dtype, len(names), at)
        return Kind(base.dtype, members=dict(zip(names, values.tolist(), strict=True))), at + values.nbytes
    if kind == 9:
        base, at = _kind(data, at)
        return Kind(np.dtype([("n", "<u4"), ("at", "<u8"), ("i", "<u4")]), vlen=str if bits & 15 == 1 else list, base=base), at
    if kind == 10:
        rank = data[at]
        at += 4 if version < 3 else 1
        shape = tuple(_u(data, at + 4 * i, 4) for i in range(rank))
        at += rank * (8 if version < 3 else 4)
        base, at = _kind(data, at)
        return Kind(np.dtype((base.dtype, shape)), base.vlen, base.members, base.base), at
    raise NotImplementedError(f"datatype class {kind}")


def _shape(data: bytes) -> tuple[int, ...] | None:
    """Extents of a dataspace; None is the null dataspace."""
    rank = data[1]
    at = 8 if data[0] == 1 else 4
    if data[0] == 2 and data[3] == 2:
        return None
    return tuple(_u(data, at + 8 * i, 8) for i in range(rank))


class Node:
    """An object of a file: its header messages and attributes."""

    def __init__(self, file: File, at: int, name: str):
        self.file, self.at, self.name = file, at, name
        self.messages = list(file._messages(at))
        self._attrs: dict | None = None

    def message(self, kind: int) -> bytes | None:
        return next((d for k, d in self.messages if k == kind), None)

    @property
    def attrs(self) -> dict:
        if self._attrs is None:
            self._attrs = dict(self.file._attribute(d) for k, d in self.messages if k == ATTRIBUTE)
        return self._attrs


class Group(Node):
    """Members by name; ``g["a/b"]``, ``"a" in g``, ``g.keys()``."""

    def __init__(self, file: File, at: int, name: str):
        super().__init__(file, at, name)
        self._links = dict(file._links(self))

    def keys(self) -> list[str]:
        return list(self._links)

    def __contains__(self, path: str) -> bool:
        try:
            self[path]
        except KeyError:
            return False
        return True

    def __getitem__(self, path: str) -> Group | Dataset:
        first, _, rest = path.strip("/").partition("/")
        if first not in self._links:
            raise KeyError(f"{self.name}/{first}")
        node = self.file._object(self._links[first], f"{self.name}/{first}")
        return node[rest] if rest else node

    def get(self, path: str):
        return self[path] if path in self else None


class Dataset(Node):
    """An array. ``read(lo, hi)`` gives rows as numpy: strings as objects, booleans as bool."""

    def __init__(self, file: File, at: int, name: str):
        super().__init__(file, at, name)
        self.kind = file._type_of(self)
        self.shape = _shape(self.message(SPACE))
        self.filters = _filters(self.message(FILTERS))
        self.layout = self.message(LAYOUT)

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 0

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        return self.file._values(self.kind, self.raw(lo, hi))

    def scalar(self):
        return self.file._values(self.kind, self.raw().reshape(-1)[:1])[0]

    def raw(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Rows as they are stored."""
        shape, dtype, data = self.shape, self.kind.dtype, self.layout
        if shape is None:
            return np.zeros(0, dtype)
        if not shape:
            shape, lo, hi = (1,), 0, 1
        hi = shape[0] if hi is None else min(hi, shape[0])
        n = max(0, hi - lo)
        out_shape = (n, *shape[1:])
        row = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        version, kind = data[0], data[1]
        if version not in (3, 4):
            raise NotImplementedError(f"data layout {version}")
        if kind == 0:
            size = _u(data, 2, 2)
            return np.frombuffer(data[4 : 4 + size], dtype, int(np.prod(shape, dtype=np.int64))).reshape(shape)[lo:hi]
        if kind == 1:
            at = _u(data, 2, 8)
            raw = bytes(n * row) if at == UNDEFINED else self.file._read(at + lo * row, n * row)
            return np.frombuffer(raw, dtype, int(np.prod(out_shape, dtype=np.int64))).reshape(out_shape)
        out = np.zeros(out_shape, dtype)
        chunk, found = self._chunks(lo, hi)
        for start, stored in found:
            size = int(np.prod(chunk, dtype=np.int64))
            block = np.frombuffer(stored, dtype, size).reshape(chunk)
            # the part of the chunk that lies within the rows and the extent
            into, of = [], []
            for axis, (a, c) in enumerate(zip(start, chunk, strict=True)):
                low, high = (lo, hi) if axis == 0 else (0, shape[axis])
                b0, b1 = max(a, low), min(a + c, high)
                into.append(slice(b0 - low, b1 - low))
                of.append(slice(b0 - a, b1 - a))
            out[tuple(into)] = block[tuple(of)]
        return out

    @property
    def tiled(self) -> bool:
        """Whether the array is in chunks, of which some may not be stored."""
        return self.layout[1] == 2

    def nonzero(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, column and value of what isn't 0 in rows [lo, hi) of a matrix in chunks, some chunks at a time; a chunk that is not stored has nothing."""
        chunk, found = self._chunks(lo, hi)
        size, found = int(np.prod(chunk, dtype=np.int64)), iter(found)
        while own := list(islice(found, max(1, (1 << 19) // size))):
            starts = np.array([s for s, _ in own], np.int64)
            flat = np.frombuffer(b"".join([d[: size * self.kind.dtype.itemsize] for _, d in own]), self.kind.dtype)
            at = np.flatnonzero(flat != 0)
            of, place = np.divmod(at, size)
            row, column = starts[of, 0] + place // chunk[1], starts[of, 1] + place % chunk[1]
            keep = (row >= lo) & (row < min(hi, self.shape[0])) & (column < self.shape[1])  # chunks go on beyond the extent
            yield row[keep], column[keep], flat[at[keep]].astype(np.float64)

    def stored_values(self) -> int:
        """How many values the stored chunks have at most: those that their tree's leaves have room for, or all."""
        n = int(np.prod(self.shape, dtype=np.int64))
        if not self.tiled or self.layout[0] != 3:
            return n
        tree, rank = _u(self.layout, 3, 8), max(1, len(self.shape))
        chunk = int(np.prod([_u(self.layout, 11 + 4 * i, 4) for i in range(rank)], dtype=np.int64))
        return 0 if tree == UNDEFINED else min(n, chunk * self._room(tree, rank))

    def _room(self, at: int, rank: int) -> int:
        """Chunks of a subtree at most; leaves are not read."""
        head, key = self.file._read(at, 24), 8 + 8 * (rank + 1)
        level, used = head[5], _u(head, 6, 2)
        if level < 2:
            return used * (2 * CHUNK_K if level else 1)
        body = self.file._read(at + 24, used * (key + 8))
        return sum(self._room(_u(body, i * (key + 8) + key, 8), rank) for i in range(used))

    def _chunks(self, lo: int, hi: int) -> tuple[tuple[int, ...], Iterator[tuple[tuple[int, ...], bytes]]]:
        data, rank = self.layout, max(1, len(self.shape))
        if data[0] == 3:
            tree, chunk = _u(data, 3, 8), tuple(_u(data, 11 + 4 * i, 4) for i in range(rank))
            return chunk, (() if tree == UNDEFINED else self._in_tree(tree, rank, chunk[0], lo, hi))
        wide = data[4]
        chunk = tuple(_u(data, 5 + wide * i, wide) for i in range(rank))
        at = 5 + wide * (rank + 1)
        if data[at] != 1:
            raise NotImplementedError(f"chunk index {data[at]} of the newest file format")
        size, mask = int(np.prod(chunk, dtype=np.int64)) * self.kind.dtype.itemsize, 0
        at += 1
        if data[2] & 2:
            size, mask, at = _u(data, at, 8), _u(data, at + 8, 4), at + 12
        where = _u(data, at, 8)
        return chunk, iter([] if where == UNDEFINED else [((0,) * rank, _unfiltered(self.file._read(where, size), self.filters, mask, self.kind.dtype.itemsize))])

    def _in_tree(self, at: int, rank: int, rows: int, lo: int, hi: int) -> Iterator[tuple[tuple[int, ...], bytes]]:
        """Chunks that meet the rows; subtrees that don't are not read."""
        head = self.file._read(at, 24)
        if head[:4] != b"TREE":
            raise ValueError(f"no chunk tree at {at}")
        level, used, key = head[5], _u(head, 6, 2), 8 + 8 * (rank + 1)
        body = self.file._read(at + 24, used * (key + 8) + key)
        child = np.frombuffer(body, [("size", "<u4"), ("mask", "<u4"), ("start", "<u8", (rank + 1,)), ("at", "<u8")], used)
        first = child["start"][:, 0].astype(np.int64)
        if level:
            after = np.append(first[1:], hi)  # first row of the next key
            for i in np.flatnonzero((first < hi) & ((after + rows > lo) | (np.arange(used) == used - 1))).tolist():
                yield from self._in_tree(int(child["at"][i]), rank, rows, lo, hi)
            return
        child = child[(first < hi) & (first + rows > lo)]
        if not len(child):
            return
        places, sizes = child["at"].tolist(), child["size"].tolist()
        begin, end = min(places), max(a + n for a, n in zip(places, sizes, strict=True))
        near = self.file._read(begin, end - begin) if end - begin <= 2 * sum(sizes) <= 1 << 22 else None  # small chunks beside each other are read at once
        for start, place, size, mask in zip(child["start"][:, :rank].tolist(), places, sizes, child["mask"].tolist(), strict=True):
            data = near[place - begin : place - begin + size] if near is not None else self.file._read(place, size)
            yield tuple(start), _unfiltered(data, self.filters, mask, self.kind.dtype.itemsize)


def _filters(data: bytes | None) -> list[tuple[int, list[int]]]:
    out: list[tuple[int, list[int]]] = []
    if data is None:
        return out
    at = 8 if data[0] == 1 else 2
    for _ in range(data[1]):
        number = _u(data, at, 2)
        named = data[0] == 1 or number >= 256
        name = _u(data, at + 2, 2) if named else 0
        at += 4 if named else 2
        n = _u(data, at + 2, 2)
        at += 4 + (_up(name) if data[0] == 1 else name)
        out.append((number, [_u(data, at + 4 * i, 4) for i in range(n)]))
        at += 4 * n + (4 if data[0] == 1 and n % 2 else 0)
    return out


def _unfiltered(data: bytes, filters: list[tuple[int, list[int]]], mask: int, item: int) -> bytes:
    for i in reversed(range(len(filters))):
        if mask >> i & 1:
            continue
        number, values = filters[i]
        if number == DEFLATE:
            data = zlib.decompress(data)
        elif number == SHUFFLE:
            size = values[0] if values else item
            n = len(data) // size
            data = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]
        elif number == FLETCHER:
            data = data[:-4]
        elif number == LZF:
            data = _lzf(data, values[2]) if len(values) > 2 else _lzf(data, 0)
        elif number == ZSTD:
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        else:
            raise NotImplementedError(f"filter {number}")
    return data


def _lzf(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if c < 32:
            out += data[at : at + c + 1]
            at += c + 1
            continue
        n = c >> 5
        if n == 7:
            n, at = n + data[at], at + 1
        back = ((c & 31) << 8) + data[at] + 1
        at += 1
        for _ in range(n + 2):
            out.append(out[-back])
    if size and len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} were expected")
    return bytes(out)


def opener(path: str):
    """An open file to read from, by any store that pyarrow or the operating system knows."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")  # noqa: SIM115
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class File:
    """An HDF5 file to read. ``file["group/dataset"]``."""

    def __init__(self, path: str):
        self.path, self._f = path, opener(path)
        self._heap = lru_cache(maxsize=64)(self._collection)
        for at in (0, 512, 1024, 2048):
            if self._read(at, 8, whole=False) == SIGNATURE:
                break
        else:
            raise ValueError(f"{path} is no HDF5 file")
        head = self._read(at, 96, whole=False)
        self.base, self.version = at, head[8]
        if self.version < 2:
            if head[13] != 8 or head[14] != 8:
                raise NotImplementedError("offsets or lengths that are not of 8 bytes")
            root = _u(head, 64 + (4 if self.version else 0), 8)
        else:
            if head[9] != 8 or head[10] != 8:
                raise NotImplementedError("offsets or lengths that are not of 8 bytes")
            root = _u(head, 36, 8)
        self.root = Group(self, root, "")

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self._f.close()

    def __getitem__(self, path: str):
        return self.root[path] if path.strip("/") else self.root

    def __contains__(self, path: str) -> bool:
        return path in self.root

    def get(self, path: str):
        return self.root.get(path)

    def _read(self, at: int, n: int, whole: bool = True) -> bytes:
        self._f.seek(at + (self.base if whole else 0))
        data = self._f.read(n)
        if whole and len(data) < n:
            raise ValueError(f"{self.path} ends at {at + len(data)}, before {at + n}")
        return data

    def _object(self, at: int, name: str) -> Group | Dataset:
        kinds = {k for k, _ in self._messages(at)}
        return Dataset(self, at, name) if LAYOUT in kinds else Group(self, at, name)

    def at(self, address: int) -> Group | Dataset:
        """The object that a reference points to."""
        return self._object(address, f"@{address}")

    def _messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        head = self._read(at, 16)
        if head[:4] == b"OHDR":
            flags, place = head[5], at + 6 + (16 if head[5] & 0x20 else 0) + (4 if head[5] & 0x10 else 0)
            wide = 1 << (flags & 3)
            blocks = [(place + wide, _u(self._read(place, wide), 0, wide))]
            step, newer = 4 + (2 if flags & 4 else 0), True
        elif head[0] == 1:
            blocks, step, newer, flags = [(at + 16, _u(head, 8, 4))], 8, False, 0
        else:
            raise ValueError(f"no object header at {at}")
        while blocks:
            start, size = blocks.pop(0)
            data, i = self._read(start, size), 0
            while i + step <= size:
                kind, n, shared = (data[i], _u(data, i + 1, 2), data[i + 3] & 2) if newer else (_u(data, i, 2), _u(data, i + 2, 2), data[i + 4] & 2)
                body = data[i + step : i + step + n]
                i += step + n
                if kind == MORE:
                    where, length = _u(body, 0, 8), _u(body, 8, 8)
                    blocks.append((where + 4, length - 8) if newer else (where, length))
                elif shared and kind == TYPE:
                    yield kind, next(d for k, d in self._messages(_u(body, 8 if body[0] == 1 else 2, 8)) if k == TYPE)
                elif kind:
                    yield kind, body

    def _links(self, group: Group) -> Iterator[tuple[str, int]]:
        for kind, data in group.messages:
            if kind == SYMBOLS:
                yield from self._symbols(_u(data, 0, 8), self._names(_u(data, 8, 8)))
            elif kind == LINK_INFO:
                at = 2 + (8 if data[1] & 1 else 0)
                if _u(data, at, 8) != UNDEFINED:
                    raise NotImplementedError(f"{group.name or '/'}: a group in a fractal heap")
            elif kind == LINK:
                flags, at = data[1], 2
                link = data[at] if flags & 8 else 0
                at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                wide = 1 << (flags & 3)
                n = _u(data, at, wide)
                at += wide
                if link == 0:  # hard; soft and external links are left out
                    yield data[at : at + n].decode(), _u(data, at + n, 8)

    def _names(self, at: int) -> bytes:
        head = self._read(at, 32)
        return self._read(_u(head, 24, 8), _u(head, 8, 8))

    def _symbols(self, at: int, names: bytes) -> Iterator[tuple[str, int]]:
        head = self._read(at, 24)
        if head[:4] == b"SNOD":
            body = self._read(at + 8, 40 * _u(head, 6, 2))
            for i in range(0, len(body), 40):
                start = _u(body, i, 8)
                if _u(body, i + 16, 4) != 2:  # 2: a soft link
                    yield names[start : names.index(b"\0", start)].decode(), _u(body, i + 8, 8)
            return
        used = _u(head, 6, 2)
        body = self._read(at + 24, 16 * used + 8)
        for i in range(used):
            yield from self._symbols(_u(body, 16 * i + 8, 8), names)

    def _type_of(self, node: Node) -> Kind:
        return _kind(node.message(TYPE))[0]

    def _attribute(self, data: bytes):
        version, name, kind, space = data[0], _u(data, 2, 2), _u(data, 4, 2), _u(data, 6, 2)
        pad = _up if version == 1 else int
        at = 9 if version == 3 else 8
        label = data[at : at + name].split(b"\0")[0].decode()
        at += pad(name)
        if version > 1 and data[1] & 1:
            body = data[at : at + kind]
            of = _kind(next(d for k, d in self._messages(_u(body, 8 if body[0] == 1 else 2, 8)) if k == TYPE))[0]
        else:
            of, _ = _kind(data, at)
        at += pad(kind)
        shape = _shape(data[at : at + space])
        at += pad(space)
        if shape is None:
            return label, None
        values = self._values(of, np.frombuffer(data, of.dtype, int(np.prod(shape, dtype=np.int64)), at))
        return label, values.reshape(shape) if shape else values[0]

    def _collection(self, at: int) -> dict[int, bytes]:
        head = self._read(at, 16)
        if head[:4] != b"GCOL":
            raise ValueError(f"no heap at {at}")
        data, out, i = self._read(at, _u(head, 8, 8)), {}, 16
        while i + 16 <= len(data):
            number, size = _u(data, i, 2), _u(data, i + 8, 8)
            if not number:
                break
            out[number] = data[i + 16 : i + 16 + size]
            i += 16 + _up(size)
        return out

    def _values(self, kind: Kind, raw: np.ndarray) -> np.ndarray:
        if kind.vlen:
            flat = raw.reshape(-1)
            out = np.empty(len(flat), object)
            for i, (n, at, number) in enumerate(flat.tolist()):
                data = self._heap(at).get(number, b"") if n and at not in (0, UNDEFINED) else b""
                out[i] = data[:n].decode(errors="replace") if kind.vlen is str else np.frombuffer(data, kind.base.dtype, n)
            return out.reshape(raw.shape)
        if kind.fields:
            return raw
        if kind.dtype.kind == "S":
            return np.array([x.decode(errors="replace") for x in raw.reshape(-1).tolist()], object).reshape(raw.shape)
        if kind.boolean:
            return raw.astype(bool)
        return raw

    def field(self, kind: Kind, raw: np.ndarray, name: str) -> np.ndarray:
        """A field of compound rows."""
        return self._values(kind.fields[name], np.ascontiguousarray(raw[name]))


def _number_type(dtype: np.dtype) -> bytes:
    size = dtype.itemsize
    if dtype.kind in "iu":
        return bytes([0x10, 8 if dtype.kind == "i" else 0, 0, 0]) + struct.pack("<IHH", size, 0, 8 * size)
    if dtype.kind == "f":
        exponent, mantissa, bias = {2: (5, 10, 15), 4: (8, 23, 127), 8: (11, 52, 1023)}[size]
        return bytes([0x11, 0x20, 8 * size - 1, 0]) + struct.pack("<IHHBBBBI", size, 0, 8 * size, mantissa, exponent, 0, mantissa, bias)
    raise TypeError(f"no HDF5 type for {dtype}")


def _named(name: str) -> bytes:
    data = name.encode() + b"\0"
    return data + bytes(_up(len(data)) - len(data))


TEXT = bytes([0x19, 0x01, 0x01, 0]) + struct.pack("<I", 16) + _number_type(np.dtype("u1"))
BOOLEAN = bytes([0x18, 2, 0, 0]) + struct.pack("<I", 1) + _number_type(np.dtype("i1")) + _named("FALSE") + _named("TRUE") + bytes([0, 1])
REFERENCE = bytes([0x17, 0, 0, 0]) + struct.pack("<I", 8)


def _space(shape: tuple[int, ...], most: tuple[int, ...] | None = None) -> bytes:
    return struct.pack("<BBBBI", 1, len(shape), 1 if most else 0, 0, 0) + b"".join(struct.pack("<Q", n) for n in (*shape, *(most or ())))


def _message(kind: int, data: bytes) -> bytes:
    data += bytes(_up(len(data)) - len(data))
    if len(data) > 0xFFFF:
        raise ValueError("a header message of more than 64 KB")
    return struct.pack("<HHBBBB", kind, len(data), 0, 0, 0, 0) + data


def heap_of(strings: list[bytes], put: Callable[[bytes], int]) -> np.ndarray:
    """References to strings that ``put`` appends as global heaps; it returns their places."""
    out = np.zeros(len(strings), [("n", "<u4"), ("at", "<u8"), ("i", "<u4")])
    out["n"] = [len(s) for s in strings]
    i = 0
    while i < len(strings):
        body, number, own = bytearray(), 0, []
        while i < len(strings) and number < 60_000 and (not body or len(body) + len(strings[i]) < 1 << 20):
            if strings[i]:
                number += 1
                body += struct.pack("<HHIQ", number, 1, 0, len(strings[i])) + strings[i] + bytes(_up(len(strings[i])) - len(strings[i]))
                own.append((i, number))
            i += 1
        if not own:
            continue
        size = max(4096, len(body) + 32)
        free = size - 16 - len(body)
        at = put(b"GCOL" + struct.pack("<BBBBQ", 1, 0, 0, 0, size) + bytes(body) + struct.pack("<HHIQ", 0, 0, 0, free) + bytes(free - 16))
        for k, number in own:
            out["at"][k], out["i"][k] = at, number
    return out


def _alone(f: Callable) -> Callable:
    """A writer's method that one thread at a time is in."""

    @wraps(f)
    def own(self, *args, **kwargs):
        with self._lock:
            return f(self, *args, **kwargs)

    return own


class Writer:
    """An HDF5 file to write. Groups, arrays and attributes by path; ``appender`` for arrays that come in parts. Threads may put whole arrays at the same time."""

    def __init__(self, path: str):
        if "://" in path and not path.startswith("file:"):
            raise ValueError(f"{path}: HDF5 files are written to a folder that the driver can open")
        self.path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        self._f = open(self.path, "wb")  # noqa: SIM115
        self.folders: list[str] = []
        self._lock = threading.RLock()
        self._end = 96
        self._f.write(bytes(96))
        self._groups: dict[str, dict[str, int]] = {"": {}}
        self._attrs: dict[str, dict] = {"": {}}
        self._pending: list[tuple[bytes, int]] = []  # strings for the heap that is open, and its address
        self._strings, self._held = [], 0

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.close()
            else:
                self._f.close()
        finally:
            for folder in self.folders:
                shutil.rmtree(folder, ignore_errors=True)

    def _put(self, data: bytes) -> int:
        """Append, aligned; returns the place."""
        at = self._end
        self._f.seek(at)
        self._f.write(data + bytes(_up(len(data)) - len(data)))
        self._end += _up(len(data))
        return at

    def _heap(self, strings: list[bytes]) -> np.ndarray:
        """Put strings into global heaps; returns their references."""
        return heap_of(strings, self._put)

    @_alone
    def put_file(self, path: str) -> int:
        """Append a file's bytes, aligned, and remove it; returns the place."""
        at = self._end
        self._f.seek(at)
        with open(path, "rb") as f:
            shutil.copyfileobj(f, self._f, 1 << 22)
            size = f.tell()
        self._f.write(bytes(_up(size) - size))
        self._end += _up(size)
        os.unlink(path)
        return at

    def _encoded(self, values: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Datatype and stored form."""
        if values.dtype.kind in "OUS":
            data = [b"" if x is None else x if isinstance(x, bytes) else str(x).encode() for x in values.reshape(-1).tolist()]
            return TEXT, self._heap(data).reshape(values.shape)
        if values.dtype.kind == "b":
            return BOOLEAN, values.astype("i1")
        values = values.astype(values.dtype.newbyteorder("<"))
        return _number_type(values.dtype), values

    @_alone
    def group(self, path: str, **attrs) -> str:
        path = path.strip("/")
        if path not in self._groups:
            parent, _, name = path.rpartition("/")
            self.group(parent)
            self._groups[path], self._attrs[path] = {}, {}
            self._groups[parent][name] = -1  # known at the end
        self._attrs[path].update(attrs)
        return path

    def _attribute(self, name: str, value) -> bytes:
        if isinstance(value, Reference):
            kind, data, shape = REFERENCE, struct.pack("<Q", value.at), ()
        else:
            array = np.asarray(value) if not isinstance(value, str) else np.array(value, object)
            kind, stored = self._encoded(array.reshape(-1))
            data, shape = stored.tobytes(), array.shape
        label, space = name.encode() + b"\0", _space(shape)
        parts = [label, kind, space]
        head = struct.pack("<BBHHH", 1, 0, *map(len, parts))
        return _message(ATTRIBUTE, head + b"".join(p + bytes(_up(len(p)) - len(p)) for p in parts) + data)

    def _header(self, messages: list[bytes], attrs: dict) -> int:
        body = b"".join([*messages, *(self._attribute(k, v) for k, v in attrs.items())])
        return self._put(struct.pack("<BBHII", 1, 0, len(messages) + len(attrs), 1, len(body)) + bytes(4) + body)

    def _link(self, path: str, at: int) -> None:
        parent, _, name = path.strip("/").rpartition("/")
        self.group(parent)
        self._groups[parent][name] = at

    @_alone
    def array(self, path: str, values, **attrs) -> Reference:
        """A whole array, contiguous."""
        values = np.asarray(values, object) if isinstance(values, (list, tuple)) and values and isinstance(values[0], (str, type(None))) else np.asarray(values)
        kind, stored = self._encoded(values)
        data = stored.tobytes()
        at = self._put(data) if data else UNDEFINED
        return self._finish(path, kind, values.shape, struct.pack("<BBQQ", 3, 1, at, len(data)), None, attrs)

    @_alone
    def text(self, path: str, value: str, **attrs) -> Reference:
        kind, stored = self._encoded(np.array([value], object))
        return self._finish(path, kind, (), struct.pack("<BBQQ", 3, 1, self._put(stored.tobytes()), 16), None, attrs)

    def _finish(self, path: str, kind: bytes, shape: tuple, layout: bytes, filters: bytes | None, attrs: dict, most: tuple | None = None) -> Reference:
        fill = struct.pack("<BBBBI", 2, 3 if filters or most else 2, 2, 1, 0)
        messages = [_message(SPACE, _space(shape, most)), _message(TYPE, kind), _message(FILL, fill), _message(LAYOUT, layout)]
        if filters:
            messages.append(_message(FILTERS, filters))
        at = self._header(messages, attrs)
        self._link(path, at)
        return Reference(at)

    def rows(self, columns: dict[str, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Datatype and stored form of rows with fields."""
        made = {k: self._encoded(np.asarray(v, object) if np.asarray(v).dtype.kind in "OU" else np.asarray(v)) for k, v in columns.items()}
        places, size = {}, 0
        for k, (_, v) in made.items():
            places[k] = size
            size += v.dtype.itemsize * int(np.prod(v.shape[1:], dtype=np.int64))
        kind = bytes([0x16]) + struct.pack("<HB", len(made), 0) + struct.pack("<I", size)
        for k, (t, v) in made.items():
            dims = [*v.shape[1:], 0, 0, 0, 0][:4]
            kind += _named(k) + struct.pack("<IB3xI4x4I", places[k], v.ndim - 1, 0, *dims) + t
        n = len(next(iter(made.values()))[1])
        out = np.zeros((n, size), np.uint8)
        for k, (_, v) in made.items():
            raw = np.ascontiguousarray(v).view(np.uint8).reshape(n, -1)
            out[:, places[k] : places[k] + raw.shape[1]] = raw
        return kind, out.reshape(-1).view(f"V{size}")

    @_alone
    def compound(self, path: str, columns: dict[str, np.ndarray], **attrs) -> Reference:
        """Rows with fields, as old files keep tables."""
        kind, rows = self.rows(columns)
        layout = struct.pack("<BBQQ", 3, 1, self._put(rows.tobytes()) if len(rows) else UNDEFINED, rows.nbytes)
        return self._finish(path, kind, (len(rows),), layout, None, attrs)

    def appender(self, path: str, dtype, row: tuple[int, ...] = (), chunk: int | None = None, level: int = 4) -> Appender:
        return Appender(self, path, np.dtype(dtype), row, chunk or max(1, (1 << 18) // max(1, int(np.prod(row, dtype=np.int64)) * 8)), level)

    def _chunk_tree(self, entries: list[tuple[tuple[int, ...], int, int]], rank: int, item: int) -> int:
        """entries: first place, address and size of each chunk, in order."""
        if not entries:
            return UNDEFINED
        key = 8 + 8 * (rank + 1)
        room = 24 + (2 * CHUNK_K + 1) * key + 2 * CHUNK_K * 8
        as_key = lambda start, size: struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", s) for s in (*start, 0))
        level, nodes = 0, entries
        while True:
            above, groups = [], [nodes[i : i + 2 * CHUNK_K] for i in range(0, len(nodes), 2 * CHUNK_K)]
            base = self._end
            for g, own in enumerate(groups):
                left = base + (g - 1) * _up(room) if g else UNDEFINED
                right = base + (g + 1) * _up(room) if g + 1 < len(groups) else UNDEFINED
                body = b"".join(as_key(start, size) + struct.pack("<Q", at) for start, at, size in own)
                last = groups[g + 1][0] if g + 1 < len(groups) else (tuple(x + 1 for x in own[-1][0]), 0, 0)
                data = b"TREE" + struct.pack("<BBHQQ", 1, level, len(own), left, right) + body + as_key(last[0], last[2])
                above.append((own[0][0], self._put(data + bytes(room - len(data))), own[0][2]))
            if len(above) == 1:
                return above[0][1]
            level, nodes = level + 1, above

    @_alone
    def chunked(self, path: str, kind: bytes, item: int, n: int, row: tuple[int, ...], chunk: int, level: int, entries: list, attrs: dict) -> Reference:
        """An array of n rows whose deflated chunks are in the file: first place, address and size of each."""
        rank = 1 + len(row)
        tree = self._chunk_tree(entries, rank, item)
        layout = struct.pack("<BBBQ", 3, 2, rank + 1, tree) + b"".join(struct.pack("<I", c) for c in (chunk, *row, item))
        filters = struct.pack("<BB6xHHHH", 1, 1, DEFLATE, 0, 1, 1) + struct.pack("<II", level, 0)
        return self._finish(path, kind, (n, *row), layout, filters, attrs, (UNDEFINED, *row))

    def _tree_nodes(self, level: int, starts: np.ndarray, at: np.ndarray, sizes: np.ndarray, tile: tuple[int, ...], base: int, before: int, total: int, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of one level of a chunk tree, of which ``before`` are there and ``total`` will be, from ``base`` on; gives their first places, addresses and sizes."""
        room, rank = 2 * CHUNK_K, starts.shape[1]
        key = np.dtype([("size", "<u4"), ("mask", "<u4"), ("start", "<u8", (rank + 1,))])
        node = np.dtype([("name", "S4"), ("kind", "u1"), ("level", "u1"), ("used", "<u2"), ("left", "<u8"), ("right", "<u8"), ("child", [("key", key), ("at", "<u8")], (room,)), ("last", key)])
        n, heads = len(at), np.arange(0, len(at), room)
        out = np.zeros(len(heads), node)
        place = base + (before + np.arange(len(heads), dtype=np.int64)) * node.itemsize
        out["name"], out["kind"], out["level"], out["used"] = b"TREE", 1, level, np.minimum(room, n - heads)
        out["left"], out["right"] = place.astype("<u8") - node.itemsize, place.astype("<u8") + node.itemsize
        if not before:
            out["left"][0] = UNDEFINED
        if before + len(heads) == total:
            out["right"][-1] = UNDEFINED
        child = np.zeros(len(heads) * room, out["child"].dtype)
        child["key"]["size"][:n], child["key"]["start"][:n, :rank], child["at"][:n] = sizes, starts, at
        out["child"] = child.reshape(len(heads), room)
        out["last"]["start"][:-1, :rank], out["last"]["size"][:-1] = starts[heads[1:]], sizes[heads[1:]]
        end = starts[-1] + np.asarray(tile) if after is None else after
        used = int(out["used"][-1])
        last = out["last"] if used == room else out["child"]["key"][:, used]
        last["start"][-1, :rank] = end
        assert self._put(out.tobytes()) == place[0]
        return starts[heads], place, sizes[heads]

    @_alone
    def tiled(self, path: str, kind: bytes, item: int, shape: tuple[int, int], tile: tuple[int, int], level: int, found: list[tuple[str, int]], attrs: dict) -> Reference:
        """A matrix whose deflated tiles are in the file; those that have only 0 need not be there.

        found: a file of rows (first row, first column, place, size) in order, and the address that places count from. It is read piece by
        piece; of the tree, the nodes above the leaves stay in memory.
        """
        read = lambda path: np.fromfile(path, "<i8").reshape(-1, 4)
        sizes = [os.path.getsize(p) // 32 for p, _ in found]
        tree, total, before, base, made = UNDEFINED, sum(-(-n // (2 * CHUNK_K)) for n in sizes), 0, self._end, []
        for k, (p, at) in enumerate(found):
            own = read(p)
            after = np.fromfile(found[k + 1][0], "<i8", 2) if k + 1 < len(found) else None
            made.append(self._tree_nodes(0, own[:, :2], own[:, 2] + at, own[:, 3], tile, base, before, total, after))
            before += len(made[-1][1])
        nodes = [np.concatenate(x) for x in zip(*made, strict=True)] if made else None
        height = 0
        while nodes and len(nodes[1]) > 1:
            height += 1
            nodes = list(self._tree_nodes(height, *nodes, tile, self._end, 0, -(-len(nodes[1]) // (2 * CHUNK_K)), None))
        if nodes:
            tree = int(nodes[1][0])
        layout = struct.pack("<BBBQ", 3, 2, 3, tree) + b"".join(struct.pack("<I", c) for c in (*tile, item))
        filters = struct.pack("<BB6xHHHH", 1, 1, DEFLATE, 0, 1, 1) + struct.pack("<II", level, 0)
        return self._finish(path, kind, shape, layout, filters, attrs, (UNDEFINED, UNDEFINED))

    def _symbol_table(self, links: dict[str, int]) -> tuple[int, int]:
        names = sorted(links, key=str.encode)
        heap, places = bytearray(8), {}
        for n in names:
            places[n] = len(heap)
            heap += _named(n)
        segment = self._put(bytes(heap))
        heap_at = self._put(b"HEAP" + struct.pack("<BBBBQQQ", 0, 0, 0, 0, len(heap), 1, segment))
        leaves = [names[i : i + 2 * LEAF_K] for i in range(0, len(names), 2 * LEAF_K)] or [[]]
        if len(leaves) > 2 * GROUP_K:
            raise ValueError(f"a group of more than {4 * LEAF_K * GROUP_K} members")
        body = struct.pack("<Q", 0)
        for own in leaves:
            data = b"SNOD" + struct.pack("<BBH", 1, 0, len(own)) + b"".join(struct.pack("<QQII16x", places[n], links[n], 0, 0) for n in own)
            at = self._put(data + bytes(8 + 80 * LEAF_K - len(data)))
            body += struct.pack("<QQ", at, places[own[-1]] if own else 0)
        node = b"TREE" + struct.pack("<BBHQQ", 0, 0, len(leaves) if names else 0, UNDEFINED, UNDEFINED) + body
        return self._put(node + bytes(24 + (2 * GROUP_K + 1) * 8 + 2 * GROUP_K * 8 - len(node))), heap_at

    def close(self) -> None:
        root = (0, 0, 0)
        for path in sorted(self._groups, key=lambda p: -p.count("/") if p else 1):  # members before their groups
            tree, heap = self._symbol_table(self._groups[path])
            at = self._header([_message(SYMBOLS, struct.pack("<QQ", tree, heap))], self._attrs[path])
            if path:
                self._link(path, at)
            else:
                root = (at, tree, heap)
        self._f.seek(0)
        head = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", LEAF_K, GROUP_K, 0) + struct.pack("<QQQQ", 0, UNDEFINED, self._end, UNDEFINED)
        self._f.write(head + struct.pack("<QQIIQQ", 0, root[0], 1, 0, root[1], root[2]))
        self._f.truncate(self._end)
        self._f.close()


class Reference:
    """The place of an object, as an attribute's value."""

    def __init__(self, at: int):
        self.at = at


class Appender:
    """An array that grows by rows; whole chunks are deflated and written at once."""

    def __init__(self, writer: Writer, path: str, dtype: np.dtype, row: tuple[int, ...], chunk: int, level: int):
        self.writer, self.path, self.dtype, self.row, self.chunk, self.level = writer, path, dtype, row, chunk, level
        self.n, self.entries, self._kept = 0, [], np.zeros((0, *row), dtype)

    def append_fields(self, columns: dict[str, np.ndarray]) -> None:
        """Rows with fields."""
        self.kind, rows = self.writer.rows(columns)
        if self.dtype != rows.dtype:
            self.dtype, self._kept = rows.dtype, np.zeros(0, rows.dtype)
        self.append(rows)

    def append(self, rows: np.ndarray) -> None:
        rows = np.asarray(rows, self.dtype).reshape(-1, *self.row)
        self.n += len(rows)
        self._kept = np.concatenate([self._kept, rows]) if len(self._kept) else rows
        while len(self._kept) >= self.chunk:
            self._write(self._kept[: self.chunk])
            self._kept = self._kept[self.chunk :]
        self._kept = self._kept.copy()

    def _write(self, rows: np.ndarray) -> None:
        if rows.dtype.kind == "V":
            stored = rows
        else:
            self.kind, stored = self.writer._encoded(rows)
        self.item = stored.dtype.itemsize
        data = zlib.compress(np.ascontiguousarray(stored).tobytes(), self.level)
        start = len(self.entries) * self.chunk
        self.entries.append(((start, *(0 for _ in self.row)), self.writer._put(data), len(data)))

    def close(self, **attrs) -> Reference:
        n = len(self._kept)
        if n:
            full = np.zeros((self.chunk, *self.row), self.dtype)
            if self.dtype.kind == "O":
                full[...] = None
            full[:n] = self._kept
            self._write(full)
        if not self.entries:
            return self.writer.array(self.path, np.zeros((0, *self.row), self.dtype), **attrs)
        return self.writer.chunked(self.path, self.kind, self.item, self.n, self.row, self.chunk, self.level, self.entries, attrs)
