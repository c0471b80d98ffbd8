"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

1. Each task reads texts in windows of bounded size, hashes line keys (128 bits) and counts them
   within the window. A key that reaches ``min_docs`` documents inside one window is decided there:
   its lines are marked on the spot, and the key itself is passed on once, as known to be hot, by its task. Any other key
   passes on one record per line. So a hot key has one record a task and fewer than ``min_docs`` documents' for each
   window in which it isn't hot.
2. Records are dealt by equal ranges of the hash (hashes are uniform, so no sampling pass is needed)
   and sorted by hash, document and position. A stream over each range emits the positions that go:
   all of a key in ``min_docs`` documents or more, or (``keep_first``) all but the first. It holds the
   records of one undecided key at most.
3. Positions are gathered per document into a compressed keep bitmap. Text is never shuffled for that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import FILE, ROW, anchored, arrow_map, located, partitions

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: The position of a record that tells of a hot key, and its file and row, which sort before all others; hot keys that a task remembers having told of.
HOT, FIRST, KNOWN = -1, -(2**63), 100_000
RECORD = "range int, h1 long, h2 long, _file long, _row long, n_lines long, gone binary, pos int"
GONE = "_file long, _row long, n_lines long, gone binary, pos int"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lowered."""
    return [line.strip(BLANKS) for line in text.lower().split(b"\n")]


def pack(positions: np.ndarray) -> bytes:
    """Compressed list of line positions."""
    return zlib.compress(np.sort(positions).astype("<i4").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i4")


def bitmap(n_lines: int, gone: np.ndarray) -> bytes:
    """Compressed bits, one per line, 1 where the line stays."""
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_lines(bits: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines).astype(bool)


def _records(ranges: int, min_docs: int, min_chars: int, keep_first: bool, window: int):
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    known: set = set()  # hot keys that this task has told of

    def decide(where: list, hashes: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        """where: (file, row, number of lines) of each document of the window."""
        files, rows, counts = (np.array(x, np.int64) for x in zip(*where, strict=True))
        gone: list = [[] for _ in where]
        if hashes:
            h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
            doc, pos = np.repeat(np.arange(len(where)), docs), np.concatenate(places)
            order = np.lexsort((pos, doc, h[:, 1], h[:, 0]))
            h, doc, pos = h[order], doc[order], pos[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1)
            new_doc = new.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            first = np.flatnonzero(new)
            key = np.cumsum(new) - 1
            n_docs = np.add.reduceat(new_doc, first)
            # a key that must lose all its lines wherever it is, and is known to be one
            hot = (n_docs >= min_docs)[key] if not keep_first else np.zeros(len(h), bool)
            for d, p in zip(doc[hot].tolist(), pos[hot].tolist(), strict=True):
                gone[d].append(p)
            out = ~hot
            if hot.any():  # the stream is told of a hot key by one record, which comes first and is no line
                told = h[first[n_docs >= min_docs]]
                new_ones = [x for x in map(tuple, told.tolist()) if x not in known]
                if len(known) > KNOWN:
                    known.clear()
                known.update(new_ones)
                if new_ones:
                    told, m = np.array(new_ones, np.uint64), len(new_ones)
                    at = (told[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                    yield batch(at.astype(np.int32), told[:, 0].copy().view(np.int64), told[:, 1].copy().view(np.int64), np.full(m, FIRST), np.full(m, FIRST), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), np.full(m, HOT, np.int32))
            if keep_first:  # all but a window's first line go at once, wherever the key's first one is
                for d, p in zip(doc[~new].tolist(), pos[~new].tolist(), strict=True):
                    gone[d].append(p)
                out = new
            h, doc, pos = h[out], doc[out], pos[out]
            n = len(h)
            at = (h[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            yield batch(at.astype(np.int32), h[:, 0].view(np.int64), h[:, 1].view(np.int64), files[doc], rows[doc], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pos.astype(np.int32))
        n = len(where)
        deal = (files ^ (rows * 0x9E3779B1)) % ranges
        yield batch(deal.astype(np.int32), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), files, rows, counts, [pack(np.array(g, np.int64)) if g else None for g in gone], pa.nulls(n, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, hashes, docs, places, held = [], [], [], [], 0
        for b in batches:
            for file, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = (text.as_buffer().to_pybytes() if text.is_valid and text.as_buffer() is not None else b"")
                keys = line_keys(data)
                own = [i for i, k in enumerate(keys) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]
                where.append((file, row, len(keys)))
                hashes.append(b"".join([xxhash.xxh3_128_digest(keys[i]) for i in own]))
                docs.append(len(own))
                places.append(np.array(own, np.int64))
                held += len(data) + 200
                if held >= window:
                    yield from decide(where, hashes, docs, places)
                    where, hashes, docs, places, held = [], [], [], [], 0
        if where:
            yield from decide(where, hashes, docs, places)

    return run


def _stream(min_docs: int, keep_first: bool):
    """Over records in order of hash, document and position: the positions that go."""
    names = [c.split(" ")[0] for c in GONE.split(", ")]

    def out(files, rows, pos) -> pa.RecordBatch:
        n = len(pos)
        return pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(rows, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(pos, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key, decided = [], None, False  # lines of the open key that may yet go; whether it is known that they do
        for b in batches:
            whole = b.column(1).is_null()  # a document's own row: passed on
            if whole.true_count:
                own = b.filter(whole)
                yield pa.RecordBatch.from_arrays([own.column(i) for i in (3, 4, 5, 6, 7)], names=names)
                b = b.filter(pc.invert(whole))
            if not b.num_rows:
                continue
            h1, h2, f, r, p = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4, 7))
            new = np.ones(len(p), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new.copy()
            new_doc[1:] |= (f[1:] != f[:-1]) | (r[1:] != r[:-1])
            starts = np.append(np.flatnonzero(new), len(p))
            # the first key may have begun in an earlier batch, the last may go on
            if keep_first:
                going = ~new
                if open_key == (h1[0], h2[0]):
                    going[: starts[1]] = True
                open_key = (h1[-1], h2[-1])
                if going.any():
                    yield out(f[going], r[going], p[going])
                continue
            n_docs = np.add.reduceat(new_doc, starts[:-1])
            hot = np.logical_or.reduceat(p == HOT, starts[:-1])
            going = ((n_docs >= min_docs) | hot)[np.cumsum(new) - 1] & (p != HOT)
            going[starts[-2] :] = False
            head = slice(0, starts[1])
            if open_key == (h1[0], h2[0]):
                held.append((f[head], r[head], p[head]))
                going[head] = False
            else:
                held, decided = [], False
            if len(starts) > 2 or open_key != (h1[0], h2[0]):
                if held:  # the key that was open ends in this batch
                    yield from settle(held, decided, min_docs, out)
                last = slice(starts[-2], len(p))
                held, decided, open_key = [(f[last], r[last], p[last])], False, (h1[-1], h2[-1])
            if decided or proven(held, min_docs):
                decided = True
                yield from lines(held, out)
                held = []
            if going.any():
                yield out(f[going], r[going], p[going])

    def proven(held, least: int) -> bool:
        f, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
        return bool((p == HOT).any()) or 1 + int(((f[1:] != f[:-1]) | (r[1:] != r[:-1])).sum()) >= least

    def lines(held, out):
        f, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
        if (p != HOT).any():
            yield out(f[p != HOT], r[p != HOT], p[p != HOT])

    def settle(held, decided, least, out):
        if decided or proven(held, least):
            yield from lines(held, out)

    return run


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, window: int = 32 << 20) -> DataFrame:
    """Which lines of each document stay.

    A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lowered. Keys of at
    least ``min_chars`` code points that are in ``min_docs`` documents or more lose all their lines in
    every document; with ``keep_first`` every key keeps its first line in the corpus, by document and
    position, and loses the others (``min_docs`` is not used); documents are in order of their locators.

    Returns _file, _row (the locator of the row in ``docs``), n_lines, n_dropped, bits (compressed keep
    bitmap), one row for each row of ``docs``. Null and empty texts have one empty line, which stays.
    ``docs`` has to be read from Parquet (see ``common.anchored``). Rows are told apart by locator, so repeated rows and null or equal doc_ids count as documents of
    their own. Other columns are not read. An empty table gives an empty table. ``window`` is the bytes
    of text that a task counts at a time; it bounds memory and does not change the result.
    """
    n = partitions(docs.sparkSession)
    rows = located(docs, "text").select(FILE, ROW, "text")
    records = rows.transform(arrow_map, _records(n, min_docs, min_chars, keep_first, window), RECORD)
    streamed = records.repartitionById(n, "range").sortWithinPartitions("h1", "h2", FILE, ROW, "pos").transform(arrow_map, _stream(min_docs, keep_first), GONE)
    gathered = streamed.groupBy(FILE, ROW).agg(F.max("n_lines").alias("n_lines"), F.max("gone").alias("gone"), F.collect_list("pos").alias("pos"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, dropped = [], []
            for lines, gone, pos in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                own = np.array(pos, np.int64) if gone is None else np.union1d(np.array(pos, np.int64), unpack(gone))
                dropped.append(len(np.unique(own)))
                maps.append(bitmap(lines, own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=[FILE, ROW, "n_lines", "n_dropped", "bits"])

    return gathered.transform(arrow_map, bits, "_file long, _row long, n_lines long, n_dropped long, bits binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text of the lines that stay (or kept_sha256, its digest) of every document."""
    import hashlib

    joined = located(docs, "doc_id", "text").join(bitmaps, [FILE, ROW], "left").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_dropped", "bits")
    name = "text" if text else "kept_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, lines, dropped, bits in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                kept = value.as_py()
                if dropped:
                    kept = "\n".join([x for x, stays in zip(kept.split("\n"), kept_lines(bits.as_py(), lines).tolist(), strict=True) if stays])
                out.append(kept if text else hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", name])

    return joined.transform(arrow_map, run, f"doc_id long, n_lines long, n_dropped long, {name} string")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, text: bool = True) -> DataFrame:
    """Keep bitmaps of ``docs``, applied to it (see ``keep_bitmaps`` and ``apply_bitmaps``)."""
    docs = anchored(docs)
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first), text)
