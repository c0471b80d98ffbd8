"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

* A text's features are its shingles of five words, weighted by count times inverse document frequency.
  Document frequencies cover all documents: they are counted in a count sketch (three rows of signed counters, the median of
  which is the estimate), so the table has one size for every corpus. What shares a counter cancels out: the error grows with the root
  of the number of documents, so rare and frequent shingles stay apart at every size.
* Improved consistent weighted sampling (Ioffe 2010) draws 64 samples (shingle, level) of each weighted
  set; two sets agree in one with the probability of their weighted Jaccard similarity. The samples are
  banded (16 bands of 4); texts that share a band's bucket may be similar.
* Texts with the same weighted set are one *node* (its fingerprint), so copies cost a row each and no pair.
* Each group of four bands draws from a row of random numbers of its own for each shingle, by a hash of its own, so no two shingles share the draws
  of all bands.
* Each bucket compares its members with a pivot, its smallest node, by exact weighted Jaccard similarity
  over the whole texts. Buckets whose other members aren't all in one component go on with the
  untried member that is most similar to the last pivot, the likely origin of the others. After a few rounds
  the members outside the largest component of a bucket that is still open are compared with all of its
  members, block by block: a task has two blocks of bounded size and returns a spanning set of
  links. So no link within a bucket is lost, and no pair is a row unless it was a pivot's.
* Components are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import folders
from tesserae.llm.common import FILE, ROW, anchored, arrow_map, let_go, located, partitions, rows_of, stored, text_of
from tesserae.llm.exact_dedup import identifier

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. similar: least weighted Jaccard similarity of a link. frequency_bits: log2 of the counters in a row of the sketch. table_bits: log2 of the rows of random numbers that a band draws from."""

    words: int = 5
    similar: float = 0.8
    bands: int = 16
    band_rows: int = 4
    frequency_bits: int = 17
    table_bits: int = 16
    rounds: int = 2
    seed: int = 1


def shingles(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lowered words, ascending, and how often each is there. A shorter text is one shingle."""
    h, counts, _ = shingled([text], words)
    return h, counts


def shingled(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` of some texts, one after the other, and where each text's begin and the last ones end."""
    found = [WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    w = np.fromiter((x for f in found for x in map(xxhash.xxh3_64_intdigest, f)), np.uint64, int(sizes.sum()))
    n = np.where(sizes, np.maximum(1, sizes - words + 1), 0)
    # the first word of every shingle; its text's length, if that is shorter
    ends = np.cumsum(n)
    first = np.repeat(np.cumsum(sizes) - sizes - ends + n, n) + np.arange(ends[-1])
    long = np.repeat(np.minimum(sizes, words), n)
    h = long.astype(np.uint64)
    whole = bool((long == words).all())
    for i in range(words):
        if whole:
            h = (h ^ w[first + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        else:
            own = (h ^ w[np.minimum(first + i, len(w) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            h = np.where(i < long, own ^ (own >> np.uint64(29)), h)
    starts = ends - n
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[starts[n > 0]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(at, append=len(h)), np.searchsorted(at, np.append(starts, len(h)))


def _blocks_of(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts, in runs of about so many characters."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


#: Odd multipliers of the sketch's rows; parts that the sketch is summed in.
ROWS, PARTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64), 64


def counters(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle and row of the sketch, its counter (numbered through all rows) and its sign."""
    m = (h ^ (h >> np.uint64(32)))[None, :] * ROWS[:, None]
    at = (m >> np.uint64(64 - bits)).astype(np.int64) + (np.arange(len(ROWS)) << bits)[:, None]
    return at, ((m >> np.uint64(63 - bits)) & np.uint64(1)).astype(np.int8) * 2 - 1


#: Documents that are added to each shingle's.
RARE = 16


@dataclass
class Frequencies:
    """A count sketch of the number of documents that each shingle is in, and the number of documents."""

    counts: np.ndarray
    n: int
    bits: int

    def documents(self, h: np.ndarray) -> np.ndarray:
        """How many documents each shingle is in: the median of its counters, 1 at least."""
        at, sign = counters(h, self.bits)
        a, b, c = self.counts.take(at) * sign
        return np.clip(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), 1, max(1, self.n))

    def idf(self, h: np.ndarray) -> np.ndarray:
        """1 + ln((RARE + documents) / (RARE + documents with the shingle)) / ln(RARE + 1 + documents), from 1 (everywhere) to nearly 2.

        What a few documents have counts as rare as what one has, so the limit means the same for a pair as for plain similarity. Scaled to that range so that what a large group of copies shares still outweighs what tells two of them apart, and a
        similarity means much the same in groups of two and of thousands.
        """
        apart = np.log(np.float32(RARE + self.n)) - np.log(RARE + self.documents(h).astype(np.float32))
        return 1 + apart * np.float32(1 / np.log(RARE + 1 + self.n))


def _counted(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(len(ROWS) << s.frequency_bits, np.int64), 0
        for batch in batches:
            for texts in _blocks_of(batch.column(0).to_pylist()):
                h, _, at = shingled(texts, s.words)
                n += int((np.diff(at) > 0).sum())
                for k in range(0, len(h), 1 << 18):
                    where, sign = counters(h[k : k + (1 << 18)], s.frequency_bits)
                    table += np.bincount(where.ravel(), sign.ravel(), len(table)).astype(np.int64)
        if n:
            yield from _blobs(enumerate(np.array_split(table, PARTS)), n)

    return run


def _blobs(parts, n: int) -> Iterator[pa.RecordBatch]:
    numbers, packed = zip(*((i, pa.compress(x.astype("<i8").tobytes(), "zstd", asbytes=True)) for i, x in parts), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary()), pa.array([n] * len(numbers), pa.int64())], names=["part", "counts", "n"])


def _summed(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [len(x) for x in np.array_split(np.zeros(len(ROWS) << s.frequency_bits, np.int8), PARTS)], 0
        sums: dict[int, np.ndarray] = {}
        of: dict[int, int] = {}
        for batch in batches:
            for i, blob, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(pa.decompress(blob.as_buffer(), 8 * parts[i], "zstd", asbytes=True), "<i8")
                sums[i] = sums[i] + own if i in sums else own.copy()
                of[i] = of.get(i, 0) + k
        for i, x in sums.items():
            yield from _blobs([(i, x)], of[i])

    return run


def frequencies(texts: DataFrame, s: Settings) -> Frequencies:
    """The sketch over every text of the one column. Tasks count into sketches of one fixed size; each of their parts is summed by itself, and the driver gets the sums."""
    columns = "part int, counts binary, n long"
    summed = texts.transform(arrow_map, _counted(s), columns).repartition(partitions(texts.sparkSession), "part").transform(arrow_map, _summed(s), columns)
    table, n = np.array_split(np.zeros(len(ROWS) << s.frequency_bits, np.int64), PARTS), 0
    for row in summed.toLocalIterator():  # PARTS rows
        table[row["part"]] = np.frombuffer(pa.decompress(row["counts"], table[row["part"]].nbytes, "zstd", asbytes=True), "<i8")
        n = row["n"]
    return Frequencies(np.concatenate(table).astype(np.float32), n, s.frequency_bits)


def weights(h: np.ndarray, counts: np.ndarray, table: Frequencies) -> np.ndarray:
    return counts.astype(np.float32) * table.idf(h)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights of two sets (ascending hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    either = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / either if either else 0.0


#: Bands that draw from one row.
TOGETHER = 4


@lru_cache(maxsize=1)
def _random(s: Settings) -> tuple[np.ndarray, ...]:
    """1/r, beta, r and ln c - r: rows that a shingle's hash chooses from, a column for each sample of a group of bands; and a multiplier for each group."""
    rng, groups = np.random.default_rng(s.seed), -(-s.bands // TOGETHER)
    shape = 1 << s.table_bits, s.bands * s.band_rows // groups
    r = rng.gamma(2, 1, shape)
    c = rng.gamma(2, 1, shape)
    beta = rng.random(shape)
    odd = rng.integers(0, 1 << 63, groups, np.uint64) * np.uint64(2) + np.uint64(1)
    return *(x.astype(np.float32) for x in (1 / r, beta, r, np.log(c) - r)), odd


def samples(h: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    """One hash of (shingle, level) for each sample, band by band. Ties go to the smaller shingle hash."""
    per_r, beta, r, c, odd = _random(s)
    mixed = h ^ (h >> np.uint64(29))
    log_w = np.log(w)
    best, level, which = None, None, None
    for at in range(0, len(h), 512):  # blocks that stay in cache; long texts need no more memory
        k = (mixed[at : at + 512, None] * odd >> np.uint64(64 - s.table_bits)).astype(np.int64)  # the row of each shingle in each group
        b = beta.take(k, axis=0).reshape(len(k), -1)
        t = per_r.take(k, axis=0).reshape(len(k), -1)
        t *= log_w[at : at + 512, None]
        t += b
        np.floor(t, out=t)
        b -= t
        b *= r.take(k, axis=0).reshape(len(k), -1)
        b += c.take(k, axis=0).reshape(len(k), -1)  # ln c - r - r (t - beta)
        i = b.argmin(axis=0)
        columns = np.arange(b.shape[1])
        own, t = b[i, columns], t[i, columns]
        if best is None:
            best, level, which = own, t, i + at
        else:
            less = own < best
            best, level, which = np.where(less, own, best), np.where(less, t, level), np.where(less, i + at, which)
    return (h[which] ^ level.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)


def bands(drawn: np.ndarray, s: Settings) -> np.ndarray:
    """A key for each band."""
    m = drawn.reshape(s.bands, s.band_rows)
    key = np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
    for i in range(s.band_rows):
        key = (key ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _signed(table, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for texts in _blocks_of(batch.column(3).to_pylist()):
                flat, each, at = shingled(texts, s.words)
                heavy = weights(flat, each, table.value)
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    h = flat[i:j]
                    nodes.append(xxhash.xxh3_128_digest(h.tobytes() + each[i:j].tobytes()) if len(h) else None)
                    keys.append(bands(samples(h, heavy[i:j], s), s) if len(h) else None)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(nodes, pa.binary()), pa.array(keys, kind)], names=["doc_id", FILE, ROW, "node", "bands"])

    return run


def _compared(table, s: Settings):
    """a, b, similarity of a, b, text of a, text of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def weighted(node: int, text: str):
            if node not in known:
                if len(known) > 64:
                    known.clear()
                h, counts = shingles(text, s.words)
                known[node] = h, weights(h, counts, table.value)
            return known[node]

        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            found = [weighted_jaccard(weighted(p, q.as_py()), weighted(u, v.as_py())) for p, u, q, v in zip(a.to_pylist(), b.to_pylist(), x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(found, pa.float64())], names=["a", "b", "sim"])

    return run


def _elements(text: str, table: Frequencies, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set as a plain set: a shingle that is there n times as n elements. Sums of shared elements' weights are sums of smaller weights."""
    h, counts = shingles(text, s.words)
    w = weights(h, np.ones(len(h), np.int64), table)
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    e = (np.repeat(h, counts) + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    return e, np.repeat(w, counts)


def similar_between(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Index pairs of sets of a and of b whose weighted Jaccard similarity is ``least`` or more: exact, by shared elements."""
    of = [np.repeat(np.arange(len(x)), [len(e) for e, _ in x]) for x in (a, b)]
    flat = [np.concatenate([e for e, _ in x] or [np.zeros(0, np.uint64)]) for x in (a, b)]
    heavy = np.concatenate([w for _, w in a] or [np.zeros(0, np.float32)])
    order = [np.argsort(e, kind="stable") for e in flat]
    flat, of, heavy = [e[o] for e, o in zip(flat, order, strict=True)], [i[o] for i, o in zip(of, order, strict=True)], heavy[order[0]]
    both = np.intersect1d(*flat)
    lo_a, hi_a, lo_b, hi_b = (np.searchsorted(flat[k], both, side) for k in (0, 1) for side in ("left", "right"))
    shared = np.zeros((len(a), len(b)))
    single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
    np.add.at(shared, (of[0][lo_a[single]], of[1][lo_b[single]]), heavy[lo_a[single]])
    for i, j, k, m in zip(*(x[~single].tolist() for x in (lo_a, hi_a, lo_b, hi_b)), strict=True):
        shared[of[0][i:j, None], of[1][None, k:m]] += heavy[i]  # a set has an element once
    total = [np.array([w.sum(dtype=np.float64) for _, w in x]) for x in (a, b)]
    either = total[0][:, None] + total[1][None, :] - shared
    return np.argwhere((shared >= least * either) & (either > 0))


BLOCK = "array<struct<node: bigint, label: bigint, text: string>>"


def _between_blocks(table, s: Settings):
    """Of pairs of blocks (lists of node, label, text): links that join different labels, as few as join them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for q, m in zip(batch.column(0), batch.column(1), strict=True):
                q, m = q.as_py(), m.as_py()
                made = {r["node"]: _elements(r["text"], table.value, s) for r in q + m}
                top: dict[int, int] = {}

                def root(x: int) -> int:
                    while top.setdefault(x, x) != x:
                        top[x] = x = top[top[x]]
                    return x

                for i, j in similar_between([made[r["node"]] for r in q], [made[r["node"]] for r in m], s.similar).tolist():
                    x, y = root(q[i]["label"]), root(m[j]["label"])
                    if x != y:
                        top[y] = x
                        links.append((q[i]["node"], m[j]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def apart(totals: DataFrame) -> DataFrame:
    """An aggregate by key that is to be joined by that key, dealt anew: a join of two plain shuffles is split over tasks where a key is hot."""
    return totals.repartition(partitions(totals.sparkSession))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it is linked to, over any number of links) for every node of the edges (a, b).

    Alternating large-star and small-star steps until nothing changes; each step is written to the
    checkpoint folder. Smallest neighbours are aggregated before the shuffle (see ``apart`` for what meets a hub then).
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")).toDF("u", "v") if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.join(apart(least), "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    folders.top(edges.sparkSession)
    e = edges.select("a", "b").where("a <> b").distinct()
    before = None
    while True:
        e = step(step(e, large=True).checkpoint(), large=False).checkpoint()
        now = sign(e)
        if now == before or not now[0]:
            let_go(edges.sparkSession)
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


@dataclass
class Links:
    """links: a, b of linked nodes, enough to join every component. labels: node, label of the nodes that have a link."""

    links: DataFrame
    labels: DataFrame


def _linked(spark: SparkSession, members: DataFrame, texts: DataFrame, table, s: Settings) -> Links:
    """members: key, node of every bucket of two nodes or more."""
    links = spark.createDataFrame([], "a long, b long")
    labels, all_tested = spark.createDataFrame([], "node long, label long"), links
    known = texts.withColumn("size", F.length("text"))

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct().join(all_tested, ["a", "b"], "left_anti")
        left = pairs.join(texts.toDF("a", "text_a"), "a")
        return stored(left.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b").transform(arrow_map, _compared(table, s), "a long, b long, sim double"), "near-tested")

    def joined(new: DataFrame) -> DataFrame:
        return components(labels.toDF("a", "b").union(new.select("a", "b"))).checkpoint()

    open_ = members.join(apart(members.groupBy("key").agg(F.min("node").alias("pivot"))), "key").withColumns({"used": F.lit(False), "label": F.col("node")})
    for turn in range(s.rounds):
        pairs = open_.where("node <> pivot AND label <> pivot_label" if turn else "node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y"))
        done = compare(pairs)
        all_tested = all_tested.union(done.select("a", "b"))
        new = done.where(F.col("sim") >= s.similar)
        if not new.isEmpty():
            links = links.union(new.select("a", "b"))
            labels = joined(new)
        # buckets whose members, but for the pivots, aren't all of one component
        m = open_.drop("label", "pivot_label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("used", F.col("used") | (F.col("node") == F.col("pivot"))).checkpoint()
        keys = apart(m.where("NOT used").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"))
        sims = done.toDF("node", "pivot", "sim").union(done.select("b", "a", "sim").toDF("node", "pivot", "sim"))
        m = m.join(keys, "key", "left_semi").join(sims, ["node", "pivot"], "left")
        best = m.where("NOT used").groupBy("key").agg(F.max_by(F.struct("node", "label"), F.struct(F.coalesce("sim", F.lit(0.0)), "node")).alias("next"))
        open_ = m.drop("pivot", "sim").join(apart(best.select("key", F.col("next.node").alias("pivot"), F.col("next.label").alias("pivot_label"))), "key").checkpoint()
        if open_.isEmpty():
            return Links(links, labels)
        let_go(spark)
    # the rest: members outside a bucket's largest component against all members, block by block
    m = open_.where("NOT used").select("key", "node", "label").join(known.select("node", "size"), "node")
    counts = m.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = apart(counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    m = m.join(main, "key").withColumn("outside", F.col("label") != F.col("main")).checkpoint()

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        """key, <name> (number) and <name>_rows; about 256 texts or a million characters a block."""
        sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / 256), F.ceil(F.sum("size") / 1_000_000)).alias("blocks"))
        dealt = rows.join(apart(sizes), "key").withColumn(name, F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
        return stored(dealt.join(texts, "node").groupBy("key", name).agg(F.collect_list(F.struct("node", "label", "text")).alias(f"{name}_rows")), "near-blocks")

    q, every = blocks(m.where("outside"), "q"), blocks(m, "e")
    # numbers first, so that a bucket of many blocks is spread by block before any text is attached
    both = q.select("key", "q").join(every.select("key", "e"), "key")
    both = both.join(every, ["key", "e"]).join(q, ["key", "q"]).select(F.col("q_rows").cast(BLOCK), F.col("e_rows").cast(BLOCK))
    new = stored(both.transform(arrow_map, _between_blocks(table, s), "a long, b long"), "near-rest")
    if not new.isEmpty():
        links, labels = links.union(new), joined(new)
    return Links(links, labels)


def near_dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The class of near-duplicates of every row.

    Classes are the components of links: pairs of texts whose weighted Jaccard similarity over TF-IDF
    shingles of five lowered words is 0.8 or more (see ``Settings``). The row with the smallest doc_id stays (null
    ids come last; then by locator). Texts of fewer than five words are one shingle; texts without a
    word (null and empty ones too) are alone in their class. Returns, one row for each row of
    ``docs``: doc_id, _file, _row, class_id (the doc_id that stays), class_size, kept. Other
    columns aren't read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = anchored(docs)
    rows = located(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, text_of().alias("text"))
    table = spark.sparkContext.broadcast(frequencies(rows.select("text"), s))
    signed = stored(rows.transform(arrow_map, _signed(table, s), "doc_id long, _file long, _row long, node binary, bands array<long>"), "near-signed")
    nodes = stored(signed.where("node IS NOT NULL").groupBy("node").agg(F.min(identifier()).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    # from here on nodes go by the numbers that were written with them: short keys, and aggregates that need no sort
    keyed = nodes.select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    members = stored(keyed.join(apart(shared), "key"), "near-members")
    wanted = members.select("node").distinct().join(nodes.select(F.col("id").alias("node"), F.col("first.file").alias(FILE), F.col("first.row").alias(ROW)), "node")
    texts = stored(rows.select(FILE, ROW, "text").join(wanted, [FILE, ROW]).select("node", "text"), "near-texts")
    let_go(spark)
    labels = _linked(spark, members, texts, table, s).labels
    let_go(spark)
    labelled = nodes.select("node", "id", "first", "n").join(labels.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    classes = labelled.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    by_node = labelled.select("node", "label").join(classes, "label").select("node", "first", "class_size")
    of = signed.drop("bands").join(by_node, "node", "left")
    first = F.coalesce("first", identifier())
    return of.withColumn("first", first).select(
        "doc_id", FILE, ROW, F.col("first.id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), ((F.col("first.file") == F.col(FILE)) & (F.col("first.row") == F.col(ROW))).alias("kept")
    )


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with one row of each class of near-duplicates (see ``near_dedup``), with all of its columns, whatever their names."""
    docs = anchored(docs)
    return rows_of(docs, near_dedup(docs, s).where("kept"))
