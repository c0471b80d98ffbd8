"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from a bounded sample of labelled texts: words that are much more frequent in
toxic documents than in others, and stems of such words, by a smoothed log-odds ratio with a floor on how many documents show it.
Features of a whole text: lexicon densities and counts, also among words with letters replaced by digits
or signs (obfuscation undone), lexicon words near a second-person word, shares of capitals and of words
in capitals, rates of punctuation, of obfuscated words and of stretched letters. Histogram-based
trees are boosted on logistic loss in numpy; scores are calibrated by pooling adjacent violators on
sampled rows that the trees were not grown on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, bounded_sample, text_of

#: Second-person words of the languages met so far.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch ihr sie tu te ti tus vous toi ton ta tes votre vos usted ustedes vosotros".split())
#: Signs and digits that stand in for letters.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W_]+")
#: A word with signs or digits between its letters.
MASKED = re.compile(r"(?<![^\W_])[^\W\d_]+[0-9@$!*|#]+[^\W\d_]+(?:[0-9@$!*|#]+[^\W\d_]+)*")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
MARKS = re.compile(r"[!?]")
PUNCTUATION = re.compile(r"[^\w\s]")
FEATURES = ("lexicon_share", "lexicon_count", "lexicon_kinds", "lexicon_weight", "strongest", "kinds_weight", "kinds_share", "closest", "second_share", "second_near", "capitals", "capital_words", "marks", "punctuation", "masked", "masked_hits", "stretched", "words")


@dataclass(frozen=True)
class Settings:
    """sample: labelled texts learned from, at most, of each label."""

    sample: int = 4000
    lexicon: int = 400
    least_docs: int = 8
    least_odds: float = 2.0
    near: int = 6
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    l2: float = 1.0
    seed: int = 3


@dataclass
class Model:
    lexicon: dict[str, float]
    near: int
    start: float = 0.0
    rate: float = 0.1
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # features, thresholds, leaves of complete trees
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))


def entries(word: str) -> list[str]:
    """What a lowered word can match: itself, and its stems of STEMS letters, written with a final star."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def learn_lexicon(texts: list[str], labels: list[int], s: Settings) -> dict[str, float]:
    counts: dict[str, list[int]] = {}
    for text, y in zip(texts, labels, strict=True):
        for e in {e for w in set(WORD.findall(text.lower())) for e in entries(w)}:
            counts.setdefault(e, [0, 0])[y] += 1
    n = [max(1, labels.count(0)), max(1, labels.count(1))]
    odds = {e: math.log((t + 0.5) / n[1]) - math.log((c + 0.5) / n[0]) for e, (c, t) in counts.items() if t >= min(s.least_docs, max(2, n[1] // 10))}
    # ranked by how much an entry tells: rare ones with high odds by chance come last
    best = sorted((e for e, o in odds.items() if o >= s.least_odds), key=lambda e: (-odds[e] * counts[e][1], e))[: s.lexicon]
    return {e: odds[e] for e in best}


class Lexicon:
    """Weight of a lowered word: the largest of the entries it matches, 0 if none. Remembers a bounded number of words."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.known = odds, {}

    def __call__(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 300_000:
                self.known.clear()
            w = self.known[word] = max([self.odds.get(e, 0.0) for e in entries(word)])
        return w


def features(text: str, lexicon: Lexicon, near: int) -> list[float]:
    """Dense features of a whole text, in the order of FEATURES."""
    words = WORD.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    low = [w.lower() for w in words]
    weight = list(map(lexicon, low))
    hits = [i for i, w in enumerate(weight) if w]
    second = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    close = 0
    if hits and second:
        a = np.array(second)
        for i in hits:
            k = int(np.searchsorted(a, i))
            close += min((abs(int(a[j]) - i) for j in (k - 1, k) if 0 <= j < len(a)), default=near + 1) <= near
    gaps = [b - a for a, b in zip(hits, hits[1:], strict=False)]
    masked = MASKED.findall(text)
    undone = sum(max(lexicon(m.lower().translate(STAND_INS)), lexicon(re.sub(r"[^\w]|\d", "", m.lower()))) > 0 for m in masked)
    kinds = {low[i]: weight[i] for i in hits}
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    upper = sum(map(str.isupper, text))
    return [
        len(hits) / n,
        math.log1p(len(hits)),
        len(kinds),
        sum(weight) / n,
        max(kinds.values(), default=0.0),
        sum(kinds.values()),
        len(kinds) / max(1, len(set(low))),
        1 / min(gaps) if gaps else 0.0,
        len(second) / n,
        close,
        upper / chars,
        capitals / n,
        len(MARKS.findall(text)) / n,
        len(PUNCTUATION.findall(text)) / chars,
        len(masked) / n,
        undone,
        len(STRETCHED.findall(text)) / n,
        math.log1p(len(words)),
    ]


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree by Newton gain over histograms. A node without a gain sends every row left."""
    inner = (1 << s.depth) - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(g), np.int64)
    n_features, n_bins = binned.shape[1], s.bins + 1
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = 1e-6
        if len(rows) >= 2:
            for f in range(n_features):
                b = binned[rows, f]
                gl, hl = (np.cumsum(np.bincount(b, v[rows], n_bins))[:-1] for v in (g, h))
                gt, ht = g[rows].sum(), h[rows].sum()
                gain = gl**2 / (hl + s.l2) + (gt - gl) ** 2 / (ht - hl + s.l2) - gt**2 / (ht + s.l2)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
                gain = gain[: len(cuts[f])]
                if len(gain) and gain.max() > best:
                    k = int(gain.argmax())
                    best, feature[node], threshold[node] = float(gain[k]), f, cuts[f][k]
        right = (binned[rows, feature[node]] > np.searchsorted(cuts[feature[node]], threshold[node])) if np.isfinite(threshold[node]) else np.zeros(len(rows), bool)
        at[rows] = 2 * node + 1 + right
    leaf = at - inner
    gs, hs = (np.bincount(leaf, v, inner + 1) for v in (g, h))
    return feature, threshold, -gs / (hs + s.l2)


def _tree(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    feature, threshold, leaves = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range((len(feature) + 1).bit_length() - 1):
        at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
    return leaves[at - len(feature)]


def margin(x: np.ndarray, m: Model) -> np.ndarray:
    return m.start + m.rate * sum((_tree(x, t) for t in m.trees), np.zeros(len(x)))


def isotonic(z: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the rising share of label 1 at them, by weight. Ends are smoothed by half a row of weight 1."""
    w = np.ones(len(z)) if w is None else w
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum of z, sum of y, rows, each by weight
    for a, b, n in zip(z[order], y[order], w[order], strict=True):
        blocks.append([float(a * n), float(b * n), float(n)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5 * (b[1] / b[2])) / (b[2] + 0.5) if b[1] < b[2] else (b[1] + 0.25) / (b[2] + 0.5) for b in blocks])


def fit(texts: list[str], labels: list[int], weights: list[float], s: Settings = Settings()) -> Model:  # noqa: B008
    """Grow on three quarters of the rows, calibrate on the others. weights make up for how the labels were sampled."""
    dealt = np.random.default_rng(s.seed).permutation(len(texts)).tolist()
    held, own = sorted(dealt[: len(texts) // 4]), sorted(dealt[len(texts) // 4 :])
    if len(set(labels)) < 2 or len(held) < 4 or len({labels[i] for i in own}) < 2:
        own = held = list(range(len(texts)))
    lexicon = learn_lexicon([texts[i] for i in own], [labels[i] for i in own], s)
    model = Model(lexicon, s.near, rate=s.rate)
    weigh = Lexicon(lexicon)
    x = np.array([features(t, weigh, s.near) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
    y, w = np.array(labels, np.float64), np.array(weights)
    if not len(texts):
        return model
    cuts = [np.unique(np.quantile(x[own, f], np.linspace(0, 1, s.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[own, f]) for f, c in enumerate(cuts)])
    share = float(np.clip((y[own] * w[own]).sum() / w[own].sum(), 1e-3, 1 - 1e-3))
    model.start = math.log(share / (1 - share))
    z = np.full(len(own), model.start)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(binned, w[own] * (p - y[own]), w[own] * np.maximum(p * (1 - p), 1e-6), cuts, s)
        model.trees.append(tree)
        z += s.rate * _tree(x[own], tree)
    # the sample has as many toxic rows as others at most: by weight, so that the curve gives shares of the corpus
    model.curve = isotonic(margin(x[held], model), y[held], w[held] / w[held].min())
    return model


def _lexicon(m: Model) -> Lexicon:
    if not hasattr(m, "_weigh"):
        m._weigh = Lexicon(m.lexicon)  # one for each worker, as the model is
    return m._weigh


def scores(texts: list[str], m: Model) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    weigh = _lexicon(m)
    x = np.array([features(t, weigh, m.near) for t in texts], np.float64)
    z = margin(x, m)
    flat = np.interp(z, *m.curve)
    # ties of the curve keep the order of the trees' margins: a nudge too small to cross a half
    nudged = flat + 1e-4 * (1 / (1 + np.exp(-z)) - 0.5)
    return np.clip(np.where((flat >= 0.5) == (nudged >= 0.5), nudged, flat), 0, 1)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The toxicity of every whole text.

    Returns doc_id, score (0 to 1), predicted (1 from a half on) and the columns named in ``keep``, one row for each row
    of ``docs``. Null counts as empty; an empty text gets the score of a text without words. Null doc_ids and
    repeated rows stay as they are; other columns are not read; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                p = scores(part.column(1).to_pylist(), shared.value)
                columns = [part.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), *(part.column(2 + i) for i in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", *keep])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *[F.col(k) for k in keep]).transform(arrow_map, run, "doc_id long, score double, predicted int" + fields)


def held_out() -> Column:
    """Rows whose labels nothing is learned from: crc32 of the decimal doc_id, by 5, leaves 0. Null ids are held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on at most ``s.sample`` labelled texts of each label (doc_id, toxic), those with the smallest hashes of doc_id.

    Labels other than 0 and 1, and null ones, are not used; a doc_id's labels count once if repeated, and not at all if they contradict each other.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    parts, weights = [], []
    for y in (0, 1):
        own = known.where(F.col("toxic") == y)
        n = own.count()
        few = bounded_sample(own, s.sample)
        # a few thousand ids: a fixed bound
        got = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id")).limit(s.sample).toPandas()
        parts.append(got)
        weights.append(n / max(1, len(got)))
    # in an order that does not follow the labels
    rows = sorted((int(i), t, y, w) for p, w in zip(parts, weights, strict=True) for i, t, y in zip(p["doc_id"], p["text"], p["toxic"], strict=True))
    return fit([r[1] for r in rows], [int(r[2]) for r in rows], [r[3] for r in rows], s)
