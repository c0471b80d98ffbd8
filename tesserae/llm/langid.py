"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's features are the letter n-grams (2 to 4 bytes of its lowered text in UTF-8, everything but
letters as one blank), hashed into buckets. A text's vector is the mean of its n-grams' embeddings; a
linear softmax gives a probability for each language. Embeddings and weights are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. As both layers are linear, a
prediction needs the product of the two tables only: one row of class scores for each bucket.

Rejection is calibrated on sampled rows that training did not see. A temperature makes the probabilities
fit. How *typical* a text is, is the mean log frequency of its n-grams among the languages learned, in standard
deviations for texts of its length (a short text says little). Its threshold lies between texts that belong and texts that
don't: the same rows with their letters shuffled, random letters, and the texts of each language as they look to a model that
lacks it. Both error rates are kept with the model. Where the two overlap, texts that belong are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, bounded_sample

#: Answer for texts without a letter.
NO_LANGUAGE = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that stand for themselves: lower-case ASCII letters and whatever is part of a longer UTF-8 sequence.
KEPT = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
SIZES = (2, 3, 4)
#: Odd multipliers of the n-gram hash, one for each position.
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the buckets. sample: labelled rows fitted and calibrated on, at most. stretch: bytes of a training example. least_steps: of descent, which few rows get by more epochs. rejected: share of good texts rejected, at most. chance: probability that is never rejected, in multiples of a uniform guess."""

    bits: int = 16
    width: int = 16
    sample: int = 4000
    stretch: tuple[int, int] = (24, 240)
    epochs: int = 3
    least_steps: int = 250
    batch: int = 64
    rate: float = 0.5
    rejected: float = 0.0005
    chance: float = 1.2
    seed: int = 7


#: Share of texts that don't belong which the threshold is held against, and where between them and those that do it lies.
FOREIGN, BETWEEN = 0.9, 0.5


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row for each bucket: class scores (embeddings times weights), log of its frequency
    bias: np.ndarray
    temperature: float
    least_probability: float
    bits: int
    usual: tuple[float, float, float] = (0.0, 1.0, 1.0)  # how typical texts are: mean, variance of texts, variance of an n-gram
    least_typical: float = -math.inf
    errors: dict[str, float] = field(default_factory=dict)  # share of calibration rows that belong and are rejected, or do not and are accepted, by kind

    def typical(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations from the usual, for the mean log frequency of n n-grams."""
        return (mean - self.usual[0]) / np.sqrt(self.usual[1] + self.usual[2] / np.maximum(1, n))


def letters(text: str) -> np.ndarray:
    """Bytes of the lowered text with runs of anything but letters as one blank, and a blank at both ends."""
    b = KEPT[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    blank = b == 32
    return b[~(blank & np.concatenate([[False], blank[:-1]]))]


def ngrams(b: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of all n-grams, by size and then by place."""
    x, out, h = b.astype(np.uint32), [], np.zeros(len(b), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(x) - n + 1] + (x[n - 1 :] + np.uint32(n)) * MIX[n - 1]
        if n in SIZES:
            m = h ^ (h >> np.uint32(15))
            out.append((m * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits))
    return np.concatenate(out) if len(x) > max(SIZES) else np.concatenate([o for o in out if len(o)] or [np.zeros(0, np.uint32)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], s: Settings = Settings()) -> Model:  # noqa: B008
    """Train on four fifths of the rows and calibrate on the others. From no row with a letter comes a model that says ``und`` to all."""
    rows = [(letters(t), lang) for t, lang in zip(texts, langs, strict=True) if t and LETTER.search(t)]
    if not rows:
        return Model([NO_LANGUAGE], np.zeros((1 << s.bits, 2), np.float32), np.zeros(1, np.float32), 1.0, 0.0, s.bits)
    rng, languages = np.random.default_rng(s.seed), sorted({lang for _, lang in rows})
    code = {lang: i for i, lang in enumerate(languages)}
    own, held = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50], [r for i, r in enumerate(rows) if i % 5 == 0]
    size, k = 1 << s.bits, len(languages)
    emb = rng.normal(0, 0.1, (size, s.width)).astype(np.float32)
    out, bias = np.zeros((s.width, k), np.float32), np.zeros(k, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    seen = np.zeros((k, size))  # of each language, by texts alike

    def cut(b: np.ndarray) -> np.ndarray:
        n = int(rng.integers(*s.stretch))
        at = int(rng.integers(0, max(1, len(b) - n + 1)))
        return ngrams(b[at : at + n], s.bits)

    for b, lang in own:
        g = ngrams(b[: 1 << 16], s.bits)  # of a very long text, as much as tells
        seen[code[lang]] += np.bincount(g, minlength=size) / max(1, len(g))
    steps = max(s.least_steps, s.epochs * len(own) // s.batch)
    for step in range(steps):
        pick = rng.integers(0, len(own), s.batch)
        grams = [cut(own[i][0]) for i in pick]
        y = np.array([code[own[i][1]] for i in pick])
        lens = np.array([max(1, len(g)) for g in grams])
        flat, at = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        mean = np.zeros((len(grams), s.width), np.float32)
        np.add.at(mean, at, emb[flat])
        mean /= lens[:, None]
        g = _softmax(mean @ out + bias)
        g[np.arange(len(y)), y] -= 1
        rate = s.rate * (1 - step / steps)
        back = (g @ out.T) / lens[:, None]
        out -= rate * mean.T @ g / len(y) * 8
        bias -= rate * g.mean(axis=0)
        np.add.at(emb, flat, -rate * 16 * back[at])
    seen /= np.maximum(seen.sum(axis=1, keepdims=True), 1e-12)
    model = Model(languages, np.column_stack([emb @ out, _log_frequency(seen)]).astype(np.float32), bias, 1.0, 0.0, s.bits)
    _calibrate(model, held or own, seen, code, s, rng)
    return model


def _log_frequency(seen: np.ndarray) -> np.ndarray:
    """Of each bucket among some languages, which count alike; one that none has counts as a hundredth of an even share."""
    return np.log(seen.mean(axis=0) + 0.01 / seen.shape[1]) if len(seen) else np.zeros(seen.shape[1])


def _shuffled(b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Bytes of the text in another order; word lengths stay. (Bytes of a letter may be parted: n-grams are of bytes.)"""
    out, letter = b.copy(), b != 32
    out[letter] = rng.permutation(b[letter])
    return out


def _random_letters(b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    out, letter = b.copy(), b != 32
    out[letter] = rng.integers(97, 123, int(letter.sum()))
    return out


def _calibrate(model: Model, held: list, seen: np.ndarray, code: dict, s: Settings, rng: np.random.Generator) -> None:
    """Temperature by likelihood, then the thresholds, on whole texts and on short stretches of them."""
    texts = [b for b, _ in held]
    short = [b[(a := int(rng.integers(0, max(1, len(b) - 24)))) : a + 24] for b in texts]
    y = np.array([code[lang] for _, lang in held] * 2)
    z, mean, n = class_scores(texts + short, model)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    best = _softmax(z / model.temperature).max(axis=1)[: len(held)]
    # conservative, as the sample is too small to show a share that small and short good texts may look like two languages
    model.least_probability = float(min(s.chance / len(code), np.quantile(best, s.rejected) * 0.9))
    whole, part = mean[: len(held)], mean[len(held) :]
    usual = float(np.median(whole))
    of_texts = float(((whole - usual) ** 2).mean()) + 1e-6
    of_ngrams = max(1e-6, (float(((part - usual) ** 2).mean()) - of_texts)) * float(np.median(n[len(held) :]))
    model.usual = (usual, of_texts, max(of_ngrams, 1e-6))
    own = model.typical(mean, n)
    others = {kind: [change(b[: 1 << 12], rng) for b in texts] for kind, change in (("shuffled", _shuffled), ("random letters", _random_letters))}
    foreign = {kind: model.typical(*class_scores(x, model)[1:]) for kind, x in others.items()}
    if len(code) > 2:
        found = []
        for lang, i in code.items():
            lacking = model.table.copy()
            lacking[:, -1] = _log_frequency(np.delete(seen, i, axis=0))
            # what the others are to the lacking model, this language is not
            apart = Model(model.languages, lacking, model.bias, 1.0, 0.0, model.bits, model.usual)
            rows = [[b[: 1 << 12] for b, x in held if (x == lang) == foreign_one] for foreign_one in (True, False)]
            if rows[0] and rows[1]:
                other, kept = (class_scores(x, apart)[1:] for x in rows)
                apart.usual = (float(np.median(kept[0])), *model.usual[1:])
                found.append(apart.typical(*other))
        if found:
            foreign["other languages"] = np.concatenate(found)
    inside, outside = float(np.quantile(own, s.rejected)), float(np.quantile(np.concatenate(list(foreign.values())), FOREIGN))
    model.least_typical = inside - max(BETWEEN * (inside - outside), 0.05 * abs(inside))
    bad = (own < model.least_typical)[: len(held)] | (best < model.least_probability)
    model.errors = {"rejected": float(bad.mean()), **{f"accepted, {kind}": float((x >= model.least_typical).mean()) for kind, x in foreign.items()}}


def class_scores(parts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class scores of each text's letters, the mean log frequency of its n-grams, and their number."""
    z, mean, count = np.empty((len(parts), len(model.languages)), np.float32), np.empty(len(parts)), np.empty(len(parts), np.int64)
    for i, b in enumerate(parts):
        total, n = np.zeros(model.table.shape[1]), 0
        for at in range(0, max(1, len(b)), 1 << 18):  # blocks of a very long text
            g = ngrams(b[at : at + (1 << 18) + max(SIZES) - 1], model.bits)
            if len(g):
                total += np.ones(len(g), np.float32) @ model.table.take(g, axis=0)
                n += len(g)
        z[i], mean[i], count[i] = total[:-1] / max(1, n) + model.bias, total[-1] / max(1, n), n
    return z, mean, count


RESULT = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text.

    Returns doc_id, lang_pred (``und`` for a null text or one without a letter), score (the calibrated
    probability, 0 for ``und``), rejected (too improbable or not typical enough of the texts learned from; ``und``
    as well), and the columns of ``docs`` named in ``keep`` under those names; one row for each row of
    ``docs``. Null doc_ids and repeated rows stay as they are; other columns are not read; an empty table
    gives an empty table. The model is a fixed-size table, sent to each worker once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            good = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if m.languages != [NO_LANGUAGE] else []
            lang, score, bad = [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [True] * len(texts)
            z, mean, n = class_scores([letters(texts[i]) for i in good], m)
            if good:
                p = _softmax(z.astype(np.float64) / m.temperature)
                for i, row, typical in zip(good, p, m.typical(mean, n).tolist(), strict=True):
                    k = int(row.argmax())
                    lang[i], score[i] = m.languages[k], float(min(1.0, row[k]))
                    bad[i] = bool(row[k] < m.least_probability or typical < m.least_typical)
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_()), *(batch.column(2 + i) for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected", *keep])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(k) for k in keep]).transform(arrow_map, run, RESULT + fields)


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the decimal doc_id, by 4, leaves 2. Null ids are held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language, ``most`` at most in all: those of the rarest first, as many as an even share of what is left. One at least."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left = max(0, left - out[lang])
    return out


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Rows of every language by ``quotas``, those with the smallest hashes of doc_id, in the order of these hashes.

    A first pass counts by language, so that the second only passes on about as many rows of each as are wanted.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language, as the model has
    if sum(counts.values()) <= most:
        return bounded_sample(rows, most)
    wanted = quotas(counts, most)
    # more than wanted by six standard deviations, so that hashes hardly ever give fewer
    share = {k: min(1.0, (n + 6 * n**0.5 + 20) / counts[k]) for k, n in wanted.items()}
    limits = [(k, n, 2**63 - 1 if share[k] >= 1 else int(-(2**63) + share[k] * (2**64 - 1))) for k, n in wanted.items()]
    h = F.xxhash64(F.col("doc_id"), F.lit(17))
    limits = F.broadcast(rows.sparkSession.createDataFrame(limits, "lang string, _rows long, _limit long"))
    near = rows.join(limits, "lang").withColumn("_h", h).where("_h <= _limit")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    return near.withColumn("_place", place).where("_place <= _rows").orderBy("_h", "doc_id").select(*rows.columns)


def train(labelled: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on at most ``s.sample`` of the rows (text, lang) with both (one of each language at least), drawn for each language by ``sampled``."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    few = sampled(rows, s.sample).select("text", "lang").toPandas()
    return fit(few["text"].tolist(), few["lang"].tolist(), s)
