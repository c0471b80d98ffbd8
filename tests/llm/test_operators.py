"""Operators on Spark: odd input, and brute force on small input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe, exact_dedup, langid, licenses, line_dedup, media, mixing, near_dedup, secrets, toxicity
from tests.llm.conftest import LONG, ROWS

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_exact(odd, none):
    got = by_id(exact_dedup.dedup(odd))
    assert len(got) == len(ROWS) and exact_dedup.dedup(none).count() == 0
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t, _, _ in ROWS}
    size = Counter(re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t, _, _ in ROWS)
    for r in got:
        t = norm[r["doc_id"]]
        assert r["group_size"] == size[t] and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["keep_id"] == min((i for i in norm if norm[i] == t and i is not None), default=None)
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert kept == [1, 2, 4, 6, 9, 10, 11, 12, None]  # one of the two rows 9
    assert sorted(i or 99 for (i,) in exact_dedup.deduplicated(odd).select("doc_id").collect()) == [1, 2, 4, 6, 9, 10, 11, 12, 99]
    assert exact_dedup.deduplicated(odd).columns == odd.columns


def test_exact_with_colliding_digests(odd):
    """Digests of 8 bits: hits are told apart by their full texts."""
    want = [{k: v for k, v in r.items() if k not in ("_file", "_row")} for r in by_id(exact_dedup.dedup(odd))]
    got = [{k: v for k, v in r.items() if k not in ("_file", "_row")} for r in by_id(exact_dedup.dedup(odd, bits=8))]
    key = lambda r: (str(r["doc_id"]), r["kept"])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_exact_colliding_on_purpose(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = exact_dedup.dedup(spark.read.parquet(str(tmp_path / "d")), bits=8).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, i % 40, 15, i < 40) for i in range(600)}


def test_exact_goes_on_in_its_folder(spark, tmp_path):
    """A second call with a folder takes up the digests and the state that a first one left there."""
    spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs, folder = spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "kept")
    want = sorted(map(tuple, exact_dedup.dedup(docs, folder=folder).collect()))
    written = sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "kept" / "digests").iterdir())
    assert sorted(map(tuple, exact_dedup.dedup(docs, folder=folder).collect())) == want
    assert sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "kept" / "digests").iterdir()) == written


def test_only_hits_pass_the_filter(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("_file"), F.col("id").alias("_row"))
    hits = rows.where("doc_id % 50 = 0").select("_file", "_row")
    got = {r.doc_id for r in exact_dedup.filtered(rows, hits, words=1 << 10).collect()}
    assert {i for i in range(0, 5000, 50)} <= got and len(got) < 150
    assert exact_dedup.filtered(rows, hits, words=1).count() >= 100 and exact_dedup.filtered(rows, hits.limit(0)).count() == 0


def test_exact_stream_goes_on(spark, tmp_path):
    """State is kept: what arrives later meets what came before."""
    table, at = str(tmp_path / "digests"), str(tmp_path / "checkpoint")
    make = lambda ids: spark.createDataFrame([(i, 1, i, bytes([i % 3])) for i in ids], "doc_id long, _file long, _row long, digest binary")
    make(range(5, 9)).write.parquet(table)
    exact_dedup.run_stream(spark, table, at).count()
    make(range(0, 4)).write.mode("append").parquet(table)
    got = {r.digest[0]: (r["first"].id, r.n) for r in exact_dedup.run_stream(spark, table, at).collect()}
    ids = [*range(5, 9), *range(0, 4)]
    assert got == {k: (min(i for i in ids if i % 3 == k), sum(i % 3 == k for i in ids)) for k in range(3)}


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    where = defaultdict(set)
    for n, text in enumerate(rows):
        for x in text.split("\n"):
            where[key(x)].add(n)
    out = []
    for text in rows:
        lines = text.split("\n")
        keep = [x for x in lines if not key(x) or len(where[key(x)]) < least]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize("window", [1, 3000, 1 << 25])
def test_lines(spark, tmp_path, window):
    rng = random.Random(3)
    pool = [f"Line {i}" for i in range(30)] + ["", " ", "É", "é", "HOT\t", " hot"]
    texts = ["\n".join(rng.choices(pool, weights=[1] * 34 + [40, 40], k=rng.randint(1, 30))) for _ in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = brute_lines(texts, 40)
    got = by_id(line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 40, window=window)))
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in got] == want


def test_lines_keep_first(spark, tmp_path):
    texts = ["a\nb\na", "b\nc", "a\nd\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = by_id(line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "d")), keep_first=True))
    assert [r["text"] for r in got] == ["a\nb", "c", "d\n"]


def test_lines_odd(odd, none):
    got = by_id(line_dedup.dedup_lines(odd, min_docs=2, text=True))
    want = brute_lines([t or "" for _, t, _, _ in ROWS], 2)
    assert sorted((r["n_lines"], r["n_dropped"], r["text"]) for r in got) == sorted(want)
    assert line_dedup.dedup_lines(none).count() == 0
    assert by_id(line_dedup.dedup_lines(odd.where("doc_id > 8").withColumn("text", F.upper("text")), min_docs=2))  # not straight from a file


def all_pairs(texts, s):
    """Links and classes by comparing all pairs, with exact document frequencies."""
    sets = [near_dedup.shingles(t, s.words) for t in texts]
    n = sum(len(h) > 0 for h, _ in sets)
    df = Counter(int(x) for h, _ in sets for x in h)
    idf = {x: np.float32(1 + np.log((near_dedup.RARE + n) / (near_dedup.RARE + k)) / np.log(near_dedup.RARE + 1 + n)) for x, k in df.items()}
    w = [(h, counts.astype(np.float32) * np.array([idf[int(x)] for x in h], np.float32)) for h, counts in sets]
    parent, links = list(range(len(texts))), []

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    some = [i for i, x in enumerate(w) if len(x[0])]
    elements = [(np.repeat(h, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.repeat(np.array([idf[int(x)] for x in h], np.float32), c)) for h, c in sets]
    for i, j in near_dedup.similar_between([elements[i] for i in some], [elements[i] for i in some], s.similar).tolist():
        i, j = some[i], some[j]
        if i < j:
            links.append((i, j))
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return links, [top(i) for i in range(len(texts))]


def brute_near(texts, s):
    return all_pairs(texts, s)[1]


def test_near(spark, tmp_path):
    """Copies of a few texts with more and more words changed, so that many pairs lie about the limit."""
    rng, s = random.Random(5), near_dedup.Settings(table_bits=10)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts.append(" ".join(base))
        for k in range(12):
            own = list(base)
            for _ in range(k % 5):
                own[rng.randrange(120)] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = by_id(near_dedup.near_dedup(spark.read.parquet(str(tmp_path / "d")), s))
    want = brute_near(texts, s)
    assert [r["class_id"] for r in got] == want
    assert [r["kept"] for r in got] == [i == c for i, c in enumerate(want)] and [r["class_size"] for r in got] == [Counter(want)[c] for c in want]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_near_links_in_a_bucket(spark, rounds):
    """One bucket of a hub and its copies, of a chain, and of texts that are like none: links are those of all pairs."""
    rng, s = random.Random(8), near_dedup.Settings(rounds=rounds)
    base = [f"b{i}" for i in range(100)]
    texts = [base]
    for k in range(8):  # each like the hub, not like each other
        texts.append([f"c{k}_{i}" if i in range(6 + k * 11, 9 + k * 11) else w for i, w in enumerate(base)])
    chain = [f"d{i}" for i in range(100)]
    for k in range(5):
        texts.append([f"e{i}" if i < k * 4 else w for i, w in enumerate(chain)])
    texts += [[f"f{k}_{i}" for i in range(50)] for k in range(4)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    table = near_dedup.Frequencies(np.zeros(3 << 8, np.float32), 1, 8)  # every weight is 1
    assert (table.idf(np.arange(9, dtype=np.uint64)) == 1).all()
    members = spark.createDataFrame([(1, i) for i in range(len(texts))], "key long, node long")
    stored = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = near_dedup._linked(spark, members, stored, spark.sparkContext.broadcast(table), s)
    got = {r.node: r.label for r in found.labels.collect()}
    w = [(h, n.astype(float)) for h, n in (near_dedup.shingles(t, 5) for t in texts)]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if near_dedup.weighted_jaccard(w[i], w[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    assert {i: got.get(i, i) for i in range(len(texts))} == {i: top(i) for i in range(len(texts))}


@pytest.mark.parametrize("n", [300, 1500])
def test_near_recall_at_two_sizes(spark, tmp_path, n):
    """Against all pairs: texts that share a passage, copies with few to many words changed, one large group that holds a third."""
    rng, s = random.Random(n), near_dedup.Settings()
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    hot = [word() for _ in range(150)]
    texts = []
    while len(texts) < n:
        if len(texts) % 3 == 0:
            base = hot
        elif rng.random() < 0.5 and texts:
            base = rng.choice(texts).split()
        else:
            base = [word() for _ in range(rng.randint(5, 200))] + passage * (rng.random() < 0.3)
        changed = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 20))):
            changed[rng.randrange(len(base))] = word()
        texts.append(" ".join(changed))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.read.parquet(str(tmp_path / "d")), s).collect()}
    links, classes = all_pairs(texts, s)
    found = sum(got[i] == got[j] for i, j in links)
    assert links and found >= 0.98 * len(links), (found, len(links))
    # nothing is joined that all pairs leave apart
    assert all(classes[i] == classes[c] for i, c in got.items())


def test_frequencies_keep_rare_and_frequent_apart():
    """Estimates of a table much smaller than the number of shingles, beside some that most documents have."""
    rng, bits = np.random.default_rng(2), 14
    rare, often = rng.integers(0, 1 << 63, 400_000, np.uint64), rng.integers(0, 1 << 63, 50, np.uint64)
    counts, n = np.zeros(3 << bits), 100_000
    np.add.at(counts, *near_dedup.counters(rare, bits))
    at, sign = near_dedup.counters(often, bits)
    np.add.at(counts, at, sign * 50_000.0)
    table = near_dedup.Frequencies(counts, n, bits)
    error = np.abs(table.documents(rare) - 1)
    assert np.quantile(error, 0.99) < 20 and (np.abs(table.documents(often) - 50_000) < 50).all()
    assert np.median(table.idf(rare)) > 1.7 and table.idf(often).max() < 1.07


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(25)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {i: top(i) for a, b in edges for i in (a, b) if a != b}


def test_near_odd(odd, none):
    got = by_id(near_dedup.near_dedup(odd))
    assert [(r["doc_id"], r["class_id"], r["class_size"]) for r in got] == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 2), (7, 6, 2), (9, 9, 2), (9, 9, 2), (10, 10, 1), (11, 11, 1), (12, 12, 1), (None, None, 1)]
    assert near_dedup.near_dedup(none).count() == 0
    kept = near_dedup.deduplicated(odd)
    assert kept.count() == 9 and kept.columns == odd.columns


def brute_mixture(rows, s):
    totals = Counter()
    for src, n in rows:
        totals[src] += n
    total = sum(totals.values())
    return totals, total


def test_mixing(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else "small"), " ".join(["w"] * rng.randint(0, 60))) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    s = mixing.Settings(entropy=0.98, block_tokens=300)
    counted = mixing.counted(docs)
    plan = {r.source: r for r in mixing.weigh(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), s).collect()}
    totals, total = brute_mixture([(src, len(t.split())) for _, src, t in rows], s)
    assert {k: r.tokens for k, r in plan.items()} == dict(totals)
    p = np.array([r.weight for r in plan.values()])
    assert p.sum() == pytest.approx(1) and -(p * np.log(p)).sum() == pytest.approx(0.98 * np.log(3), abs=1e-5)
    exponents = [np.log(plan["big"].weight / plan[k].weight) / np.log(totals["big"] / totals[k]) for k in ("mid", "small") if totals[k] != totals["big"]]
    assert exponents == pytest.approx([exponents[0]] * len(exponents)) and 0 < exponents[0] < 1
    got = mixing.picks(counted, s).collect()
    assert all(0 <= r.position < 1 for r in got)
    epochs, tokens = Counter((r.doc_id, r.epoch) for r in got), Counter()
    assert max(epochs.values()) == 1
    for r in got:
        tokens[r.source] += r.n_tokens
    for k, r in plan.items():
        assert r.quota - 60 <= tokens[k] <= r.quota + 1e-6
        whole = int(r.quota // r.tokens)
        ids = [i for i, src, _ in rows if src == k]
        assert all((i, e) in epochs for i in ids for e in range(whole)) and all(e <= whole for i, e in epochs if i in set(ids))
    again = mixing.mixed(docs, s)
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in got) and again.columns == docs.columns


@pytest.mark.parametrize("repeats", [1.5, 3.0])
def test_mixing_holds_the_repeat_limit(spark, repeats):
    totals = spark.createDataFrame([("a", 10_000), ("b", 500), ("c", 10), (None, 40), ("none", 0)], "source string, tokens long")
    rows = mixing.weigh(totals, mixing.Settings(entropy=1.0, repeats=repeats)).collect()
    most = max(r.quota / r.tokens for r in rows if r.tokens)
    assert most <= repeats * 1.0001 and most > repeats * 0.999 and sum(r.quota for r in rows) == pytest.approx(10_550)
    with pytest.raises(ValueError):
        mixing.weigh(totals, mixing.Settings(budget=10**6)).collect()


def test_mixing_odd(odd, none):
    got = mixing.mixture(odd, mixing.Settings(repeats=50)).collect()
    assert {r.source for r in got} <= {"a", "b", None} and mixing.mixture(none).count() == 0
    natural = mixing.mixture(odd, mixing.Settings(entropy=0.0, block_tokens=1 << 30)).collect()
    assert len(natural) == len(ROWS)  # at the corpus's own shares everything comes once


def test_bpe(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), e.ids, library.decode(e.ids, skip_special_tokens=False)) for i, t, _, _ in ROWS for e in [library.encode(t or "", add_special_tokens=False)])
    got = bpe.encode(odd, PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    short = bpe.encode(odd, PATH, ids=False, decoded=False).collect()
    assert sorted(r.ids_sha256 for r in short) == sorted(hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for _, x, _ in want)
    assert sorted(r.text for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()) == sorted(d for _, _, d in want)
    assert bpe.encode(none, PATH).count() == 0


def test_media(odd, none):
    got = by_id(media.audio(odd, digests=True))
    for r, (_, text, _, _) in zip(got, sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        data = (text or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 or (64 if not data else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(payload) + 44
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values()) and media.audio(none).count() == 0
    full = media.audio(odd.where("doc_id = 9")).first()
    assert media.read_wav(bytes(full.media))[1].startswith(b"der Hund") and media.from_ipc(bytes(full.tensor_ipc)).num_rows >= 1


def test_language(odd, none, spark):
    rows = [(i, f"{a} the and of with {i % 7} that was", "en") if i % 2 else (i, f"{a} der und das nicht {i % 7} ist auch", "de") for i, a in enumerate(["x", "y", "z"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in by_id(langid.predict(odd, model, keep=("source",)))}
    assert {(4, "und", True), (5, "und", True), (10, "und", True), (11, "und", True)} <= got
    assert (12, "de") in {g[:2] for g in got}
    assert all(0 <= r.score <= 1 for r in langid.predict(odd, model).collect()) and langid.predict(none, model).count() == 0
    assert {tuple(r)[1:] for r in langid.predict(odd, langid.train(none)).collect()} == {("und", 0.0, True)}


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (9, 0), (9, 0), (None, 1), (77, 1), (12, None), (11, 3)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model, keep=("lang",)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.train(none, labels)).count() == len(ROWS)


def test_toxicity_leaves_out_contradictions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, w, s: seen.extend(zip(texts, y, w, strict=True)))
    toxicity.train(docs, labels)
    assert sorted(seen) == [("text 0", 1, 1.0), ("text 2", 0, 1.0), ("text 3", 1, 1.0)]


def test_scans(odd, none):
    forest = secrets.train(secrets.Settings(findings=200, trees=5))
    for got in (licenses.scan_documents(odd), secrets.scan_documents(odd, forest)):
        assert got.count() == len(ROWS)
    assert licenses.scan_documents(none).count() == 0 and secrets.scan_documents(none, forest).count() == 0
    assert len(LONG) > 900_000


def test_language_sample_has_rare_languages(spark):
    assert langid.quotas({"a": 10_000, "b": 5, "c": 10_000}, 105) == {"b": 5, "a": 50, "c": 50}
    assert langid.quotas({"a": 3, "b": 3}, 1) == {"a": 1, "b": 1}
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.expr("CASE WHEN id % 8000 = 7 THEN 'rare' WHEN id % 2 = 0 THEN 'x' ELSE 'y' END").alias("lang"))
    got = langid.sampled(rows, 1000).toPandas()
    assert got["lang"].value_counts().to_dict() == {"x": 498, "y": 497, "rare": 5} and got["doc_id"].is_unique
