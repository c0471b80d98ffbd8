"""The registered queries and the pipeline, on the smallest tables: columns, what is learned from, and brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tesserae.llm import langid, media, mixing, near_dedup, queries
from tests.llm.test_operators import all_pairs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_mixing": ["doc_id", "source", "n_tokens", "epoch", "block", "position"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_licenses": ["doc_id", "licenses", "n_findings", "findings"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_near_dedup": ["doc_id", "class_id", "class_size", "kept"],
    "op9_secrets": ["doc_id", "n_candidates", "n_secrets", "secrets"],
    "op10_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", COLUMNS)
def test_queries(spark, documents, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    ids = [r[0] for r in got.select("doc_id").collect()]
    if name == "op2_mixing":
        assert set(ids) <= {d["doc_id"] for d in documents}
    else:
        assert sorted(ids) == sorted(d["doc_id"] for d in documents)


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op10_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_bpe_query(spark, documents, library):
    got = {r.doc_id: r for r in queries.QUERIES["op7_bpe"](spark, SF).collect()}
    for d in documents:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want = (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (want[0], *(hashlib.sha256(x.encode()).hexdigest() for x in want[1:]))


def test_media_query(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op6_media"](spark, SF).collect()}
    for d in documents:
        data = (d["text"] or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.payload_of(data) == payload and len(r.media_sha256) == 64 and r.feature


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def changed(tmp_path, name, change):
    """A copy of the tables, one of them changed."""
    for t in ("documents", "labels"):
        table = pq.read_table(f"{SF}/{t}.parquet")
        pq.write_table(pa.Table.from_pylist([change(dict(r)) for r in table.to_pylist()], table.schema) if t == name else table, tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_language_learns_from_nothing_held_out(spark, documents, tmp_path):
    """Languages of held-out rows may be anything, and sources and all of a row's own labels play no part in its prediction."""
    query = queries.QUERIES["op1_language_id"]
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert all(r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    other = changed(tmp_path, "documents", lambda r: r | {"source": "x"} | ({"lang": "xx"} if remainder(r["doc_id"], 4) == 2 else {}))
    again = {r.doc_id: r for r in query(spark, other).collect()}
    assert {i: (r.lang_pred, round(r.score, 9), r.rejected) for i, r in got.items()} == {i: (r.lang_pred, round(r.score, 9), r.rejected) for i, r in again.items()}
    right = [got[d["doc_id"]].lang_pred == d["lang"] for d in documents if got[d["doc_id"]].held_out and d["lang"]]
    assert len(right) > 30 and np.mean(right) > 0.95 and not any(r.rejected for r in got.values() if r.lang_pred != "und")


def test_toxicity_learns_from_nothing_held_out(spark, tmp_path):
    query = queries.QUERIES["op3_toxicity"]
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert all(r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    other = changed(tmp_path, "labels", lambda r: r | ({"toxic": 1 - (r["toxic"] or 0)} if remainder(r["doc_id"], 5) == 0 else {}))
    again = {r.doc_id: round(r.score, 9) for r in query(spark, other).collect()}
    assert {i: round(r.score, 9) for i, r in got.items()} == again


def white(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_pipeline_stage_by_stage(spark, documents, library):
    """Each stage against brute force on all that the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: [r.asDict() for r in df.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    keep = lambda df, name: corpus_pipeline.stored(df, name)

    # language ID: the model that the same rows give, text by text
    own = [d for d in documents if remainder(d["doc_id"], 4) != 2 and d["text"] is not None and d["lang"] is not None]
    train = langid.sampled(docs.where(~langid.held_out()).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"), 4000).toPandas()
    assert sorted(train["doc_id"]) == sorted(d["doc_id"] for d in own)
    model = langid.fit(train["text"].tolist(), train["lang"].tolist())

    def stays(text):
        if not text or not langid.LETTER.search(text):
            return False
        z, mean, n = langid.class_scores([langid.letters(text)], model)
        e = np.exp(z[0].astype(float) / model.temperature - (z[0].astype(float) / model.temperature).max())
        return (e / e.sum()).max() >= model.least_probability and model.typical(mean, n)[0] >= model.least_typical

    one = keep(stage["language_id"](spark, docs, SF), "t1")
    assert sorted(r["doc_id"] for r in rows(one)) == sorted(d["doc_id"] for d in documents if stays(d["text"])) and one.columns == docs.columns

    two = keep(stage["exact_dedup"](spark, one, SF), "t2")
    first: dict = {}
    for r in sorted(rows(one), key=lambda r: r["doc_id"]):
        first.setdefault(white(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(two)) == sorted(first.values()) and len(first) < len(documents)

    three = keep(stage["near_dedup"](spark, two, SF), "t3")
    left = sorted(rows(two), key=lambda r: r["doc_id"])
    classes = all_pairs([r["text"] for r in left], near_dedup.Settings())[1]
    assert sorted(r["doc_id"] for r in rows(three)) == sorted(left[i]["doc_id"] for i in set(classes)) and len(set(classes)) < len(left)

    four = keep(stage["mixing"](spark, three, SF), "t4")
    s = mixing.Settings()
    before, after = rows(three), rows(four)
    total, n, mixed, longest = Counter(), Counter(), Counter(), Counter()
    for r in before:
        k = len(r["text"].split())
        total[r["source"]] += k
        longest[r["source"]] = max(longest[r["source"]], k)
    for r in after:
        n[r["doc_id"]] += 1
        mixed[r["source"]] += len(r["text"].split())
    p = np.array(list(total.values())) / sum(total.values())
    weigh = lambda a: p**a / (p**a).sum()
    entropy = lambda q: -(q * np.log(q)).sum()
    low, high = 0.0, 1.0  # bisection, as the operator's own sectioning
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weigh(mid)) >= s.entropy * np.log(len(p)) else (low, mid)
    a = 1.0 if entropy(p) >= s.entropy * np.log(len(p)) else low
    for source, q in zip(total, weigh(a), strict=True):
        quota = q * sum(total.values())
        assert quota - longest[source] - 1 <= mixed[source] <= quota + 1e-3 * quota + 1, source
    texts = {r["doc_id"]: r["text"] for r in before}
    assert set(n) <= set(texts) and all(r["text"] == texts[r["doc_id"]] for r in after)
    per = {}
    for r in before:
        per.setdefault(r["source"], []).append(n[r["doc_id"]])
    assert all(max(v) - min(v) <= 1 for v in per.values())  # whole epochs and a part of one more

    five = rows(stage["bpe"](spark, four, SF))
    assert Counter(r["doc_id"] for r in five) == n
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in five)


def test_pipeline_on_odd_input(spark, tmp_path, odd):
    """Nulls, empty texts, repeated rows, columns of clashing names; and no rows at all."""
    for name, table in (("odd", odd), ("none", odd.where("doc_id > 1000"))):
        at = str(tmp_path / name)
        table.write.parquet(f"{at}/documents.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert bool(got) == (name == "odd") and all(r.n_tokens == len(r.ids) for r in got)
        assert {r.doc_id for r in got} <= {r.doc_id for r in odd.collect()}
