"""Secret scans with a random forest that removes false positives.

Candidates are found by pattern: known key formats, values assigned to a word such as token or password,
and long strings that mix letters and digits. A random forest then decides from a candidate's length, its
character transitions, how much of it is made of dictionary words, whether it is part of a path or URL and
where the document comes from, and the words around it. The forest is grown in numpy from labelled
findings. No table of such findings exists here, so ``labelled_findings`` makes them by rule
from a seed: secrets of many formats, and look-alikes (commit and content hashes, identifiers, UUIDs,
paths, placeholders, encoded images, long words).
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, text_of

#: Public formats of keys and tokens.
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=]|\s|\\[nr])*+-----END [A-Z ]*PRIVATE KEY-----)?",
    "assigned": r"(?i:\b[\w-]{0,32}(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?[\"']?\s{0,3}(?::=|=>|is:|[:=])\s{0,3}[\"']?)(?P<value>[^\s\"'<>,;]{8,}+)",
    "mixed": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+",
}
NAMED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items() if k != "mixed"))
MIXED = re.compile(FORMATS["mixed"])
#: A piece of a mixed run, which has no look-behind, as its neighbour is part of another candidate.
PIECE = re.compile(FORMATS["mixed"].removeprefix("(?<![A-Za-z0-9+/_=-])"))
#: Parts of everyday identifiers, of placeholders and of prose.
DICTIONARY = tuple(
    "access account action address admin after alpha array backup base before beta block bridge browser buffer build button cache call change channel class click client cloud code color column command comment common complete config connect content context control copy count create current custom data date debug default delete demo detail device dialog display document domain driver dummy email enable engine entity error event example export factory false field file filter final first folder font form format frame from function gateway global graph group handler hash header height hello helper hidden home host http image import index info input insert instance integer internal item java join json label language layer layout length level library line link list load local login logic long main manager map master member memory message method model module mouse name network node null number object option order output package page param parse password path pattern payload plugin point policy port prefix print private process profile project property provider proxy public query queue random range record region release remote render replace report request resource response result return role root route sample schema screen search secret select sender server service session setting shared short simple size sleep source state static status storage store stream string style submit switch system table target template test text thread time title token tool total trace tree true type unit update upload user utils value variable version view warning width window with word work world write your".split()
)
#: Words beside secrets, and beside what only looks like one.
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api auth authorization bearer credential credentials access private login".split())
HARMLESS_WORDS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid guid id example sample test dummy placeholder image data src href url path version revision etag integrity session trace build blob tree parent".split())
HARMLESS_SOURCE = re.compile(r"test|example|fixture|sample|doc|mock|demo", re.I)
WORD = re.compile(r"[A-Za-z]+\d*")
#: What expressions of a program look like: names joined by dots, calls, subscripts, variables.
CODE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*[(\[]|[A-Za-z_]\w*\.[A-Za-z_]\w*|\$\{|\$\(|\{\{|<[a-z]|%\(")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
FEATURES = ("length", "entropy", "distinct", "digits", "capitals", "signs", "class_changes", "letter_surprise", "vowels", "longest_run", "hex", "dictionary", "in_path", "slashes", "dots_near", "source_harmless", "secret_before", "secret_near", "harmless_before", "harmless_near", "assigned", "quoted", "known_format", "code", "uuid")


@dataclass(frozen=True)
class Settings:
    """findings: labelled findings that the forest is grown from. near: characters on either side that count as neighbourhood."""

    findings: int = 6000
    trees: int = 40
    depth: int = 9
    least_rows: int = 4
    near: int = 48
    threshold: float = 0.5
    seed: int = 5


@lru_cache(maxsize=1)
def _bigrams() -> np.ndarray:
    """Log probabilities of a letter after a letter in dictionary words."""
    n = np.full((26, 26), 0.5)
    for w in DICTIONARY:
        for a, b in zip(w, w[1:], strict=False):
            n[ord(a) - 97, ord(b) - 97] += 1
    return np.log(n / n.sum(axis=1, keepdims=True))


@lru_cache(maxsize=1)
def _dictionary() -> re.Pattern:
    return re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, kind: str, before: str, after: str, source: str) -> list[float]:
    """Features of a candidate, in the order of FEATURES. before and after: the text around it."""
    n = max(1, len(value))
    counts = {c: value.count(c) for c in set(value)}
    kinds = [_kind(c) for c in value]
    low = value.lower()
    pairs = [(ord(a) - 97, ord(b) - 97) for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    surprise = -float(np.mean([_bigrams()[p] for p in pairs])) if pairs else 5.0
    covered = sum(len(m) for m in _dictionary().findall(low))
    run = max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=0)
    words_before, words_after = [w.lower() for w in WORD.findall(before)], [w.lower() for w in WORD.findall(after)]
    last, near = set(words_before[-2:]), set(words_before + words_after)
    glued = before[-1:] or " "
    return [
        math.log(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        surprise,
        sum(c in "aeiou" for c in low) / n,
        run / n,
        float(all(c in "0123456789abcdef-" for c in low)),
        covered / n,
        float("://" in before[-12:] or "/" in before[-2:] or "\\" in glued or after[:1] == "/" or bool(re.match(r"\.\w{2,4}\b", after))),
        (value.count("/") + value.count("-") + value.count("_")) / n,
        (before.count(".") + after.count(".")) / 10,
        float(bool(HARMLESS_SOURCE.search(source))),
        float(bool(last & SECRET_WORDS)),
        len(near & SECRET_WORDS),
        float(bool(last & HARMLESS_WORDS)),
        len(near & HARMLESS_WORDS),
        float(kind == "assigned" or bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(glued in "\"'`"),
        float(kind not in ("assigned", "mixed")),
        float(kind in ("assigned", "mixed") and bool(CODE.match(value + after[:1]))),
        float(bool(UUID.fullmatch(value))),
    ]


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each candidate's value, by place; they don't overlap.

    Runs and values are taken whole, however long. A run of mixed characters that holds a known format or an
    assignment is cut there, so that a long run hides none.
    """
    named, out, i = [], [], 0
    for m in NAMED.finditer(text):
        kind = next(k for k in FORMATS if k != "mixed" and m.group(k) is not None)
        named.append(m.span())
        out.append((*m.span("value" if kind == "assigned" else kind), kind))
    for m in MIXED.finditer(text):
        at, end = m.span()
        while i < len(named) and named[i][1] <= at:
            i += 1
        j = i
        while j < len(named) and named[j][0] < end:
            if PIECE.fullmatch(text, at, max(at, named[j][0])):
                out.append((at, named[j][0], "mixed"))
            at = max(at, named[j][1])
            j += 1
        if at == m.start() or at < end and PIECE.fullmatch(text, at, end):
            out.append((at, end, "mixed"))
    for a, b, kind in sorted(out):
        yield kind, a, b


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, str, str, int]]:
    """(text, start, end, kind, source, label) by rule: half secrets, half look-alikes."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    prose = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) if r.random() < 0.4 else r.choice(DICTIONARY) for _ in range(r.randint(2, 7)))
    out = []
    for i in range(n):
        good = i % 2 == 0
        source = r.choice(["src/app", "config", "web", "forum", "lib"] if good or r.random() < 0.7 else ["tests/data", "examples", "docs"])
        if good:
            value = r.choice([lambda: pick(hexa, r.choice([32, 40, 48, 64])), lambda: pick(b62, r.randint(20, 64)), lambda: pick(b64, r.randint(24, 60)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(b62, 36), lambda: "sk_live_" + pick(b62, 24), lambda: "xoxb-" + pick(b62, 24), lambda: f"xox{r.choice('abp')}-{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(b62, 24)}", lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "key-" + pick(string.ascii_lowercase + string.digits, 32), lambda: "AIza" + pick(b62, 35), lambda: pick(b62 + "!#$%&*", r.randint(10, 20)), lambda: f"eyJ{pick(b62, 20)}.{pick(b62, 30)}.{pick(b62, 30)}"])()
            word = r.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_key", "TOKEN", "Secret", "client_secret", "pwd", "API_KEY", "credential", "bearer token"])
            if value.startswith(("AKIA", "ghp_", "sk_", "xox", "AIza", "eyJ")) and r.random() < 0.5:  # formats that are known give themselves away beside any word
                word = r.choice(["SLACK", "google", "aws", "stripe", "HOOK", "value", "use", "bot"])
            line = r.choice([f'{word} = "{value}"', f"{word}={value}", f"{word}: {value}", f"'{word}': '{value}'", f"my {word} is: {value}", f"Authorization: Bearer {value}", f"auth header bearer {value}"])
        else:
            made = r.choice(["commit", "md5", "uuid", "path", "name", "code", "placeholder", "image", "number", "word", "variable"])
            if made in ("commit", "md5"):
                value = pick(hexa, 40 if made == "commit" else r.choice([32, 56, 64, 96, 128]))
                if made == "md5" and r.random() < 0.3:
                    value = r.choice(["sha256-", "sha384-", "sha512-"]) + pick(b64, r.choice([43, 64, 86]))
                line = r.choice([f"sha512: {value}", f"sha1 {value}", f'script integrity="{value}"', f"commit {value}", f"sha256: {value}", f"md5 checksum {value}", f"revision {value}", f'integrity="{value}"', f"git hash {value} parent", f"etag: {value}"])
            elif made == "uuid":
                value = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
                line = r.choice([f"id: {value}", f"uuid={value}", f"trace {value}", f"session id {value}"])
            elif made == "path":
                value = "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + str(r.randint(1, 99))
                line = r.choice([f"https://host.example/{value}", f"path: /{value}", f'src="/{value}"', f"token path = {value}"])
            elif made == "name":
                value = "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + str(r.randint(0, 9))
                line = r.choice([f"call {value} now", f"{value}(", f"token = {value}", f"secret: {value}"])
            elif made == "code":
                a, b, c = (r.choice(DICTIONARY) for _ in range(3))
                value = r.choice([f"{a}.{b}['{c.upper()}_{b.upper()}{r.randint(1, 9)}']", f'{a}.{b}["{c}{r.randint(1, 9)}"]', f"{a[:2]}.{b}['{c.upper()}']", f"{a}.get_{b}{r.randint(1, 9)}({c})", f"{a}.{b}.{c}_{r.randint(1, 99)}", f"${{{a.upper()}_{b.upper()}_{c.upper()}_{r.randint(1, 9)}}}", f"{{{{{a}_{b}_{c}{r.randint(1, 9)}}}}}", f"{a}{b.title()}({c}_{r.randint(10, 99)})"])
                line = r.choice([f"token = {value}", f"secret := {value}", f"password={value}", f"api_key: {value}", f"credentials = {value}"])
                value = re.split(r"[\s\"'<>,;]", value)[0]
            elif made == "placeholder":
                value = r.choice(["YOUR_API_KEY_HERE_1234", "YOUR_TOKEN_GOES_HERE_1", "INSERT_SECRET_HERE_00", "MY_PASSWORD_VALUE_1", "REPLACE_WITH_KEY_2", "<your-secret-here-1>", "your_token_here_123", "xxxxxxxxxxxxxxxxxxxx1", "changeme12345678", "example_password_1", "EXAMPLEKEY" + "0" * 12, "<insert-token-0000>", "password12345678", "${SECRET_TOKEN_1}", "00000000000000000000a", "1234567890abcdefghij"]) + pick("0x", r.randint(0, 3))
                line = r.choice([f'token = "{value}"', f"password: {value}", f"example {value}", f"api_key={value}"])
            elif made == "image":
                value = "iVBORw0KGgo" + pick(b64, r.randint(30, 120))
                line = r.choice([f"data:image/png;base64,{value}", f"image src data {value}"])
            elif made == "number":
                value = f"{r.randint(10**15, 10**16)}" + r.choice(["", "a", "x-"]) + pick(string.digits, 6)
                line = r.choice([f"order {value}", f"phone id {value}", f"build {value}"])
            elif made == "word":
                value = "".join(r.choice(DICTIONARY) for _ in range(4)) + r.choice(["", "2", "42"])
                line = f"{prose()} {value} {prose()}"
            else:
                value = r.choice(["get", "set", "make"]) + "".join(r.choice(DICTIONARY).title() for _ in range(4)) + str(r.randint(1, 9))
                line = r.choice([f"{value}()", f"password = {value}", f"token: {value},"])
        text = f"{prose()}{r.choice([' ', chr(10), '. '])}{line}{r.choice([' ', chr(10), '. '])}{prose()}"
        at = text.index(value)
        found = next(((k, a, b) for k, a, b in candidates(text) if a < at + len(value) and at < b), ("mixed", at, at + len(value)))
        out.append((text, found[1], found[2], found[0], source, int(good)))
    return out


def _features_at(text: str, a: int, b: int, kind: str, source: str, near: int) -> list[float]:
    return features(text[a:b], kind, text[max(0, a - near) : a], text[b : b + near], source)


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), threshold, left, right, share

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while (inner := feature[at] >= 0).any():
                go = x[rows, np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, np.where(go, right[at], left[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, s: Settings) -> Forest:
    """Bootstrap rows, a random third of the features at each node, Gini gain."""
    rng, trees = np.random.default_rng(s.seed), []
    for _ in range(s.trees):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            at, own, depth = todo.pop()
            yy = y[own]
            p = yy.mean()
            nodes[at][4] = float(p)
            if depth >= s.depth or len(own) < 2 * s.least_rows or p in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
                order = np.argsort(x[own, f], kind="stable")
                v, c = x[own, f][order], np.cumsum(yy[order])
                k = np.arange(1, len(own))
                l, r = c[:-1], c[-1] - c[:-1]
                gini = l * (k - l) / k + r * (len(own) - k - r) / (len(own) - k)
                gini[(v[1:] == v[:-1]) | (k < s.least_rows) | (len(own) - k < s.least_rows)] = np.inf
                j = int(gini.argmin())
                gain = p * (1 - p) * len(own) - gini[j]
                if gain > best[0]:
                    best = (gain, int(f), float((v[j] + v[j + 1]) / 2))
            if best[1] < 0:
                continue
            right = x[own, best[1]] > best[2]
            nodes[at][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            todo += [(nodes[at][2], own[~right], depth + 1), (nodes[at][3], own[right], depth + 1)]
        trees.append(tuple(np.array([n[i] for n in nodes], t) for i, t in enumerate((np.int64, float, np.int64, np.int64, float))))
    return Forest(trees)


def train(s: Settings = Settings(), findings: list | None = None) -> Forest:  # noqa: B008
    """Grow the forest from labelled findings: those given, or the made ones."""
    rows = labelled_findings(s.findings, s.seed) if findings is None else findings
    x = np.array([_features_at(t, a, b, kind, source, s.near) for t, a, b, kind, source, _ in rows])
    return grow(x, np.array([r[5] for r in rows], float), s)


RESULT = "doc_id long, n_candidates int, n_secrets int, secrets array<struct<kind: string, start: int, end: int, score: double>>"


def scan_documents(docs: DataFrame, forest: Forest, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Secrets of every whole text.

    Returns doc_id, n_candidates, n_secrets and secrets (kind, start and end in characters, score: the
    forest's vote), one row for each row of ``docs``. Null and empty texts have none; a null source counts as empty.
    Null doc_ids and repeated rows stay as they are; columns but doc_id, text and source are not read; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, x = [], []
            for i, (text, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for kind, a, b in candidates(text):
                    where.append((i, kind, a, b))
                    x.append(_features_at(text, a, b, kind, source, s.near))
            p = shared.value.predict(np.array(x)) if x else []
            found, tried = [[] for _ in range(batch.num_rows)], [0] * batch.num_rows
            for (i, kind, a, b), v in zip(where, p, strict=True):
                tried[i] += 1
                if v >= s.threshold:
                    found[i].append({"kind": kind, "start": a, "end": b, "score": round(float(v), 6)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tried, pa.int32()), pa.array([len(f) for f in found], pa.int32()), pa.array(found, kind_of)], names=["doc_id", "n_candidates", "n_secrets", "secrets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.transform(arrow_map, run, RESULT)
