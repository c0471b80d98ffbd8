"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton whose arcs are labelled with tokens and whose
paths are exactly the right tokenizations. Construction starts from one state with an arc for every
base symbol; each merge (a, b), in order of priority, adds a *merge gadget*:

* every state with an arc a followed by an arc b gains an arc ab: the column of arcs labelled ab is a
  copy of the column of a;
* ab leads where b led: the row of arcs that leave ab is a copy of the row of b;
* the state after a loses its arc b.

Rows and columns are kept in orders in which a copy is put right after its original, so what a deleted
arc takes with it in later copies is a rectangle: the rows from a to a's successor at the time of the
deletion, the columns from b to b's. After the last gadget the rectangles are laid out as a *transition
table*: for each state the sorted borders of the ranges of labels that have no arc. Tokens with equal rows
lead to one state. A vocabulary of 49,000 tokens has 11,537 states and 4 MB of table.

A pre-split word is encoded by driving its symbols through a second table (the vocabulary's tokens by
suffix: for each symbol the state that the longest suffix of what was read leads to). For every prefix there is exactly
one token that a path to it ends with; it is found by looking up the arcs of the tokens that end there.
All new words of a block take a step at a time, so the look-ups are array operations. Long words take
the same steps by themselves. Decoding emits the labels of the arcs.

Normalisation and pre-splitting are those that the tokenizer file names, done by its library.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, text_of

#: White space as Unicode defines it, which is not quite Python's.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that str.split() takes for white space and Unicode does not.
NOT_WHITE = re.compile("[\x1c-\x1f]")
#: Bytes of chunks and their encodings that a task remembers before it forgets them all; characters of text that are split at a time.
REMEMBERED, BLOCK = 24 << 20, 1 << 20
#: Symbols beyond which a word is run by itself.
LONG = 256


class MergeAutomaton:
    """Deterministic automaton over tokens 0..n-1, built from base tokens and merges (a, b, ab) in order of priority."""

    def __init__(self, n: int, base: list[int], merges: list[tuple[int, int, int]]):
        if len({*base, *(c for _, _, c in merges)}) != len(base) + len(merges):
            raise ValueError("two merges make one token")
        self.end = n
        self.row_after, self.column_after = [n] * (n + 1), [n] * (n + 1)
        for x, y in zip(base, [*base[1:], n], strict=True):
            self.row_after[x] = self.column_after[x] = y
        self.deleted: list[tuple[int, int, int, int]] = []
        for a, b, ab in merges:
            self.add_gadget(a, b, ab)
        self._lay_out(base[0] if base else n)

    def add_gadget(self, a: int, b: int, ab: int) -> None:
        rows, columns = self.row_after, self.column_after
        rows[ab], rows[b] = rows[b], ab  # leaves as b does
        # the state after a loses b, and so do the copies of its row and of b's column that are yet to come; for
        # a = b, the copy of the row made above keeps its arc, and that of the column made below has none (x x x is xx x)
        self.deleted.append((a, rows[a], b, columns[b]))
        columns[ab], columns[a] = columns[a], ab  # is entered where a is

    def _ranks(self, after: list[int], first: int) -> np.ndarray:
        rank, x, i = np.full(self.end + 1, -1, np.int64), first, 0
        while x != self.end:
            rank[x], i, x = i, i + 1, after[x]
        rank[self.end] = i
        return rank

    def _lay_out(self, first: int) -> None:
        """The transition table: ``borders`` holds state * span + place for each place (a label's rank) where a row's arcs end or begin again."""
        row, self.place = self._ranks(self.row_after, first), self._ranks(self.column_after, first)
        self.span = span = self.end + 2
        d = np.array(self.deleted, np.int64).reshape(-1, 4)
        top, n = row[d[:, 0]], row[d[:, 1]] - row[d[:, 0]]
        at = np.repeat(top - np.cumsum(n) + n, n) + np.arange(n.sum())
        start, stop = at * span + np.repeat(self.place[d[:, 2]], n), at * span + np.repeat(self.place[d[:, 3]], n)
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.maximum.accumulate(stop[order])
        new = np.ones(len(start), bool)
        new[1:] = start[1:] > stop[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
        borders = np.column_stack([start[new], stop[last]]).ravel()
        in_row = (borders - borders // span * span).astype(np.int32)
        cut = np.searchsorted(borders, np.arange(self.end + 1) * span)
        rows: dict[bytes, int] = {b"": 0}  # state 0 is the start, which every label leaves
        self.state = np.zeros(self.end + 1, np.int32)
        for token, r in enumerate(row[:-1].tolist()):
            if r >= 0:  # an added token has no row
                self.state[token] = rows.setdefault(in_row[cut[r] : cut[r + 1]].tobytes(), len(rows))
        self.states = len(rows)
        wide = np.int32 if self.states * span < 2**31 else np.int64
        self.borders = np.concatenate([np.frombuffer(k, np.int32).astype(wide) + wide(i * span) for k, i in rows.items()])
        self.place, self.state = self.place.astype(wide), self.state.astype(wide)
        del self.row_after, self.column_after, self.deleted

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with the label; the arc leads to ``self.state[label]``."""
        return np.searchsorted(self.borders, state * self.borders.dtype.type(self.span) + self.place[label], "right") & 1 == 0

    def has_one(self, state: int, label: int) -> bool:
        return bisect_right(self.borders, int(state) * self.span + int(self.place[label])) % 2 == 0


class Suffixes:
    """The table that symbols drive: after each symbol, the longest suffix of what was read that begins a token, and the tokens that end there."""

    def __init__(self, tokens: list[tuple[str, bool, int]], symbols: dict[str, int]):
        """tokens: symbols, whether the token ends a word, id."""
        k = len(symbols)
        children: list[dict[int, int]] = [{}]
        inner, final = {}, {}
        for text, ends, token in tokens:
            node = 0
            for s in text:
                to = children[node].get(symbols[s])
                if to is None:
                    to = children[node][symbols[s]] = len(children)
                    children.append({})
                node = to
            (final if ends else inner)[node] = (token, len(text))
        n, self.k = len(children), k
        # arcs of the tree by (node, symbol), in order; what a node lacks is looked for at its longest proper suffix, up to the root, which has all
        pairs = sorted((node * k + s, to) for node, own in enumerate(children) for s, to in own.items())
        self.arcs, self.to = np.array([p for p, _ in pairs], np.int32 if n * k < 2**31 else np.int64), np.array([t for _, t in pairs], np.int32)
        fail, level = np.zeros(n, np.int32), [0]
        # the nearest suffix, itself included, that is a token (inner or final) and, for the look-up after that, the suffix to go on from
        self.at = np.full((2, n), -1, np.int32)
        while level:
            following = []
            for node in level:
                f = int(fail[node])
                for kind, own in enumerate((inner, final)):
                    self.at[kind, node] = node if node in own else self.at[kind, f] if node else -1
                for s, to in children[node].items():
                    back = f
                    while node and back and s not in children[back]:
                        back = int(fail[back])
                    fail[to] = children[back].get(s, 0) if node else 0
                    following.append(to)
            level = following
        self.fail = fail
        del children
        self.token, self.length = np.zeros((2, n), np.int32), np.zeros((2, n), np.int32)
        for kind, own in enumerate((inner, final)):
            for node, (token, length) in own.items():
                self.token[kind, node], self.length[kind, node] = token, length


    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after a symbol each."""
        out = np.empty(len(node), np.int32)
        open_ = np.arange(len(node))
        while len(open_):
            at = node * self.arcs.dtype.type(self.k) + symbol
            found = np.minimum(np.searchsorted(self.arcs, at), len(self.arcs) - 1)
            there = self.arcs[found] == at
            out[open_[there]] = self.to[found[there]]
            root = ~there & (node == 0)
            out[open_[root]] = 0
            more = ~there & ~root
            open_, node, symbol = open_[more], self.fail[node[more]], symbol[more]
        return out

    def step_one(self, node: int, symbol: int) -> int:
        while True:
            at = node * self.k + symbol
            found = bisect_left(self.arcs, at)
            if found < len(self.arcs) and self.arcs[found] == at:
                return int(self.to[found])
            if not node:
                return 0
            node = int(self.fail[node])


class WordBpe:
    """A tokenizer file (BPE, with or without word ends) as an automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(path)
        other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or other or spec.get("decoder"):
            raise ValueError(f"not supported in {path}: {other or 'a model other than BPE, or a decoder'}")
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.plain, self.lowers = _plain_split(spec)
        if self.plain:  # held against the library on every pair of printable characters
            pairs = [f"x{chr(a)}{chr(b)}y" for a in range(33, 127) for b in range(33, 127)]
            if [self.plain.findall(x.lower() if self.lowers else x) for x in pairs] != [self.pre_split(x) for x in pairs]:
                self.plain = None
        ids: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.labels = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])], default=0))
        for token, i in [*ids.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.labels[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(re.search(rf"[{WHITE}]", t) for t in self.special) or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not supported in {path}: added tokens with white space or rules of their own")
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.special_head = self.special_at if any(not t for t in self.special) else re.compile("|".join(sorted({re.escape(t[0]) for t in self.special})) or r"(?!)")
        usable = [(t, i) for t, i in ids.items() if t in made or len(t.removesuffix(end) if end else t) == 1]
        self.auto = MergeAutomaton(len(self.labels), [i for t, i in usable if t not in made], [(ids[a], ids[b], ids[a + b]) for a, b in merges])
        cut = [(t.removesuffix(end), True, i) if end and t.endswith(end) and t != end else (t, False, i) for t, i in usable]
        symbols = {s: k for k, s in enumerate(sorted({s for t, _, _ in cut for s in t}))}
        self.suffixes = Suffixes(cut, symbols)
        self.final = 1 if end else 0
        self.column = np.full(max(map(ord, symbols), default=0) + 2, -1, np.int32)  # of a symbol; the last is for those beyond
        for s, k in symbols.items():
            self.column[ord(s)] = k
        self.white = re.compile(f"[{WHITE}]+")
        self.size = np.zeros(len(self.labels), np.int32)
        for kind in (0, 1):
            own = self.suffixes.length[kind] > 0
            self.size[self.suffixes.token[kind][own]] = self.suffixes.length[kind][own]
        self.id_strings = pa.array([str(i) for i in range(len(self.labels))])
        self.label_strings = pa.array(self.labels)

    def pre_split(self, chunk: str) -> list[str]:
        """The words of a chunk without white space and special tokens, in symbols."""
        if self.normalizer is not None:
            chunk = self.normalizer.normalize_str(chunk)
        return [w for w, _ in self.splitter.pre_tokenize_str(chunk)] if self.splitter is not None else [chunk]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-split words, one word after the other, and their number in each: the labels of the one path that reads it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        c = self.column[np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), len(self.column) - 1)]
        if (c < 0).any():  # symbols that the vocabulary lacks give nothing
            ends = np.cumsum(np.append(0, c >= 0))[np.cumsum(sizes)]
            sizes, c = np.diff(ends, prepend=0), c[c >= 0]
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= LONG)]
        paths = [(i, np.array(self._run_one(c[starts[i] : starts[i] + sizes[i]]), np.int32)) for i in np.flatnonzero(sizes > LONG).tolist()]
        counts = np.zeros(len(words), np.int64)
        rounds = self._run(c, starts[order], sizes[order]) if len(order) else []
        for k, _ in rounds:
            counts[order[k]] += 1
        for i, path in paths:
            counts[i] = len(path)
        at = np.cumsum(counts)
        out = np.empty(int(at[-1]) if len(at) else 0, np.int32)
        for i, path in paths:
            out[at[i] - len(path) : at[i]] = path
        for r, (k, token) in enumerate(rounds, 1):  # from the words' ends
            out[at[order[k]] - r] = token
        return out, counts

    def _run(self, columns: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """All words take a step at a time, the longest first. Returns the labels of their paths from the last one backwards: numbers of words, and a label of each."""
        n, longest, x, auto = len(sizes), int(sizes[0]), self.suffixes, self.auto
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # words of so many symbols
        state, last, node = np.full((longest + 1, n), -1, auto.state.dtype), np.zeros((longest + 1, n), np.int32), np.zeros(n, np.int32)
        state[0] = 0
        for i in range(longest):
            m = active[i]
            node = x.step(node[:m], columns[starts[:m] + i])
            open_, ending = np.arange(m), sizes[:m] == i + 1
            at = x.at[0, node] if not self.final else np.where(ending, x.at[1, node], x.at[0, node])
            while len(open_):
                kind = ending[open_] * self.final
                token = x.token[kind, at]
                begin = i + 1 - x.length[kind, at]
                before = state[begin, open_]
                good = begin == 0  # a token that is all of it: the start has every arc
                check = np.flatnonzero(~good & (before >= 0))
                good[check] = auto.has_arc(before[check], token[check])
                state[i + 1, open_[good]], last[i + 1, open_[good]] = auto.state[token[good]], token[good]
                bad = ~good
                open_, at = open_[bad], x.at[kind[bad], x.fail[at[bad]]]
                more = at > 0  # the root is no token
                open_, at = open_[more], at[more]
        rounds, at, open_ = [], sizes.copy(), np.arange(n)
        while len(open_):
            if (state[at, open_] < 0).any():
                raise ValueError("the vocabulary has no path for a word")
            token = last[at, open_]
            rounds.append((open_, token))
            at = at - self.size[token]
            more = at > 0
            open_, at = open_[more], at[more]
        return rounds

    def _run_one(self, word: np.ndarray) -> list[int]:
        """A long word by itself: the same steps."""
        x, auto, n = self.suffixes, self.auto, len(word)
        state, last, size = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        state[0], node = 0, 0
        for i, column in enumerate(word.tolist(), 1):
            node = x.step_one(node, column)
            kind = self.final if i == n else 0
            at = int(x.at[kind, node])
            while at > 0:
                token, length = int(x.token[kind, at]), int(x.length[kind, at])
                before = int(state[i - length])
                if before >= 0 and auto.has_one(before, token):
                    state[i], last[i], size[i] = auto.state[token], token, length
                    break
                at = int(x.at[kind, x.fail[at]])
        path, at = [], n
        while at:
            if state[at] < 0:
                raise ValueError("the vocabulary has no path for a word")
            path.append(int(last[at]))
            at -= int(size[at])
        return path[::-1]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without white space, one run after the other, and their number in each."""
        plain, other = [], []
        for i, chunk in enumerate(chunks):
            (plain if self.plain and chunk.isascii() and chunk.isprintable() and not self.special_head.search(chunk) else other).append(i)
        words: list = []
        if plain:
            joined = "\n".join([chunks[i] for i in plain])
            words = self.plain.findall(joined.lower() if self.lowers else joined)
            words.append("\n")
        for i in other:
            words += self._parts(chunks[i])
            words.append("\n")
        known = Codes()
        known["\n"] = 0
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ids, counts = self.encode_words([w if isinstance(w, str) else "" for w in known.new])
        starts = np.append(0, np.cumsum(counts) - counts)
        counts = np.append(0, counts)
        if special := [(k, w) for k, w in enumerate(known.new, 1) if not isinstance(w, str)]:
            at, number = zip(*special, strict=True)
            starts[list(at)], counts[list(at)] = len(ids) + np.arange(len(at)), 1
            ids = np.append(ids, np.array(number, np.int32))
        end = codes == 0
        out, per_word = gathered(ids, starts[codes], counts[codes]), counts[codes]
        per_chunk = np.bincount(np.cumsum(end) - end, per_word, len(chunks)).astype(np.int64)
        # chunks in the order that they came in
        order = np.array(plain + other, np.int64)
        at = np.empty(len(chunks), np.int64)
        at[order] = np.cumsum(per_chunk) - per_chunk
        n = np.empty(len(chunks), np.int64)
        n[order] = per_chunk
        return gathered(out, at, n), n

    def _parts(self, chunk: str) -> list:
        """Words, and ids of special tokens."""
        own, at = [], 0
        if self.special_head.search(chunk):
            for m in self.special_at.finditer(chunk):
                if m.start() > at:
                    own += self.pre_split(chunk[at : m.start()])
                own.append(self.special[m[0]])
                at = m.end()
        if at < len(chunk):
            own += self.pre_split(chunk[at:] if at else chunk)
        return own

    def split(self, text: str) -> list[str]:
        """Runs without white space."""
        return [c for c in self.white.split(text) if c] if NOT_WHITE.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        return self.encode_chunks(self.split(text))[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined by a space as the file has no decoder; unknown ids give nothing."""
        return " ".join([self.labels[i] for i in ids if 0 <= i < len(self.labels) and self.labels[i]])


def _plain_split(spec: dict) -> tuple[re.Pattern | None, bool]:
    """How a chunk of printable ASCII is split, and whether it is lowered first, if the file's rules leave ASCII alone but for that; None if they do more.

    The file's own pattern, with letters and numbers as ASCII has them; a line break is kept, to tell chunks apart.
    """
    steps = (n := spec.get("normalizer") or {}).get("normalizers", [n] if n else [])
    known = all(x["type"] in ("NFC", "NFD", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"}) for x in steps)
    parts = (p := spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    fits = p.get("type") == "Sequence" and [x["type"] for x in parts] == ["Split", "ByteLevel"] and "Regex" in parts[0]["pattern"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    if not (known and fits):
        return None, False
    pattern = parts[0]["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
    if re.search(r"\\p|\(\?", pattern):
        return None, False
    return re.compile(f"{pattern}|\n", re.ASCII), any(x["type"] == "Lowercase" for x in steps)


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranges of values, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Codes(dict):
    """A number for each key, in order of arrival; ``new`` has those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        code = self[key] = len(self)
        return code


class Encoder:
    """Encodes texts and remembers the chunks it met, up to a number of bytes. New chunks of some texts are encoded together."""

    def __init__(self, bpe: WordBpe, remembered: int = REMEMBERED):
        self.bpe, self.remembered = bpe, remembered
        self._forget()

    def _forget(self) -> None:
        self.codes, self.held = Codes(), 0
        self.ids = np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _windows(self, text: str) -> Iterator[str]:
        """The text, cut at blanks into pieces of about BLOCK characters, as chunks are whole."""
        at = 0
        while at < len(text):
            to = at + BLOCK
            if to < len(text):
                m = self.bpe.white.search(text, to)
                to = m.start() if m else len(text)
            yield text[at:to] if at or to < len(text) else text
            at = to

    def pieces(self, texts: Iterable[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of some texts (in order; a long text comes in several pieces), their ids, one text's after the other, and how many each has."""
        held, size = [], 0
        for row, text in enumerate(texts):
            for window in self._windows(text):
                held.append((row, np.array(list(map(self.codes.__getitem__, self.bpe.split(window))), np.int64)))
                size += len(window)
                if size >= BLOCK:
                    yield self._looked_up(held)
                    held, size = [], 0
        if held:
            yield self._looked_up(held)

    def _looked_up(self, held: list[tuple[int, np.ndarray]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        new, self.codes.new = self.codes.new, []
        if new:
            ids, n = self.bpe.encode_chunks(new)
            self.starts, self.counts = np.append(self.starts, len(self.ids) + np.cumsum(n) - n), np.append(self.counts, n)
            self.ids = np.append(self.ids, ids)
            # a string and a number and their place in the dictionary; ids; start and count
            self.held += sum(map(len, new)) + 200 * len(new) + 4 * len(ids)
        codes = np.concatenate([c for _, c in held])
        n = self.counts[codes]
        out = gathered(self.ids, self.starts[codes], n)
        ends = np.cumsum(np.append(0, n))[np.cumsum([len(c) for _, c in held])]
        if self.held > self.remembered:
            self._forget()
        return [row for row, _ in held], out, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """The compiled tokenizer of a file; a worker compiles it once."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids (array of int), decoded (string) with one row for each row of
    ``docs``, in any order; ``ids=False`` or ``decoded=False`` gives the SHA-256 of those columns
    instead (ids_sha256 over decimal ids joined by one space, decoded_sha256), so that long texts need
    not be carried on. Null and empty texts have no token. Repeated rows and null doc_ids stay as
    they are; other columns of ``docs`` are not read. An empty table gives an empty table.
    ``path`` is a tokenizer file that every machine has. A task holds a block of a text, what it remembers of chunks (``REMEMBERED``
    bytes) and the tables; with digests, memory does not grow with a text beyond the text itself, but for a chunk without blanks.
    """
    fields = ["doc_id long", "n_tokens long", "ids array<int>" if ids else "ids_sha256 string", "decoded string" if decoded else "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        encoder = Encoder(bpe)
        for batch in batches:
            size = batch.num_rows
            counts, firsts = np.zeros(size, np.int64), [[] if ids else hashlib.sha256() for _ in range(size)]
            seconds = [[] if decoded else hashlib.sha256() for _ in range(size)]
            for rows, flat, n in encoder.pieces(x.as_py() for x in batch.column(1)):
                offsets, tokens = pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32())
                joined = [None if ids and strings is bpe.id_strings else pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(tokens)), " ") for strings in (bpe.id_strings, bpe.label_strings)]
                for k, (row, own) in enumerate(zip(rows, n.tolist(), strict=True)):
                    if not own:
                        continue
                    again = counts[row] > 0
                    counts[row] += own
                    if ids:
                        firsts[row].append(flat[offsets[k].as_py() :][:own])
                    else:
                        if again:
                            firsts[row].update(b" ")
                        firsts[row].update(joined[0][k].as_buffer())
                    if decoded:
                        seconds[row].append(joined[1][k].as_py())
                    else:
                        if again:
                            seconds[row].update(b" ")
                        seconds[row].update(joined[1][k].as_buffer())
            if ids:
                ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                first = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([y for x in firsts for y in x] or [np.zeros(0, np.int32)]), pa.int32()))
            else:
                first = pa.array([x.hexdigest() for x in firsts], pa.string())
            second = pa.array([" ".join(x) if decoded else x.hexdigest() for x in seconds], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), first, second], names=[f.split(" ")[0] for f in fields])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(arrow_map, run, ", ".join(fields))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id and ids: the arc labels of every path; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").transform(arrow_map, run, "doc_id long, text string")
