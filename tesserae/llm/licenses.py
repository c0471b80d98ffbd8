"""License scans by conditional compression.

Blocks are cut around words that licenses use. A block is compressed by itself and with each license
template as a zstandard raw dictionary (the license's text and notices); the template that saves the most bytes is its best candidate.
Every template, in order of the savings, is confirmed by exact wording differences: the block's words are compared with the license's text
word by word, and with each of its notices. Up to a stated share of the words may differ; the words that were left out and put in are
reported. In notices, words that decide which license is meant (names, versions, negations) and the cues may not differ. So compression
orders, wording decides, and of findings at one place the longest wins, then the closest, then the one that saved most; a small saving loses none.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, text_of


@dataclass(frozen=True)
class Template:
    """phrases: wordings that each show the license; ``*`` stands for one to six words, and a phrase with it must be exact. text: the license's own text, or the notice that it asks for."""

    license: str
    phrases: tuple[str, ...]
    text: str = ""


#: Notices of the GPL that name no version; version words near them decide, if there are any.
GPL = "GPL"
#: Texts of licenses, and the standard notices of those that are longer than a page.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
#: Standard wordings of license notices.
TEMPLATES = (
    Template("Apache-2.0", ("licensed under the apache license version 2.0", "licensed under the apache license 2.0", "apache license 2.0", "apache 2.0 license", "license apache 2.0", "spdx license identifier apache 2.0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"), APACHE),
    Template("BSD", ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the * bsd license", "bsd license")),
    Template("BSD-2-Clause", ("spdx license identifier bsd 2 clause", "license bsd 2 clause", "bsd 2 clause license", "2 clause bsd license"), f"{BSD_HEAD}\n{BSD_TAIL}"),
    Template("BSD-3-Clause", ("spdx license identifier bsd 3 clause", "license bsd 3 clause", "bsd 3 clause license", "3 clause bsd license"), f"{BSD_HEAD}\n{BSD_THIRD}\n{BSD_TAIL}"),
    Template("CC-BY-4.0", ("licensed under cc by 4.0", "creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0", "license cc by 4.0")),
    Template("CC-BY-NC-4.0", ("licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0", "license cc by nc 4.0")),
    Template("CC-BY-SA-4.0", ("licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0", "license cc by sa 4.0")),
    Template(GPL, ("you should have received a copy of the gnu general public license along with this program",)),
    Template("GPL-2.0", ("licensed under the gnu general public license version 2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "under the terms of the gnu general public license version 2 as published by the free software foundation", "spdx license identifier gpl 2.0", "license gpl 2.0", "gplv2"), GNU.format(name="General Public License", version=2)),
    Template("GPL-3.0", ("licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "under the terms of the gnu general public license version 3 as published by the free software foundation", "spdx license identifier gpl 3.0", "license gpl 3.0", "gplv3"), GNU.format(name="General Public License", version=3)),
    Template("ISC", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier isc", "license isc", "isc license"), ISC),
    Template("LGPL-3.0", ("licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", "spdx license identifier lgpl 3.0", "license lgpl 3.0", "lgplv3"), GNU.format(name="Lesser General Public License", version=3)),
    Template("MIT", ("released under the mit license", "licensed under the mit license", "mit license", "license mit", "spdx license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"), MIT),
    Template("MPL-2.0", ("this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license 2.0", "license mpl 2.0", "spdx license identifier mpl 2.0"), MPL),
    Template("Proprietary", ("all rights reserved",)),
    Template("Unlicense", ("this is free and unencumbered software released into the public domain", "spdx license identifier unlicense", "license unlicense"), UNLICENSE),
    Template("Zlib", ("spdx license identifier zlib", "license zlib", "zlib license", "permission is granted to anyone to use this software for any purpose including commercial applications"), ZLIB),
)
#: A line without any of these has none of the phrases above.
CUES = re.compile(r"licen[sc]e|licensed|copyright|l?gplv[23]|disclaimer|warrant|as.is|spdx|permission|permitted|creative\s+commons|mozilla|public\s+domain|rights\s+reserved|applicable\s+law|redistribut", re.I)
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Words that may not differ, as another license, or none, would be meant. So are words with a digit, and cues.
DECIDING = frozenset("apache bsd mit isc gnu gpl lgpl agpl general lesser affero library mozilla public spdx identifier cc by nc sa nd creative commons attribution noncommercial sharealike noderivatives unencumbered domain rights reserved not no never without except".split())
#: Words that, put into a license's text, make another license of it, or none.
OTHERS = frozenset("apache bsd mit isc gpl lgpl agpl lesser affero library mozilla not never".split())
#: Words before a version word among which the GPL must be named; and those of a block between it and a notice, at most.
NAMED_WITHIN, NEAR = 14, 120
#: Characters on either side of a cue that a block takes in; and bytes that a block is compressed in at a time.
AROUND, PIECE = 640, 1 << 14


@dataclass(frozen=True)
class Settings:
    """differs: share of a phrase's words that may differ, by words replaced, left out or put in. text_differs: the same for a license's text, which people shorten and reword."""

    differs: float = 0.2
    text_differs: float = 0.4
    templates: tuple[Template, ...] = TEMPLATES


def words(text: str) -> list[tuple[str, int, int]]:
    """Lowered words with their places; licence is spelled license."""
    return [(m[0].lower().replace("licence", "license"), m.start(), m.end()) for m in WORD.finditer(text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """Places around cues; those that touch are one. Whole texts are searched."""
    out: list[list[int]] = []
    for m in CUES.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(_edge(text, a, -1), _edge(text, b, 1)) for a, b in out]


def _edge(text: str, at: int, step: int) -> int:
    """The place, moved out of a word that it cuts (of up to 64 letters)."""
    for _ in range(64):
        if at <= 0 or at >= len(text) or text[at - 1].isspace() or text[at].isspace():
            break
        at += step
    return at


@lru_cache(maxsize=4)
def _compressors(templates: tuple[Template, ...]) -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    plain = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    own = []
    for t in templates:
        raw = "\n".join([*t.phrases, " ".join(w for w, _, _ in words(t.text))]).encode()
        own.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain))
    return zstandard.ZstdCompressor(**plain), own


def ranked(placed: list[tuple[str, int, int]], s: Settings) -> list[tuple[int, int]]:
    """(bytes of compressed size saved, template) of every template, the largest saving first."""
    plain, own = _compressors(s.templates)
    folded = " ".join(w for w, _, _ in placed).encode()
    best = [0] * len(s.templates)
    for at in range(0, max(1, len(folded)), PIECE):
        piece = folded[at : at + PIECE + 400]  # longer than a phrase, so that none is cut
        alone = len(plain.compress(piece))
        for i, c in enumerate(own):
            best[i] = max(best[i], alone - len(c.compress(piece)))
    return sorted(((v, i) for i, v in enumerate(best)), key=lambda x: (-x[0], x[1]))


def _found(own: list[str], phrase: list[str]) -> list[tuple[int, int]]:
    """[first, last) words of the block where the phrase is, word for word; ``*`` is one to six words."""
    out, at = [], 0
    starts = [i for i, w in enumerate(own) if w == phrase[0]]
    for i in starts:
        if i < at:
            continue
        end = _match(own, i, phrase)
        if end is not None:
            out.append((i, end))
            at = end
    return out


def _match(own: list[str], at: int, phrase: list[str]) -> int | None:
    for k, w in enumerate(phrase):
        if w == "*":
            return next((e for n in range(1, 7) if (e := _match(own, at + n, phrase[k + 1 :])) is not None), None)
        if at >= len(own) or own[at] != w and not (w[0].isdigit() and own[at].startswith(w + ".")):
            return None
        at += 1
    return at


def _same(own: str, w: str) -> bool:
    return own == w or w[0].isdigit() and own.startswith(w + ".")


def _decides(w: str) -> bool:
    return w in DECIDING or not w.isalpha() or CUES.search(w) is not None


def _aligned(own: list[str], lo: int, hi: int, phrase: list[str], most: int) -> tuple[int, int, int] | None:
    """(differences, first, last + 1) of the words within [lo, hi) most like the phrase, if at most ``most`` differ and none of those decides.

    Edit distance by words with a free start; of equal ones the first end, and of its alignments the shortest.
    """
    none = most + 1
    gap = [none if _decides(w) else 1 for w in phrase]
    row = [(0, 0)]  # differences, minus the first word
    best = None
    for at in range(lo, hi + 1):
        before, put_in = row, none if at == lo or _decides(own[at - 1]) else 1
        row = [(0, -at)]
        for k, w in enumerate(phrase):
            ways = [(row[k][0] + gap[k], row[k][1])]
            if at > lo:
                cost = 0 if _same(own[at - 1], w) else max(gap[k], put_in)
                ways += [(before[k][0] + cost, before[k][1]), (before[k + 1][0] + put_in, before[k + 1][1])]
            row.append(min(ways))
        if row[-1][0] <= most and (best is None or row[-1][0] < best[0]):
            best = (row[-1][0], -row[-1][1], at)
    return best


@lru_cache(maxsize=4096)
def _parts(phrase: str, share: float) -> tuple[tuple[str, ...], int, tuple[tuple[int, tuple[str, ...]], ...], frozenset]:
    """Words of the phrase, differences allowed, pieces of it of which one must be whole (place, words), and words that must be there."""
    # a sign in a phrase's words is not a word: both sides are split alike
    parts = tuple(w if w == "*" else x for w in phrase.split() for x in ([w] if w == "*" else WORD.findall(w)))
    most = 0 if "*" in parts else int(share * len(parts))
    cut = [len(parts) * i // (most + 1) for i in range(most + 2)]
    return parts, most, tuple((a, parts[a:b]) for a, b in zip(cut, cut[1:], strict=False)), frozenset(w for w in parts if w.isalpha() and (not most or _decides(w)))


@dataclass(frozen=True)
class Wording:
    """Words [first, last) of a block, the share that differs from the template's wording, and the words put in and left out."""

    first: int
    last: int
    differs: float
    put_in: tuple[str, ...] = ()
    left_out: tuple[str, ...] = ()


def _wording(own: list[str], first: int, last: int, parts: tuple[str, ...], differs: float | None = None) -> Wording:
    """The words that differ, by an alignment of the two."""
    matcher = difflib.SequenceMatcher(None, own[first:last], parts, autojunk=False)
    put_in, left_out = [], []
    for _, a, b, c, d in (x for x in matcher.get_opcodes() if x[0] != "equal"):
        put_in += own[first + a : first + b]
        left_out += parts[c:d]
    share = round(1 - matcher.ratio(), 6) if differs is None else differs
    return Wording(first, last, share, tuple(put_in), tuple(w for w in left_out if w != "*"))


@lru_cache(maxsize=64)
def _runs(text: str) -> tuple[tuple[str, ...], frozenset]:
    """Words of a license's text, and its runs of four words."""
    parts = tuple(w for w, _, _ in words(text))
    return parts, frozenset(zip(parts, parts[1:], parts[2:], parts[3:], strict=False))


def confirm_text(own: list[str], text: str, share: float) -> list[Wording]:
    """The places of the block where the license's text is, of whose words no larger share than ``share`` is left out or put in, and none that names another license, denies or is another version.

    The runs of four words that both have show where; a stretch of them without a gap of more than half the text's words is aligned as a whole.
    """
    parts, runs = _runs(text)
    hits = [i for i, run in enumerate(zip(own, own[1:], own[2:], own[3:], strict=False)) if run in runs]
    out, k = [], 0
    while k < len(hits):
        end = k
        while end + 1 < len(hits) and hits[end + 1] - hits[end] <= len(parts) // 2 and hits[end + 1] - hits[k] < 2 * len(parts):
            end += 1
        first, last = hits[k], hits[end] + 4
        if end - k + 1 >= (1 - share) * 0.25 * len(parts):
            found = _wording(own, first, last, parts, 0.0)
            differs = round((len(found.put_in) + len(found.left_out)) / (len(parts) + last - first), 6)
            versions = "version" in parts and any(w[0].isdigit() for w in found.put_in) and any(w[0].isdigit() for w in found.left_out)
            if differs <= share and not versions and OTHERS.isdisjoint(found.put_in):
                out.append(Wording(first, last, differs, found.put_in, found.left_out))
        k = end + 1
    return out


def confirm(own: list[str], template: Template, s: Settings, known: set[str]) -> list[Wording]:
    """The wordings of the template's phrases and text in the words of the block (``known`` as a set)."""
    out = set(confirm_text(own, template.text, s.text_differs)) if template.text else set()
    for phrase in template.phrases:
        parts, most, pieces, needed = _parts(phrase, s.differs)
        if not needed <= known:
            continue
        exact = _found(own, list(parts))
        out |= {_wording(own, a, b, parts) for a, b in exact}
        if not most:
            continue
        # with at most ``most`` differences, one of most + 1 pieces is word for word
        spans = sorted({(max(0, i - at - most), min(len(own), i - at + len(parts) + most)) for at, piece in pieces for i, _ in _found(own, list(piece))})
        for lo, hi in spans:
            if any(lo <= a and b <= hi for a, b in exact):
                continue
            got = _aligned(own, lo, hi, list(parts), most)
            if got and got[0]:
                out.add(_wording(own, got[1], got[2], parts, round(got[0] / len(parts), 6)))
    return sorted(out, key=lambda w: (w.first, w.last, w.differs))


def _version(own: list[str], first: int, last: int) -> str:
    """The GPL with the version whose words are nearest to the notice [first, last), if there are any that follow its name."""
    near = []
    for i in range(max(0, first - NEAR), min(len(own), last + NEAR)):
        number = own[i].removeprefix("v")
        if number in ("2", "3", "2.0", "3.0") and (own[i] != number or i and own[i - 1] in ("version", "v", "gpl")):
            name = own[max(0, i - NAMED_WITHIN) : i]
            # names of other licenses have versions of their own
            if {"gpl", "general"} & set(name) and not {"lesser", "affero", "library", "apache", "mozilla"} & set(name):
                near.append((max(first - i, i - last, 0), number[0]))
    return f"{GPL}-{min(near)[1]}.0" if near else GPL


def scan(text: str, s: Settings) -> list[dict]:
    """Confirmed licenses of a whole text, by place. Of two that overlap, an exact one stays, or the longer wording, then the closer, then the larger saving; a license's text goes before its notices."""
    found = []
    for a, b in blocks(text):
        placed = words(text[a:b])
        own = [w for w, _, _ in placed]
        known = set(own)
        for saving, i in ranked(placed, s):
            t = s.templates[i]
            for w in confirm(own, t, s, known):
                name = _version(own, w.first, w.last) if t.license == GPL else t.license
                found.append({"license": name, "start": a + placed[w.first][1], "end": a + placed[w.last - 1][2], "saving": saving, "differs": w.differs, "put_in": list(w.put_in), "left_out": list(w.left_out)})
    kept: list[dict] = []
    full = 40  # words and blanks of a text are longer than those of any notice
    for x in sorted(found, key=lambda x: (x["end"] - x["start"] < 10 * full, x["differs"] > 0 and x["end"] - x["start"] < 10 * full, x["start"] - x["end"] if x["end"] - x["start"] < 10 * full else 0, x["differs"], -x["saving"], x["start"])):
        if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x["start"])


RESULT = "doc_id long, licenses array<string>, n_findings int, findings array<struct<license: string, start: int, end: int, saving: int, differs: double, put_in: array<string>, left_out: array<string>>>"


def scan_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """License notices of every whole text.

    Returns doc_id, licenses (names in order, each once), n_findings and findings (license, start and
    end in characters, saving, differs, the words put in and left out), one row for each row of ``docs``; null and empty texts have none. Null doc_ids and
    repeated rows stay as they are; other columns are not read; an empty table gives an empty table.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saving", pa.int32()), ("differs", pa.float64()), ("put_in", pa.list_(pa.string())), ("left_out", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, s) if t else [] for t in batch.column(1).to_pylist()]
            names = [sorted({x["license"] for x in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array([len(f) for f in found], pa.int32()), pa.array(found, kind)], names=["doc_id", "licenses", "n_findings", "findings"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(arrow_map, run, RESULT)
