"""License scans by conditional compression.

A candidate block is a sentence that mentions licensing; it runs over line ends and comment marks up to a sentence end or
a blank line. Whole license texts run over many sentences and blank lines: there the candidate blocks are the stretches
of any document that have as many runs of three words of a license text as one within the allowed differences must have. A block is compressed with zstandard
once alone and once with each template as a raw dictionary, both in lower case; the template that saves the most,
relative to the block, ranks first. Every template is compared with the block word by word, by the least edit distance to
any stretch of it; a version slot takes any version, and a stretch after a negation is none. Of confirmed stretches that
overlap a whole text stays before a sentence, then the one with the least share of differing words, then the
better-ranked.

Every text is scanned whole. Documents without a mention are scanned for license texts alone, and of those only the ones
whose words, hashed by threes over whole batches, repeat enough of a license text; a text within the allowed
differences always does, since each difference breaks three runs of three words at most.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import lean, text_of
from tallyglass.llm.textbytes import LOWER, chunks, fold, word_hashes

#: Notice wordings of well-known licenses. `{v}` is a version.
NOTICES = {
    "Apache": "Licensed under the Apache License, Version {v}.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL": "This work is licensed under the GNU General Public License, version {v}.",
    "GPL-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version {v}.",
    "AGPL": "This work is licensed under the GNU Affero General Public License, version {v}.",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, version {v}.",
    "CC-BY": "Licensed under CC BY {v}.",
    "CC-BY-SA": "Licensed under CC BY-SA {v}.",
    "CC-BY-NC": "Licensed under CC BY-NC {v}.",
    "CC-BY-ND": "Licensed under CC BY-ND {v}.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution {v} International License.",
    "CC0": "This work is dedicated to the public domain under CC0 {v}.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}
#: Identifiers of the tag line `SPDX-License-Identifier: ...`.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
NOTICES |= {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

#: License texts and file headers as their publishers word them, without the copyright line.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details.
You should have received a copy of the GNU {kind} License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT_TAIL = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
TEXTS = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _MIT_TAIL,
    "BSD-2-Clause-text": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause-text": f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.
""" + _ISC_TAIL,
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL,
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Apache-header": """Licensed under the Apache License, Version {v} (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    "MPL-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
    **{f"{name}-header": _GNU.replace("{kind}", kind) for name, kind in (("GPL", "General Public"), ("LGPL", "Lesser General Public"), ("AGPL", "Affero General Public"))},
}
#: Fixed value: what makes a text, then a sentence, a candidate.
GAP = r"[\s/*#;%>|-]+"
MENTION = r"(?i)licen[cs]e|redistribut|creative commons|public domain|all rights reserved|permission is hereby|\bCC BY\b".replace(" ", GAP)
#: Comment marks that may open a line, and characters of those that may close one.
OPENING = re.compile(r"//+!?|/\*+!?|\*+/?|#+|--+|;+|%+|<!--|>+|\|+")
CLOSING = "*/#->|"
VERSION = re.compile(r"v?\d+(\.\d+)*")
#: Longest block that is compared; a longer sentence is compared in windows of this length that overlap by half.
BLOCK_CHARS = 400
#: The share of a notice's words that may differ.
MAX_DIFFERENT = 0.25
#: Words in a row that a stretch must share with a license text to be compared; within MAX_DIFFERENT there are always so many.
SEED_WORDS = 3
NEGATIONS = {"not", "no", "never", "without", "nor"}


def unmarked(line: str) -> str:
    """The line with blanks for its comment marks; as long as it was."""
    begin = len(line) - len(line.lstrip())
    if mark := OPENING.match(line, begin):
        begin = mark.end()
    bare = line.rstrip()
    end = len(bare.rstrip(CLOSING))
    if not bare.endswith("*/") and end and not line[end - 1].isspace():
        end = len(bare)
    return " " * len(line) if end <= begin else " " * begin + line[begin:end] + " " * (len(line) - end)


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(start, lines without comment marks) of each run of lines that are not blank."""
    held, start, at = [], 0, 0
    for line in text.split("\n"):
        bare = unmarked(line)
        if not bare.strip():
            if held:
                yield start, "\n".join(held)
            held = []
        else:
            start = start if held else at
            held.append(bare)
        at += len(line) + 1
    if held:
        yield start, "\n".join(held)


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(start in code points, block) of each candidate sentence."""
    for start, lines in paragraphs(text):
        if not re.search(MENTION, lines):
            continue
        at = start
        for piece in re.split(r"(?<=[.!?])(?=\s)", lines):
            if re.search(MENTION, piece):
                first, size = at + len(piece) - len(piece.lstrip()), len(piece.strip())
                step = BLOCK_CHARS // 2
                for k in range(first, first + max(1, size - step), step):
                    block = text[k : min(k + BLOCK_CHARS, first + size)]
                    if re.search(MENTION, block):
                        yield k, block
            at += len(piece)


@cache
def compressors(notices: tuple[tuple[str, str], ...]):
    import zstandard

    def one(notice: str):
        data = zstandard.ZstdCompressionDict(notice.lower().replace("{v}", "1.0").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=19, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    alone = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
    return alone, {name: one(text) for name, text in notices}


def ranked(block: str, notices: dict[str, str]) -> list[tuple[float, str]]:
    """(share of the block's compressed size saved, notice name), the largest saving first, ties by name."""
    alone, given = compressors(tuple(notices.items()))
    raw = block.lower().encode()
    size = len(alone.compress(raw))
    return sorted(((1 - len(c.compress(raw)) / size, name) for name, c in given.items()), key=lambda x: (-x[0], x[1]))


def spans(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of lower-case words without surrounding punctuation and comment marks; a version is `{v}`."""
    found, at = [], 0
    for k, line in enumerate(text.split("\n")):
        for m in re.finditer(r"\S+", unmarked(line) if k else line):
            if word := m[0].lower().strip(".,;:!?\"'()"):
                found.append(("{v}" if word == "{v}" or VERSION.fullmatch(word) else word, at + m.start(), at + m.end()))
        at += len(line) + 1
    return found


def words(text: str) -> list[str]:
    return [w for w, _, _ in spans(text)]


def differences(have: list[str], want: list[str]) -> tuple[int, int, int]:
    """Least number of words to delete, insert or replace to turn `want` into a stretch of `have`; where that stretch begins and ends.

    A cell of the table is one number, differences times `unit` less the beginning: the least has the fewest, then the latest beginning.
    """
    known = {w: k for k, w in enumerate(dict.fromkeys(want))}
    words_ = np.array([known.get(w, -1) for w in have], np.int64)
    unit = len(have) + 1
    above, steps = -np.arange(unit), np.arange(unit) * unit
    for w in want:
        row = above + unit
        row[1:] = np.minimum(row[1:], above[:-1] + unit * (words_ != known[w]))
        above = np.minimum.accumulate(row - steps) + steps
    end = int(np.argmin(above))
    cost = -int(-above[end] // unit)
    return cost, int(cost * unit - above[end]), end


def stretches(have: list[str], want: list[str], allowed: int, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """(differences, begin, end) of each stretch of `have` within `allowed` differences, the best first, then left and right of it."""
    if len(have) < len(want) - allowed or (Counter(want) - Counter(have)).total() > allowed:
        return
    n, begin, end = differences(have, want)
    if n <= allowed and begin < end:
        yield n, at + begin, at + end
        yield from stretches(have[:begin], want, allowed, at)
        yield from stretches(have[end:], want, allowed, at + end)


def least_seeds(n: int) -> int:
    """Runs of SEED_WORDS words that a stretch within the allowed differences of a text of `n` words shares with it at least."""
    return max(1, n - SEED_WORDS + 1 - SEED_WORDS * max(1, int(MAX_DIFFERENT * n)))


@cache
def seeds(texts: tuple[tuple[str, str], ...]) -> tuple[dict[str, list[str]], dict[tuple[str, ...], list[tuple[str, int]]]]:
    """The words of each license text, and where each SEED_WORDS in a row are in which text."""
    wanted, at = {name: words(text) for name, text in texts}, {}
    for name, want in wanted.items():
        for k in range(len(want) - SEED_WORDS + 1):
            at.setdefault(tuple(want[k : k + SEED_WORDS]), []).append((name, k))
    return wanted, at


#: Bytes of the tokens that are hashed: letters, digits and all beyond ASCII. Marks and punctuation only stand between them.
TOKEN = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
TOKENS_HASHED = 3


def token_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every TOKENS_HASHED tokens in a row, case folded, in order."""
    inside = TOKEN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    n = max(0, len(starts) - TOKENS_HASHED + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = word_hashes(LOWER[data], starts, ends)
    whole = text[:n] == text[TOKENS_HASHED - 1 :]
    return fold([hashed[k : k + n] for k in range(TOKENS_HASHED)])[whole], text[:n][whole]


@cache
def signs(texts: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, int]:
    """Hashes of the first tokens of each run of SEED_WORDS words without a version, and how many of them a document with any of the texts has at least."""
    found, least = [], []
    for _, text in texts:
        want = words(text)
        runs = [want[k : k + SEED_WORDS] for k in range(len(want) - SEED_WORDS + 1)]
        sure = 0
        for run in runs:
            tokens = re.findall(r"[a-z0-9]+", " ".join(run))
            if "{v}" not in run and len(tokens) >= TOKENS_HASHED:
                data = np.frombuffer(" ".join(tokens[:TOKENS_HASHED]).encode(), np.uint8)
                found.append(token_runs(data, np.array([0, len(data)]))[0])
                sure += 1
        least.append(least_seeds(len(want)) - (len(runs) - sure))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), min(least, default=1)


def may_hold(column: pa.Array, texts: dict[str, str]) -> np.ndarray:
    """Which documents may hold a license text: all that do, and few others."""
    known, least = signs(tuple(texts.items()))
    if not texts or least < 1:  # a text too short to be told by its runs
        return np.full(len(column), bool(texts))
    out = np.zeros(len(column), bool)
    for i, j, data, offsets in chunks(column):
        hashed, text = token_runs(data, offsets)
        at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
        out[i:j] = np.bincount(text[known[at] == hashed], minlength=j - i) >= least
    return out


def whole_texts(text: str, texts: dict[str, str]) -> Iterator[tuple[str, int, int, int]]:
    """(license text, differences, start, end) of each stretch of the document within the allowed differences."""
    if not texts:
        return
    wanted, known = seeds(tuple(texts.items()))
    at, line_start = [], 0
    for line in text.split("\n"):
        at += [(w, line_start + a, line_start + b) for w, a, b in spans(unmarked(line))]
        line_start += len(line) + 1
    have = [w for w, _, _ in at]
    places = set()  # windows that hold every stretch with a seed: its start is off by the allowed differences at most
    hits: dict[str, list[int]] = {}
    for i in range(len(have) - SEED_WORDS + 1):
        for name, k in known.get(tuple(have[i : i + SEED_WORDS]), ()):
            places.add((name, (i - k) // max(1, int(MAX_DIFFERENT * len(wanted[name])))))
            if not hits.setdefault(name, []) or hits[name][-1] != i:
                hits[name].append(i)
    seen = set()
    for name, place in sorted(places):
        want = wanted[name]
        allowed = max(1, int(MAX_DIFFERENT * len(want)))
        lo, hi = max(0, (place - 1) * allowed), (place + 2) * allowed + len(want)
        if bisect(hits[name], hi) - bisect(hits[name], lo - 1) < least_seeds(len(want)):
            continue
        for n, i, j in stretches(have[lo:hi], want, allowed, lo):
            if (name, i, j) not in seen:
                seen.add((name, i, j))
                yield name, n, at[i][1], at[j - 1][2]


def scan_text(text: str, notices: dict[str, str] = NOTICES, texts: dict[str, str] = TEXTS) -> list[tuple[str, int, str, float, int]]:
    """(license, start, block, saving, word differences) of each confirmed stretch of a block that overlaps no better one, in order."""
    wanted = {name: words(notice) for name, notice in notices.items()}
    found = []
    for name, n, begin, end in whole_texts(text, texts):
        block = text[begin:end]
        saved = dict((name_, saving) for saving, name_ in ranked(block, texts))
        found.append((0, n / len(words(texts[name])), -saved[name], begin, name, n, block, begin, end))
    for start, block in blocks(text):
        at = spans(block)
        have = [w for w, _, _ in at]
        hits = [(name, *hit) for name, want in wanted.items() for hit in stretches(have, want, int(MAX_DIFFERENT * len(want)))]
        hits = [h for h in hits if not (h[2] and have[h[2] - 1] in NEGATIONS)]
        saved = {name: saving for saving, name in ranked(block, notices)} if hits else {}
        found += [(1, n / len(wanted[name]), -saved[name], start, name, n, block, start + at[i][1], start + at[j - 1][2]) for name, n, i, j in hits]
    taken, kept = [], []
    for _, _, saving, start, name, n, block, begin, end in sorted(found):
        k = bisect(taken, (begin, end))
        if (k == 0 or taken[k - 1][1] <= begin) and (k == len(taken) or taken[k][0] >= end):
            taken.insert(k, (begin, end))
            kept.append((begin, (name, start, block, -saving, n)))
    return [hit for _, hit in sorted(kept)]


def scan(docs: DataFrame, notices: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed notice of a block: doc_id, license, start (code points), block, saving, word_differences.

    notices: sentences by name, NOTICES by default. texts: whole license texts and headers by name, TEXTS by default.

    Null and empty texts have none. Repeated rows are scanned each; other columns are ignored. An empty table gives no rows.
    """
    chosen, long = notices or NOTICES, TEXTS if texts is None else texts
    schema = "doc_id long, license string, start int, block string, saving double, word_differences int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                asked = part.column(2).to_numpy(zero_copy_only=False) | may_hold(part.column(1), long)
                few = part.filter(pa.array(asked))
                rows = [(i, *hit) for i, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True) for hit in scan_text(t, chosen, long)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                names = ["doc_id", "license", "start", "block", "saving", "word_differences"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("mentions", F.col("text").rlike(MENTION))
    return rows.mapInArrow(lean(run), schema)
