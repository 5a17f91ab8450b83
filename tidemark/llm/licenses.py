"""License scans by template markup: licence texts and notices as word automata with optional and replaceable regions.

A template is a licence's wording with two kinds of markup: <<optional>> ... <<end>> may be left out, and <<var a-b>> (or
<<var a-b pattern>>) stands for a to b words of any kind (or words that match the pattern whole). All other words are
mandatory. A template compiles into an automaton over words; a text has it where the automaton, begun at a word, accepts
a run of words. Of a template's places the leftmost counts, with its longest end, and the next is looked for after it.

The longest run of mandatory words is a template's anchor. Only around an anchor's places is the automaton run, as far to
each side as the template can reach, so no place is lost, and the work follows the number of anchors. Phrases are
templates of mandatory words alone; each of their places counts, overlapping ones too.

Defined results: a null or empty text, or one without words, has no places, null first and last words, empty labels and
score 0. Very long texts are scanned whole. Repeated rows count each. Ties: labels are distinct and sorted; of two ends
the farther holds. The score is the share of a text's words that lie in a place of a phrase or template. Other columns
are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The wording of public licences and of the notices that apply them.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
<<var 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
_BSD_NAMES = """<<optional>>3.<<end>> Neither the name of <<var 1-16>> nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var 1-16>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL <<var 1-16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_ISC = """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or
without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var 1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 1-8>> BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
_FREE = """<<var 1-8>> is free software: you can redistribute it and/or modify it under the terms of the GNU
<<KIND>> General Public License as published by the Free Software Foundation<<optional>>;<<end>>"""
TEMPLATES = {
    "mit": f"""<<optional>>The MIT License <<optional>>(MIT)<<end>><<end>> {_GRANT}, subject to the following conditions: The
        above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included
        in all copies or substantial portions of the Software. {_AS_IS}""",
    "mit-0": f"{_GRANT}. {_AS_IS}",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "isc": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0bsd": f"{_ISC}. {_ISC_END}",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: <<optional>>1.<<end>> The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. <<optional>>2.<<end>> Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. <<optional>>3.<<end>> This notice may not
        be removed or altered from any source distribution.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at <<var 1-1 https?>>
        www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the
        License<<end>>""",
    "gpl-2.0": "GNU General Public License <<optional>>as published by the Free Software Foundation either<<end>> <<optional>>,<<end>> version 2",
    "gpl-3.0": "GNU General Public License <<optional>>as published by the Free Software Foundation either<<end>> <<optional>>,<<end>> version 3",
    "gpl-notice": _FREE.replace("<<KIND>>", "") + "<<var 0-12>> or (at your option) any later version",
    "lgpl-notice": _FREE.replace("<<KIND>>", "<<var 1-1 lesser|library>>") + "<<var 0-12>> or (at your option) any later version",
    "agpl-notice": _FREE.replace("<<KIND>>", "Affero") + "<<var 0-12>> or (at your option) any later version",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at <<var 1-1 https?>> <<optional>>www<<end>> mozilla.org/MPL/2.0""",
    "bsl-1.0": """Distributed under the Boost Software License, Version 1.0. <<optional>><<optional>>(<<end>>See accompanying file
        <<var 1-4>> or copy at <<var 1-1 https?>> www.boost.org/LICENSE_1_0.txt<<end>>""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "cc0-1.0": """To the extent possible under law, <<var 1-20>> waived all copyright and related or neighboring rights to""",
    "cc-by": "CC BY <<var 1-1 [1-4]>> <<var 1-1 [05]>>",
    "cc-by-nc": "CC BY NC <<var 1-1 [1-4]>> <<var 1-1 [05]>>",
    "cc-by-sa": "CC BY SA <<var 1-1 [1-4]>> <<var 1-1 [05]>>",
    "cc-by-nd": "CC BY ND <<var 1-1 [1-4]>> <<var 1-1 [05]>>",
    "cc-by-nc-sa": "CC BY NC SA <<var 1-1 [1-4]>> <<var 1-1 [05]>>",
    "cc-by-nc-nd": "CC BY NC ND <<var 1-1 [1-4]>> <<var 1-1 [05]>>",
    "cc-notice": """licensed under a Creative Commons Attribution <<optional>>NonCommercial<<end>>
        <<optional>>ShareAlike<<end>> <<optional>>NoDerivatives<<end>> <<var 1-1 [1-4]>> <<var 1-1 [05]>>
        <<optional>><<var 1-2>><<end>> License""",
}

_MARK = re.compile(r"<<(?:(optional)|(end)|var (\d+)-(\d+)(?: ([^>]+))?)>>")
#: Bytes of words: letters and digits of ASCII, large ones made small, and all bytes of other characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """A template. State i stands before its i-th word; reach[i] are the states that i leads to without reading."""

    def __init__(self, label: str, markup: str, phrase: bool = False):
        self.label, self.phrase = label, phrase
        self.reads: list[bytes | re.Pattern | None] = []  # a word, a pattern for one, or any word
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        runs, at = [(0, 0)], 0  # runs of mandatory words
        for m in [*_MARK.finditer(markup), None]:
            new = words(markup[at : m.start() if m else len(markup)].encode())
            if not opened and new:
                grows = runs[-1][1] == len(self.reads) and runs[-1][1] > runs[-1][0]
                runs.append((runs.pop()[0] if grows else len(self.reads), len(self.reads) + len(new)))
            self.reads += new
            if m is None:
                break
            at = m.end()
            if m[1]:
                opened.append(len(self.reads))
            elif m[2]:
                skips.append((opened.pop(), len(self.reads)))
            else:
                least, most = int(m[3]), int(m[4])
                first = len(self.reads)
                self.reads += [re.compile(m[5].encode()) if m[5] else None] * most
                skips += [(first + k, first + most) for k in range(least, most)]
        if opened or not (run := max(runs, key=lambda r: r[1] - r[0]))[1]:
            raise ValueError(f"template {label}: a region is open, or no word is mandatory")
        self.whole = len(self.reads)
        self.reach = [{i} for i in range(self.whole + 1)]
        for i in range(self.whole, -1, -1):
            for start, end in skips:
                if start == i:
                    self.reach[i] |= self.reach[end]
        self.anchor, self.before = b" " + b" ".join(self.reads[slice(*run)]) + b" ", run[0]

    def end(self, text: list[bytes], at: int) -> int:
        """The farthest end of a place that begins at a word; the word itself if there is none."""
        states, best = self.reach[0], at
        for k in range(at, len(text)):  # no farther than the states go
            word, after = text[k], set()
            for i in states:
                if i < self.whole:
                    reads = self.reads[i]
                    if reads is None or (reads == word if isinstance(reads, bytes) else reads.fullmatch(word)):
                        after |= self.reach[i + 1]
            if not after:
                break
            if self.whole in after:
                best = k + 1
            states = after
        return best

    def places(self, text: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        found, done, at, n, seen, number = [], 0, joined.find(self.anchor), len(self.anchor.split()), 0, 0
        while at >= 0:
            number += joined.count(b" ", seen, at)  # the word's number: spaces before it
            seen = at
            if self.phrase:
                found.append((number, number + n))
            else:
                done = max(done, number - self.before)
                while done <= number:  # each word is tried once as a place's begin
                    if (end := self.end(text, done)) > done:
                        found.append((done, end))
                    done = max(done + 1, end)
            at = joined.find(self.anchor, at + 1)
        return found


PLACE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])


def license_places(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, covered (words in a place) and places (label, base, start, end in words) of every document."""
    named = TEMPLATES if templates is None else templates

    def run(batches):
        automata = [Automaton(label, p, True) for p, label in PHRASES.items()] + [Automaton(label, t) for label, t in named.items()]
        for b in batches:
            number, covered, places = [], [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                text = words(raw or b"")
                joined = b" " + b" ".join(text) + b" "
                found = sorted((s, e, a.label, a.phrase) for a in automata if a.anchor in joined for s, e in a.places(text, joined))
                inside = upto = 0
                for s, e, _, _ in found:
                    inside += max(0, e - max(s, upto))
                    upto = max(upto, e)
                number.append(len(text))
                covered.append(inside)
                places.append([{"label": label, "base": base, "start": s, "end": e} for s, e, label, base in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int64()), pa.array(covered, pa.int64()), pa.array(places, pa.list_(PLACE))], ["doc_id", "n_words", "covered", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, covered long, places array<struct<label: string, base: boolean, start: long, end: long>>")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each document: its phrases' places and labels, all labels, and the share of its words in a place."""
    base = F.expr("filter(places, p -> p.base)")
    label = lambda p: F.array_join(F.sort_array(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    return license_places(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("places")).alias("labels"), F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
