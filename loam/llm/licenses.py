"""License scan by conditional compression: how much smaller a block gets when a license's wording is known."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import texts

#: Parts of license texts and whole ones, as their authors published them.
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
ISC_TERMS = ", provided that the above copyright notice and this permission notice appear in all copies."
AS_IS_ISC = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so"""
MIT_TERMS = """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
AS_IS_MIT = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: The notice that BSD licenses share, and what tells the one of two clauses.
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."
BSD_SECOND, BSD_THIRD = re.compile(r"(?i)binary\W+form\W+must\W+reproduce"), re.compile(r"(?i)neither\W+the\W+names?\W")
BSD_1 = """
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
BSD_2 = """
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
AS_IS_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
CC0 = """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty."""


def _gnu(thing: str, name: str, version: str, stop: str) -> str:
    """The whole header that the GNU licenses ask for."""
    short = name.removeprefix("GNU ")
    return (
        f"This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the "
        f"Free Software Foundation{',' if stop == ':' else ';'} either version {version} of the License, or (at your option) any later version. This {thing} is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {short} for more details."
    )


#: Public wordings of license notices, by SPDX identifier: sentences that are usual in files, headers, and
#: whole texts of the short licenses (further down).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", APACHE),
    ("GPL-2.0", _gnu("program", "GNU General Public License", "2", ";")),
    ("GPL-3.0", _gnu("program", "GNU General Public License", "3", ":")),
    ("LGPL-2.1", _gnu("library", "GNU Lesser General Public License", "2.1", ";")),
    ("LGPL-3.0", _gnu("library", "GNU Lesser General Public License", "3", ":")),
    ("AGPL-3.0", _gnu("program", "GNU Affero General Public License", "3", ":")),
    ("MPL-2.0", MPL),
    ("EPL-2.0", EPL),
    ("MIT", MIT + MIT_TERMS + AS_IS_MIT),
    ("MIT-0", MIT + "." + AS_IS_MIT),
    ("ISC", GRANT[:-1] + ISC_TERMS + AS_IS_ISC),
    ("0BSD", GRANT + AS_IS_ISC),
    ("BSD-1-Clause", BSD + BSD_1 + AS_IS_BSD),
    ("BSD-2-Clause", BSD + BSD_1 + BSD_2 + AS_IS_BSD),
    ("BSD-3-Clause", BSD + BSD_1 + BSD_2 + BSD_3 + AS_IS_BSD),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
    ("Unlicense", UNLICENSE),
    ("WTFPL", WTFPL),
    ("CC0-1.0", CC0),
]

#: Headings that count only where they fill a line, after TEMPLATES in the numbers of the results.
TITLES: list[tuple[str, str]] = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
]
#: What a text must hold to be a candidate, line ends and comment signs between words or not; the same pattern serves
#: Spark's filter and the tasks.
CUE = (
    r"(?i)licen[cs]e|copyright|\ball\W{1,12}rights\W{1,12}reserved|creative\W{1,12}commons|public\W{1,12}(?:domain|license)"
    r"|hereby\W{1,12}granted|\bCC[ -]?(?:BY|0)|redistribut|SPDX"
)
#: Least relative gain of a winner, and least share of the template's words that must stand in the block in order.
GAIN, SHARE = 0.25, 0.6
#: Characters around a cue that belong to its block: twice the longest template, which leaves room for comment signs and
#: indentation, so that a template that holds the cue lies in the block.
REACH = 2 * max(len(t) for _, t in TEMPLATES)

SENTENCE = re.compile(r"(?<![vV])[.!?]\s+(?=[A-Z])")
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_KNOWN = [(n, [w.lower() for w in WORDS.findall(t)]) for n, t in TEMPLATES + TITLES]
_LONGEST = max(len(w) for _, w in _KNOWN)
#: Words that tell one license from another: none may be added or missing. Nor may a version, a number after these words
#: or with a stop in it, be missing.
TELLING = {"lesser", "affero", "nc", "nd", "sa", "by-nc", "by-nd", "by-sa", "by-nc-sa", "by-nc-nd", "noncommercial", "noderivatives", "sharealike",
           "attribution-noncommercial", "attribution-noderivatives", "attribution-sharealike", "mozilla", "eclipse", "apache"}
BEFORE_VERSION = {"version", "v", "license", "bsd"}


def _versions(words: list[str]) -> set[str]:
    return {w for i, w in enumerate(words) if w[:1].isdigit() and ("." in w or i and words[i - 1] in BEFORE_VERSION)}


def _names() -> list[str]:
    """License of each template and title; those of which the wording is part of several licenses name them all."""
    keys = [" " + " ".join(w) + " " for _, w in _KNOWN]
    out = []
    for i, (name, _) in enumerate(_KNOWN):
        every = {n for j, (n, _) in enumerate(_KNOWN[: len(TEMPLATES)]) if keys[i] in keys[j]} if i < len(TEMPLATES) else {name}
        out.append(" OR ".join(sorted(every)))
    return out


_COUNTS = [Counter(w) for _, w in _KNOWN]
_NAMES, _VERSIONS = _names(), [_versions(w) for _, w in _KNOWN]


@lru_cache(maxsize=4096)
def _compressor(dictionary: str | None):
    import zstandard as z

    if dictionary is None:
        return z.ZstdCompressor(level=19, write_content_size=False)
    d = z.ZstdCompressionDict(dictionary.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
    return z.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_dict_id=False)


@lru_cache(maxsize=20_000)
def _size(text: str, dictionary: str | None = None) -> int:
    return len(_compressor(dictionary).compress(text.encode("utf-8", "surrogatepass")))


def cores(text: str) -> list[tuple[int, int]]:
    """Spans of runs of lines with a cue; of a longer line the sentences around each cue."""
    out: list[list[int]] = []
    for m in re.finditer(CUE, text):
        lo = max(text.rfind("\n", 0, m.start()) + 1, m.start() - REACH)
        hi = text.find("\n", m.end())
        hi = min(len(text) if hi < 0 else hi, m.end() + REACH)
        stops = [s.end() for s in SENTENCE.finditer(text, lo, m.start())]
        lo = stops[-1] if stops else lo
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def blocks(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Candidate blocks and the runs of cue lines in them: each run with ``REACH`` characters on both sides, to whole words;
    those that meet are one block."""
    out: list[list] = []
    for a, b in cores(text):
        lo, hi = max(0, a - REACH), min(len(text), b + REACH)
        while 0 < lo < a and text[lo - 1].isalnum():
            lo += 1
        while b < hi < len(text) and text[hi].isalnum():
            hi -= 1
        if out and lo < out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
            out[-1][2].append((a, b))
        else:
            out.append([lo, hi, [(a, b)]])
    return [tuple(x) for x in out]


def _spdx(block: str) -> list[tuple[int, int, str]]:
    """Span and identifier of each license that an SPDX line names; what follows WITH is no license."""
    out = []
    for m in SPDX.finditer(block):
        at, due = m.end(), True
        while t := _TOKEN.match(block, at):
            at, w = t.end(), t[1]
            if w in "()":
                continue
            if w.upper() in ("AND", "OR", "WITH"):
                due = w.upper() != "WITH"
                if not due and (t := _TOKEN.match(block, at)):
                    at = t.end()
                continue
            if not due:
                break
            w, due = w.rstrip(".:-"), False
            if w.upper() in ("NONE", "NOASSERTION"):
                continue
            base = re.sub(r"(?i)(-only|-or-later|\+)$", "", w).lower()
            out.append((m.start(), t.start(1) + len(w), next((n for n, _ in TEMPLATES if n.lower() == base), w)))
    return out


def _row(a: int, b: int, block: str, license: str, number: int, wording: str, verdict: str, missing=(), added=()) -> tuple:
    whole, size = _size(block[a:b]), _size(block[a:b], wording)
    return a, b, license, number, whole, size, (whole - size) / whole, verdict, " ".join(missing), " ".join(added)


@lru_cache(maxsize=5_000)
def judge(block: str, runs: tuple[tuple[int, int], ...]) -> list[tuple]:
    """Start, end, license, template number, plain and conditional bytes, gain, verdict, missing and added words of
    every notice in one block.

    A template that stands in the block word for word is ``exact`` if it reduces its span by ``GAIN`` or more and no template that
    saves more bytes holds its place; so is each license of an SPDX line (number -1). Around the ``runs`` of cue lines that are left, templates of which a share of
    ``SHARE`` of the words or more stands in order, without a difference in versions or ``TELLING`` words, and that reduce
    this span's size by ``GAIN`` or more, are ``modified``: the greatest gain first, then the place in the list, without
    overlaps. A wording that several licenses share names them all, with OR."""
    at = [m.span() for m in WORDS.finditer(block)]
    have = [block[a:b].lower() for a, b in at]
    text, found = " " + " ".join(have) + " ", []
    heads = {}
    n = 0
    for j, w in enumerate(have):
        heads[n] = j
        n += len(w) + 1
    for i, (_, want) in enumerate(_KNOWN):
        key, p = " " + " ".join(want) + " ", -1
        while (p := text.find(key, p + 1)) >= 0:
            lo = heads[p]
            if i < len(TEMPLATES) or _fills_line(block, at[lo][0], at[lo + len(want) - 1][1]):
                found.append((lo, lo + len(want), i))
    found = _ranked([(*_saved(block[slice(*_ends(block, at, lo, hi))], i), lo, hi, i) for lo, hi, i in found])
    out = [(*_ends(block, at, lo, hi), *_row(*_ends(block, at, lo, hi), block, _NAMES[i], i, (TEMPLATES + TITLES)[i][1], "exact")[2:]) for lo, hi, i in found]
    out += [_row(a, b, block, name, -1, "SPDX-License-Identifier: " + name, "exact") for a, b, name in _spdx(block)]
    taken = [(lo, hi) for lo, hi, _ in found]
    starts = [a for a, _ in at]
    for a, b in runs:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        todo = _free(taken, max(0, i - _LONGEST), min(len(have), j + _LONGEST))
        while todo:
            lo, hi = todo.pop()
            best = _modified(block, at, have, lo, hi) if lo < j and i < hi else None
            if best:
                out.append(best[0])
                insort(taken, best[1:])
                todo += [x for x in ((lo, best[1]), (best[2], hi)) if x[0] < x[1]]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _saved(span: str, i: int) -> tuple[int, float]:
    """Bytes that template ``i`` saves of a span, both in lower case as words are compared, and their share of what an empty frame
    leaves of its size."""
    span = span.lower()
    whole = _size(span)
    saved = whole - _size(span, (TEMPLATES + TITLES)[i][1].lower())
    return saved, saved / max(1, whole - _size(""))


def _ranked(found: list[tuple[int, float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (lo, hi, template) of those (saved, gain, lo, hi, template) that gain ``GAIN`` or more: the one that saves most first, then
    those that neither lie in one taken before nor hold one. In order; their ends rise as their starts do."""
    out: list[tuple[int, int, int]] = []
    for _, _, lo, hi, i in sorted((f for f in found if f[1] >= GAIN), key=lambda f: (-f[0], f[2], -f[3], f[4])):
        k = bisect_right(out, lo, key=lambda x: x[0])
        if k and (out[k - 1][1] >= hi or out[k - 1][0] == lo) or k < len(out) and out[k][1] <= hi:
            continue
        out.insert(k, (lo, hi, i))
    return out


def _free(taken: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """The parts of lo to hi that no span of ``taken`` covers; no span lies in another one, so starts and ends are in order."""
    out = []
    for k in range(bisect_right(taken, lo, key=lambda x: x[1]), bisect_left(taken, hi, key=lambda x: x[0])):
        a, b = taken[k]
        if a > lo:
            out.append((lo, a))
        lo = max(lo, b)
    return [*out, (lo, hi)] if lo < hi else out


def _modified(block: str, at: list[tuple[int, int]], have: list[str], lo: int, hi: int) -> tuple | None:
    """The row of the template that reduces its span in words lo to hi most, and that span."""
    best = None
    count, matcher = Counter(have[lo:hi]), None
    for i in range(len(TEMPLATES)):
        want = _KNOWN[i][1]
        if sum((_COUNTS[i] & count).values()) < SHARE * len(want):
            continue
        if matcher is None:
            matcher = SequenceMatcher(None, autojunk=False)
            matcher.set_seq2(have[lo:hi])
        d = _difference(want, have[lo:hi], matcher)
        if d[0] != "modified" or _VERSIONS[i] & set(d[1]) or TELLING & {*d[1], *d[2]}:
            continue
        x, y = d[3]
        r = _row(*_ends(block, at, lo + x, lo + y), block, _NAMES[i], i, TEMPLATES[i][1], "modified", d[1], d[2])
        if r[6] >= GAIN and (best is None or r[6] > best[0][6]):
            best = r, lo + x, lo + y
    return best


@lru_cache(maxsize=20_000)
def rejected(core: str) -> tuple:
    """The row of cue lines without a notice: that of the template which reduces their size most."""
    i = min(range(len(TEMPLATES)), key=lambda i: (_size(core, TEMPLATES[i][1]), i))
    d = _difference(_KNOWN[i][1], [w.lower() for w in WORDS.findall(core)])
    return _row(0, len(core), core, TEMPLATES[i][0], i, TEMPLATES[i][1], "rejected", d[1], d[2])[2:]


def _fills_line(block: str, a: int, b: int) -> bool:
    end = block.find("\n", b)
    before, after = block[block.rfind("\n", 0, a) + 1 : a], block[b : len(block) if end < 0 else end]
    return not re.sub(r"(?i)\bthe\b", "", before).strip("#*/-=_<>!;:.()[]\"' \t\r") and not after.strip("#*/-=_<>!;:.()[]\"' \t\r")


def _ends(block: str, at: list[tuple[int, int]], lo: int, hi: int) -> tuple[int, int]:
    return at[lo][0], re.compile(r"[.,;:!?)\]\"']*").match(block, at[hi - 1][1]).end()


def _difference(want: list[str], have: list[str], matcher: SequenceMatcher | None = None) -> tuple:
    """Verdict, missing and added words, and the span of the words that match; words that match far from the others
    are left out where the others alone do better."""
    n = len(want)
    matcher = matcher or SequenceMatcher(None, b=have, autojunk=False)
    matcher.set_seq1(want)
    parts = matcher.get_matching_blocks()[:-1]
    if not parts:
        return "rejected", want, [], (0, 0)
    runs = []
    for i in range(len(parts)):
        same = 0
        for j in range(i, len(parts)):
            same += parts[j].size
            span = parts[j].b + parts[j].size - parts[i].b
            runs.append((span - same <= n, same, -span, i, j))
    near, same, _, i, j = max(runs)
    parts = parts[i : j + 1]
    missing = [w for i, w in enumerate(want) if not any(p.a <= i < p.a + p.size for p in parts)]
    lo, hi = parts[0].b, parts[-1].b + parts[-1].size
    added = [w for j, w in enumerate(have[lo:hi], lo) if not any(p.b <= j < p.b + p.size for p in parts)]
    return ("modified" if near and same >= SHARE * n else "rejected"), missing, added, (lo, hi)


def notices(text: str) -> list[tuple]:
    """Rows of one text, from ``start`` on: notices, and cue lines that none of them overlaps as ``rejected``.

    The sentence that BSD licenses share is told by the conditions that follow it; without them it names them all."""
    out = []
    for lo, hi, runs in blocks(text):
        rows = [(lo + r[0], lo + r[1], *r[2:]) for r in judge(text[lo:hi], tuple((a - lo, b - lo) for a, b in runs))]
        for a, b in runs:
            if not any(r[0] < b and a < r[1] for r in rows):
                out.append((a, b, *rejected(text[a:b])))
        for r in rows:
            if r[3] >= 0 and (TEMPLATES + TITLES)[r[3]][1] == BSD:
                rest = text[r[1] : r[1] + REACH]
                if BSD_THIRD.search(rest):
                    r = (*r[:2], "BSD-3-Clause", *r[3:])
                elif BSD_SECOND.search(rest):
                    r = (*r[:2], "BSD-2-Clause", *r[3:])
            out.append(r)
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


SCAN = "doc_id long, start long, end long, license string, template int, plain_bytes int, conditional_bytes int, gain double, verdict string, missing string, added string"


def license_blocks(docs: DataFrame) -> DataFrame:
    """One row for each notice in each whole text of ``docs`` (doc_id, text), several a block if it has them, and for each
    run of cue lines without one: its span in code points, the license, sizes, gain, verdict and the words that it misses
    or adds.

    Null and empty texts, and those without a cue, have no row; repeated rows give their rows each; a null doc_id is
    kept. Texts without a cue don't leave the JVM; equal blocks are judged once a worker."""
    names = [f.split()[0] for f in SCAN.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *r) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for r in notices(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").rlike(CUE))
    return some.mapInArrow(run, SCAN)


def licenses(scanned: DataFrame) -> DataFrame:
    """``doc_id, licenses``: the confirmed licenses of each document that has some, in order of name."""
    return scanned.filter("verdict <> 'rejected'").groupBy("doc_id").agg(F.array_sort(F.collect_set("license")).alias("licenses"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of every whole text of ``documents``; edge cases as in license_blocks."""
    return license_blocks(texts(spark, sf_dir))
