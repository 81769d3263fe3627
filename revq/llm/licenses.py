"""License scans by patience alignment against license notices.

Text and template are words (lower case, outer punctuation off). Words that
occur once in both are anchors; the longest increasing subsequence of their
positions keeps the order; the gaps between anchors, and what stands before
and after, are aligned in the same way, equal words at a gap's ends first.
Coverage is the share of a template's words that are aligned.

Coverage alone cannot tell one-line notices apart. So the words that name a
license, its version and its variant (``TELLING``) must be aligned, and a word
that names another one (``FOREIGN``) must not stand in the span. Half of the
span's words at least are aligned ones.

Words that only licenses use (``CUES``) tell where to align: a window of the
template's length and slack at each start that a cue gives, and the reach of
each stretch of cues. Windows overlap, so no notice is cut by a cue beside it;
those with too few of the template's words are skipped unaligned. The best
coverage is taken first (last, if it has words of two notices), its span is
removed, and what it leaves of the windows that met it is aligned again. Texts
without cues cost one set look-up a word. One scan, no shuffle; the templates
are a fixed small list.

Nulls and odd input: a null or empty text holds no license; each repetition of
a notice is found by itself; equal coverage goes to the name that sorts first;
very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from revq.llm.common import in_tasks

COVER, DENSE = 0.75, 0.5  # least share of a template's words, and of a span's words, that are aligned
# fixed values: public license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "ISC": "Released under the ISC License.",
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-line": "Released under the BSD License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS "
        "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
    "CC0-1.0-line": "Released under CC0 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
# words of a template that tell it from its like: each must be aligned
TELLING = {
    "Apache-2.0": "apache 2.0", "Apache-2.0-header": "apache 2.0", "GPL-2.0": "gnu general 2", "GPL-2.0-header": "general 2", "GPL-3.0": "gnu general 3",
    "GPL-header": "general 3", "LGPL-2.1": "lesser 2.1", "LGPL-2.1-header": "lesser 2.1", "LGPL-3.0": "lesser 3", "LGPL-3.0-header": "lesser 3",
    "AGPL-3.0": "affero 3", "AGPL-3.0-header": "affero 3", "MPL-2.0": "mozilla 2.0", "MPL-2.0-header": "mozilla 2.0", "MIT": "mit", "MIT-full": "hereby granted sublicense",
    "ISC": "isc", "ISC-full": "fee hereby granted", "BSD-line": "bsd", "BSD": "redistribution redistributions", "BSD-2-Clause-full": "reproduce",
    "BSD-3-Clause-full": "reproduce neither endorse", "Unlicense": "unencumbered domain", "Zlib": "as-is alter", "BSL-1.0": "boost 1.0", "CC0-1.0": "cc0 waived",
    "CC0-1.0-line": "cc0", "CC-BY-4.0": "attribution 4.0", "CC-BY-4.0-line": "by 4.0", "CC-BY-SA-4.0": "attribution-sharealike 4.0", "CC-BY-SA-4.0-line": "by-sa 4.0",
    "CC-BY-ND-4.0": "attribution-noderivatives 4.0", "CC-BY-ND-4.0-line": "by-nd 4.0", "CC-BY-NC-4.0-long": "attribution-noncommercial 4.0", "CC-BY-NC-4.0": "by-nc 4.0",
    "CC-BY-NC-SA-4.0": "attribution-noncommercial-sharealike 4.0", "CC-BY-NC-SA-4.0-line": "by-nc-sa 4.0",
    "CC-BY-NC-ND-4.0": "attribution-noncommercial-noderivatives 4.0", "CC-BY-NC-ND-4.0-line": "by-nc-nd 4.0", "All-rights-reserved": "rights reserved",
}
# words of other licenses: one inside a span that its template does not have says that the notice is not this one
FOREIGN = frozenset(
    "apache gnu lesser affero library mozilla mpl mit isc bsd boost cc0 unlicense lgpl agpl gpl eclipse artistic sharealike share-alike noncommercial "
    "non-commercial noderivatives no-derivatives noderivs by-nc by-sa by-nd by-nc-sa by-nc-nd attribution-sharealike attribution-noncommercial "
    "attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives endorse".split()
)
CUES = frozenset(
    "license licensed licenses apache gnu mit by-nc creative commons reserved redistribution redistributions sublicense copyright "
    "permission redistribute cc rights released bsd mozilla isc cc0 affero lesser unencumbered by-sa by-nd by-nc-sa by-nc-nd".split()
)
REACH = 60  # words of a stretch around a cue, at least


def norm(words: list[str]) -> list[str]:
    return [w.lower().strip(".,;:()\"'") for w in words]


def increasing(seq: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(seq)
    for i, x in enumerate(seq):
        p = bisect_left(tops, x)
        back[i] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[p], piles[p] = x, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], form: list[str]) -> list[tuple[int, int]]:
    """Aligned (text position, template position) pairs, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(form))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == form[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == form[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once_form = {w for w, n in Counter(form[c:d]).items() if n == 1}
        once_text = {w for w, n in Counter(w for w in text[a:b] if w in once_form).items() if n == 1}
        if not once_text:
            continue
        at_text = {w: i for i, w in enumerate(text[a:b], a) if w in once_text}
        anchors = [(at_text[w], j) for j, w in enumerate(form[c:d], c) if w in once_text]
        kept = [anchors[i] for i in increasing([i for i, _ in anchors])]
        out.extend(kept)
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True))
    return sorted(out)


FORMS = {name: norm(text.split()) for name, text in TEMPLATES.items()}
NEEDED = {name: [{j for j, w in enumerate(FORMS[name]) if w == t} for t in TELLING[name].split()] for name in TEMPLATES}


def identifier(name: str) -> str:
    """The license that a template is a notice of."""
    return {"GPL-header": "GPL-3.0"}.get(name) or re.sub("-(full|header|line|long)$", "", name)


def _is_own(name: str, pairs: list[tuple[int, int]], words: list[str]) -> bool:
    """Whether an alignment is this template's: all telling words aligned, no other license's word in the span, and dense."""
    got = {j for _, j in pairs}
    if any(not (places & got) for places in NEEDED[name]):
        return False
    first, last = pairs[0][0], pairs[-1][0]
    form = set(FORMS[name])
    return len(pairs) >= DENSE * (last - first + 1) and not any(w in FOREIGN and w not in form for w in words[first : last + 1])


def licenses_of(text: str | None) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, last word) of the notices in a text, in text order.

    Of notices that lie one in the other only the one with more aligned words
    is given: a text of one license holds most words of a shorter one.
    """
    raw = (text or "").split()
    cues = [i for i, w in enumerate(raw) if w.lower().strip(".,;:()\"'") in CUES]
    out: list[tuple[str, float, int, int]] = []
    if not cues:
        return out
    words = norm(raw)
    found: list[tuple[int, str, int, int]] = []
    for name, form in FORMS.items():
        here = [i for i in cues if words[i] in form]
        found.extend((n, name, first, last) for n, first, last in _notices(here, words, name))
    found.sort(key=lambda x: (-x[0], -x[0] / len(FORMS[x[1]]), x[1]))
    for n, name, first, last in found:
        if not any(min(last, z) - max(first, a) + 1 > 0.5 * (min(last - first, z - a) + 1) for _, _, a, z in out):
            out.append((name, round(n / len(FORMS[name]), 6), first, last))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def _notices(cues: list[int], words: list[str], name: str) -> list[tuple[int, int, int]]:
    """(aligned words, first, last) of a template's notices: best coverage first, then the shortest, none over another."""
    form = FORMS[name]
    least, most = COVER * len(form), Counter(form)
    heap: list[tuple[int, int, int, int, int, bool]] = []
    missed: list[tuple[int, int]] = []  # windows with the words, but not in order: a neighbour may hide the notice
    taken: list[tuple[int, int, int]] = []  # (first, last, aligned words) in text order
    close: list[tuple[int, int]] = []  # (first, last) of alignments too short to hold two notices

    def consider(a: int, b: int) -> None:
        pairs = align(words[a:b], form)
        if len(pairs) < least or not _is_own(name, pairs, words[a:b]):
            insort(missed, (a, b))
            return
        first, last = a + pairs[0][0], a + pairs[-1][0]
        x, y = _core([i for i, _ in pairs])
        heappush(heap, (-len(pairs), last - first, first, a, b, (a + x, a + y) != (first, last)))
        if (a + x, a + y) != (first, last) and _in_common(words[a + x : a + y + 1], most) >= least:
            consider(a + x, a + y + 1)
        if last - first + 1 < 2 * least and (first, last) not in close[(k := bisect_left(close, (first, last))) : k + 1]:
            close.insert(k, (first, last))

    def several(first: int, last: int) -> bool:
        """Whether an alignment has words of two notices or more."""
        lo, hi = bisect_left(close, (first - ceil(2 * least),)), bisect_left(close, (last,))
        met = [(y, z) for y, z in close[lo:hi] if z > first and _apart(taken, y, z)]
        return bool(met) and met[-1][0] > min(z for _, z in met)

    def free(a: int, b: int) -> list[tuple[int, int]]:
        """What taken spans leave of a window."""
        out, k = [], bisect_left(taken, (a,))
        if k and taken[k - 1][1] >= a:
            k -= 1
        while k < len(taken) and taken[k][0] < b:
            out.append((a, taken[k][0]))
            a, k = taken[k][1] + 1, k + 1
        return [(x, y) for x, y in [*out, (a, b)] if _in_common(words[x:y], most) >= least]

    windows = _windows(cues, words, form)
    longest = max((b - a for a, b in windows), default=0)
    for a, b in windows:
        consider(a, b)
    joined: list[tuple[int, int, int, int, int, bool]] = []
    while heap or joined:
        if not heap:  # nothing else is left in their place
            heap, joined = joined, []
            close.clear()
        n, far, first, a, b, loose = heappop(heap)
        if (rest := free(a, b)) != [(a, b)]:
            for x, y in rest:
                consider(x, y)
        elif (loose or far + 1 >= 2 * least) and several(first, first + far):
            heappush(joined, (n, far, first, a, b, loose))
        else:
            insort(taken, (first, first + far, -n))
            lo, hi = bisect_left(missed, (first - longest,)), bisect_left(missed, (first + far + 1,))
            again, missed[lo:hi] = missed[lo:hi], []
            for a, b in again:
                for x, y in free(a, b):
                    consider(x, y)
    return [(n, first, last) for first, last, n in taken]


def _core(at: list[int]) -> tuple[int, int]:
    """The stretch with most aligned words above the others in it: stray words at the ends are left out."""
    best, total, start, out = 0, 0, at[0], (at[0], at[-1])
    for before, i in zip([at[0] - 1, *at[:-1]], at, strict=True):
        total -= i - before - 1
        if total <= 0:
            total, start = 0, i
        total += 1
        if total > best or (total == best and (start, i) == (at[0], at[-1])):
            best, out = total, (start, i)
    return out


def _apart(taken: list[tuple[int, int, int]], first: int, last: int) -> bool:
    """Whether no taken span meets this one."""
    k = bisect_left(taken, (first,))
    return (not k or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last)


def _in_common(part: list[str], most: Counter) -> int:
    """Words that a part has in common with a template, in any order."""
    return sum(min(n, most[w]) for w, n in Counter(w for w in part if w in most).items())


def _windows(cues: list[int], words: list[str], form: list[str]) -> list[tuple[int, int]]:
    """Windows that hold enough words of the template: a template's length and slack
    where a cue puts its start, and the reach of each stretch of cues."""
    at, most, least = {}, Counter(form), COVER * len(form)
    for j, w in enumerate(form):
        at.setdefault(w, []).append(j)
    slack = len(form) // 3 + 1
    out = set()
    have, common, lo, hi = Counter(), 0, 0, 0
    for start in sorted({i - j for i in cues for j in at[words[i]]}):
        a, b = max(0, start - slack), min(len(words), max(0, start + len(form) + slack))
        if a >= hi:
            have, common, lo, hi = Counter(), 0, a, a
        for w in words[hi:b]:
            have[w] += 1
            common += have[w] <= most[w]
        for w in words[lo:a]:
            have[w] -= 1
            common -= have[w] < most[w]
        lo, hi = a, max(hi, b)
        if common >= least:
            out.add((a, b))
    groups = _stretches(cues, words, form)
    for before, group, after in zip([[-1], *groups], groups, [*groups[1:], [len(words)]], strict=False):
        a, b = max(0, group[0] - len(form)), min(len(words), group[-1] + len(form) + 1)
        for x, y in ((a, b), (max(before[-1] + 1, a), min(after[0], b))):
            if _in_common(words[x:y], most) >= least:
                out.add((x, y))
    return sorted(out)


def _stretches(cues: list[int], words: list[str], form: list[str]) -> list[list[int]]:
    """Cues of one notice: a new stretch where a cue repeats beyond its count in the template, or far away."""
    most, out, seen = Counter(form), [], Counter()
    for i in cues:
        w = words[i]
        if not out or i - out[-1][-1] > max(REACH, len(form)) or seen[w] >= most[w]:
            out.append([])
            seen = Counter()
        out[-1].append(i)
        seen[w] += 1
    return out


OUT = "doc_id long, spans array<struct<license:string,identifier:string,coverage:double,first:int,last:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("license", pa.string()), ("identifier", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        found = [
            [{"license": n, "identifier": identifier(n), "coverage": c, "first": a, "last": b} for n, c, a, b in licenses_of(t)] for t in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row: the license notices found, with coverage and word positions."""
    return docs.select("doc_id", "text").transform(in_tasks, _scan, OUT)
