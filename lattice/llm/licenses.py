"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is normalised (lower case, words only, one spelling of "license"), and stretches of its words are compared with
the templates wherever they begin and end: within a line, over several lines, within a paragraph. With n bigrams in a
template and m in a stretch, the Dice coefficient can reach the threshold t only if n * t / (2 - t) <= m <= n * (2 - t) / t
and at least n * t / (2 - t) of the template's bigrams are there. So a template is looked at only in texts that hold one of
its rarest bigrams (as many as a match cannot do without), and a stretch begins and ends with a bigram that counts.

Of overlapping matches the better one is kept (then the longer, then the first), over all stretches and templates.
A match ends with the punctuation that closes its last word.

Nulls count as empty text, which matches nothing. Whole texts are read.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from bisect import bisect_right, insort
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, rows_out, ship, text_of
from lattice.llm.license_texts import TEXTS

#: Notices that follow no common form, and short licences. A version stated without "or later" is named without it.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    ],
    "AGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0-or-later": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
    ],
}

_FRAMES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Published under {}.", "Available under {}.", "This work is licensed under {}.", "The terms of {}.", "Under {}.")

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

_GNU = {"GPL": ("General", ("1", "2", "3")), "LGPL": ("Lesser General", ("2.1", "3")), "AGPL": ("Affero General", ("3",)), "GFDL": ("Free Documentation", ("1.2", "1.3"))}


def _names() -> dict[str, list[str]]:
    """By licence: what notices call it."""
    out = {
        "MIT": ["MIT License", "MIT", "Expat License", "MIT/X11 License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0", "Apache Software License, Version 2.0"],
        "BSD": ["BSD License", "BSD-style License"],
        "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD License", "BSD 2-Clause", "Simplified BSD License", "FreeBSD License"],
        "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD License", "BSD 3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License"],
        "ISC": ["ISC License", "ISC"],
        "Zlib": ["zlib License"],
        "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
        "Artistic": ["Artistic License"],
        "Artistic-2.0": ["Artistic License 2.0"],
        "Unlicense": ["Unlicense"],
        "EUPL-1.2": ["European Union Public License 1.2", "EUPL 1.2", "EUPL v1.2"],
        "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal License", "Creative Commons Zero License", "Creative Commons CC0 1.0 Universal License"],
    }
    for short, long, versions in (("MPL", "Mozilla Public License", ("1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("CDDL", "Common Development and Distribution License", ("1.0", "1.1"))):
        out[short] = [long, short]
        for v in versions:
            out[f"{short}-{v}"] = [f"{long}, version {v}", f"{long} v. {v}", f"{long} v{v}", f"{long} {v}", f"{short} {v}", f"{short} v{v}"]
    for short, (kind, versions) in _GNU.items():
        long = f"GNU {kind} License" if short == "GFDL" else f"GNU {kind} Public License"
        out[short] = [long, long.removeprefix("GNU "), f"GNU {short}", short]
        for v in versions:
            v, name = v.removesuffix(".0"), f"{short}-{v if '.' in v else v + '.0'}"
            said = []
            for x in [v] if "." in v else [v, f"{v}.0"]:
                said += [f"{n}{by}{x}" for n in (long, long.removeprefix("GNU "), f"GNU {short}", short) for by in (", version ", " v", " ")] + [f"{short}v{x}"]
            out[name] = [*said, f"version {v} of the {long}"]
            out[f"{name}-or-later"] = [n + end for n in said for end in (" or later", " or any later version", " or (at your option) any later version")] + [f"version {v} or later of the {long}"]
    for short, long in _CC.items():
        for v in ("", " 1.0", " 2.0", " 2.5", " 3.0", " 4.0"):
            said = [f"CC {short}{v}", f"CC {short}{v} License", f"Creative Commons {short}{v} License"]
            for words_of in {long, long.replace("NoDerivatives", "NoDerivs")}:
                said += [f"Creative Commons {words_of}{v}{end}" for end in ("", " License", *([f" {port} License" for port in ("Unported", "Generic", "International")] if v else []))]
            out[f"CC-{short}{v.replace(' ', '-')}"] = said
    return out


def _notices() -> dict[str, list[str]]:
    """Notices by licence: each name in each form, with and without an article, where the form alone can't pass for the notice."""
    out: dict[str, list[str]] = {}
    for licence, names in _names().items():
        found: dict[tuple[str, ...], str] = {}
        for name in names:
            own = len(words(name))
            articles = ("the ", "a ", "") if "Creative Commons" in name else ("the ", "")
            for frame in (f.format(a + name) for f in _FRAMES for a in articles):
                w = words(frame)
                around = len(w) - 1 - own  # bigrams that say nothing of the licence
                if frame.startswith("Under ") and own > 1 or 3 * around >= 2 * (len(w) - 1):
                    continue
                found.setdefault(tuple(w), frame)
        identifier = f"SPDX-License-Identifier: {licence}"
        if licence not in ("BSD", "GPL", "LGPL", "AGPL", "GFDL", "MPL", "EPL", "CDDL"):
            frame = identifier if len(words(licence)) > 1 else identifier.removeprefix("SPDX-")
            found.setdefault(tuple(words(frame)), frame)
        out[licence] = list(found.values())
    for short in _CC:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{short}-{v}"].append(f"https://creativecommons.org/licenses/{short.lower()}/{v}/")
    out["CC0-1.0"].append("https://creativecommons.org/publicdomain/zero/1.0/")
    return out


_WORD = re.compile(r"\w+")
_CLOSING = re.compile(r"[^\w\s]+(?=\s|\Z)")


def _folded(text: str) -> str:
    """Lower case and one spelling of "license", every character in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("licence", "license")


def words(text: str) -> list[str]:
    return _WORD.findall(_folded(text))


def dice(a: Counter, b: Counter) -> float:
    n, m = a.total(), b.total()
    if len(b) < len(a):
        a, b = b, a
    return 2 * sum(min(c, b[g]) for g, c in a.items() if g in b) / (n + m) if n + m else 0.0


def wordings() -> dict[str, list[str]]:
    """Every template by licence: short licences and notices, notices of the common forms, whole texts."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, texts in _notices().items():
        out.setdefault(name, []).extend(texts)
    for name, text in TEXTS.items():
        out.setdefault(name, []).append(text)
    return out


@dataclass
class Match:
    license: str
    dice: float
    begin: int  # in characters
    end: int


class Scanner:
    def __init__(self, threshold: float = 0.8, templates: dict[str, list[str]] | None = None):
        self.threshold = threshold
        self.templates = []  # (size, licence, bigrams), by size
        for name, texts in (templates or wordings()).items():
            for t in texts:
                w = words(t)
                grams = Counter(zip(w, w[1:], strict=False))
                if grams:
                    self.templates.append((grams.total(), name, grams))
        self.templates.sort(key=lambda t: (t[0], t[1]))
        sizes = [n for n, _, _ in self.templates]
        self.least = [max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)) for n in sizes]  # of its bigrams in a match
        self.most = [math.floor(n * (2 - threshold) / threshold + 1e-9) for n in sizes]  # bigrams of a match
        shared = Counter(g for _, _, grams in self.templates for g in grams)
        self.known = set(shared)
        self.bounds = dict(zip(sizes, zip(self.least, self.most, strict=True), strict=True))  # by size
        self.anchors: dict[tuple[str, str], dict[int, list[int]]] = {}  # by size; a match of a template holds at least one of its anchors
        for t, (n, _, grams) in enumerate(self.templates):
            free = n - self.least[t]
            for g in sorted(grams, key=lambda g: (shared[g], -len(g[0]) - len(g[1]), g)):
                self.anchors.setdefault(g, {}).setdefault(n, []).append(t)
                free -= grams[g]
                if free < 0:
                    break

    def _bound(self, t: int, left: dict[tuple[str, str], int]) -> float:
        """No match of the template has a higher Dice, where `left` counts the text's known bigrams; 0 if there is none."""
        n, _, grams = self.templates[t]
        if len(left) < len(grams):
            most = sum([min(c, grams[g]) for g, c in left.items() if g in grams])
        else:
            most = sum([min(left[g], c) for g, c in grams.items() if g in left])
        return 2 * most / (n + most) if most >= self.least[t] else 0.0

    def _places(self, t: int, at: dict[tuple[str, str], list[int]], gone: bytearray) -> tuple:
        """Where the template's bigrams are, for each the place from which on a stretch has fewer than the template of them before it, how many a match from there can hold, and where one may begin."""
        import numpy as np

        grams, hits = self.templates[t][2], []
        small, large = (at, grams) if len(at) < len(grams) else (grams, at)
        for g in small:
            if g in large:
                here, c = [p for p in at[g] if not gone[p]], grams[g]
                hits += [(p, here[i - c] if i >= c else -1) for i, p in enumerate(here)]
        hits.sort()
        places, before = np.array([p for p, _ in hits]), np.array([b for _, b in hits])
        reach = np.searchsorted(places, places + self.most[t]) - np.arange(len(places))
        return places, before, reach, np.flatnonzero(reach >= self.least[t])

    def _stretch(self, t: int, found: tuple, i: int, limit: int) -> tuple[float, int] | None:
        """The best (then longest) stretch that begins at the template's i-th place and has its bigrams before the limit: Dice, last bigram."""
        import numpy as np

        places, before, _, _ = found
        first = places[i]
        j = int(np.searchsorted(places, min(first + self.most[t], limit)))
        counts = before[i:j] < first
        d = np.where(counts, 2 * np.cumsum(counts) / (self.templates[t][0] + places[i:j] - first + 1), 0)
        if not len(d) or d.max() < self.threshold:
            return None
        k = len(d) - 1 - int(d[::-1].argmax())
        return float(d[k]), int(places[i + k])

    def scan(self, text: str) -> list[Match]:
        """Non-overlapping matches, in the order of the text."""
        folded = _folded(text)
        w, known = _WORD.findall(folded), self.known
        hits = [(p, g) for p, g in enumerate(zip(w, w[1:], strict=False)) if g in known]
        at: dict[tuple[str, str], list[int]] = {}
        for p, g in hits:
            at.setdefault(g, []).append(p)
        near: dict[int, bool] = {}  # by size: are as many known bigrams as a match needs anywhere close enough?
        active: set[int] = set()
        for g in at:
            for n, templates in self.anchors.get(g, {}).items():
                if n not in near:
                    least, most = self.bounds[n]
                    near[n] = any(q[0] - p[0] < most for p, q in zip(hits, hits[least - 1 :], strict=False))
                if near[n]:
                    active.update(templates)
        if not active:
            return []
        left = {g: len(places) for g, places in at.items()}
        # (-Dice, -length, begin, licence, template, place, limit, last bigram); not yet compared: the most that is possible,
        # with no place for a template as a whole, and no last bigram
        queue: list[tuple] = [(-d, -math.inf, -1, "", t, -1, 0, -1) for t in active if (d := self._bound(t, left))]
        if not queue:
            return []
        heapq.heapify(queue)
        spans = [m.span() for m in _WORD.finditer(folded)]
        found: dict[int, tuple] = {}
        gone = bytearray(len(w))  # bigrams that share a word with a match
        taken: list[tuple[int, int, str, float]] = []  # first word, last word, licence, Dice; by place
        while queue:
            d, _, begin, name, t, i, limit, last = heapq.heappop(queue)
            if i < 0:
                if (now := self._bound(t, left)) < -d:
                    if now:
                        heapq.heappush(queue, (-now, -math.inf, -1, "", t, -1, 0, -1))
                    continue
                n = self.templates[t][0]
                places, _, reach, starts = found[t] = self._places(t, at, gone)
                for i in starts.tolist():
                    best = min(n, int(reach[i]))
                    heapq.heappush(queue, (-2 * best / (n + best), -math.inf, spans[places[i]][0], "", t, i, len(w), -1))
                continue
            first = int(found[t][0][i])
            after = bisect_right(taken, (first, math.inf))
            if after and taken[after - 1][1] >= first:
                continue
            if after < len(taken) and taken[after][0] - 1 < limit:  # the stretch must end before the next match
                limit = taken[after][0] - 1
                last = -1 if last >= limit else last
            if last >= 0:
                insort(taken, (first, last + 1, name, -d))
                for p in range(max(first - 1, 0), min(last + 2, len(w) - 1)):
                    g = w[p], w[p + 1]
                    if g in left and not gone[p]:
                        left[g] -= 1
                    gone[p] = 1
            elif best := self._stretch(t, found[t], i, limit):
                heapq.heappush(queue, (-best[0], begin - spans[best[1] + 1][1], begin, self.templates[t][1], t, i, limit, best[1]))
        out = []
        for first, last, name, d in taken:
            end = spans[last][1]
            closing = _CLOSING.match(text, end)
            out.append(Match(name, d, spans[first][0], closing.end() if closing else end))
        return out


@functools.lru_cache(maxsize=4)
def _scanner(threshold: float) -> Scanner:
    return Scanner(threshold)


def scan(spark: SparkSession, df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_matches, license and dice of the best match (null without one), licenses (all, sorted), begin and n_chars of the best.

    One row a document; nothing is shuffled.
    """
    import pyarrow as pa

    ship(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_matches", pa.int32()), ("license", pa.string()), ("dice", pa.float64()), ("licenses", pa.list_(pa.string())), ("begin", pa.int32()), ("n_chars", pa.int32())])

    def run(batches):
        s = _scanner(threshold)
        for b in batches:
            out = []
            for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                found = s.scan(text)
                best = min(found, key=lambda m: (-m.dice, m.begin - m.end, m.begin)) if found else None
                row = (best.license, round(best.dice, 6), sorted({m.license for m in found}), best.begin, best.end - best.begin) if best else (None, None, [], None, None)
                out.append((doc, len(found), *row))
            yield from rows_out(schema, out)

    rows = columns_only(df, "doc_id", "text").select(F.col("doc_id").cast("long"), text_of("text"))
    return rows.mapInArrow(run, "doc_id long, n_matches int, license string, dice double, licenses array<string>, begin int, n_chars int")
