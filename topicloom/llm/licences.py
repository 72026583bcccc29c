"""Licence scans: stretches of text compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"\n|(?<=[.!?;])\s+")
#: Spellings that count as one word.
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "noncommercial": "nc"}
#: A version's short form, which stands for "version" and its number.
_VERSION = re.compile(r"\bv(?:er)?\.?\s?(?=\d)", re.I)

_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices and short licence texts as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This software is released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL": ("Licensed under the GNU General Public License.",),  # without a version that is known
    "LGPL": ("Licensed under the GNU Lesser General Public License.",),
    "AGPL": ("Licensed under the GNU Affero General Public License.",),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        _BSD_TERMS + _BSD_WARRANTY,
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY,
    ),
    "BSD": (  # the sentence that all its variants begin with
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Apache-1.0": ("Licensed under the Apache License, Version 1.0.",),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.",),
    "CC-BY-3.0": ("Licensed under CC BY 3.0.",),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0.",),
    "CC-BY-NC-3.0": ("Licensed under CC BY-NC 3.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",),
    "CC-BY-NC-SA-3.0": ("Licensed under CC BY-NC-SA 3.0.",),
    "CC-BY-NC-ND-3.0": ("Licensed under CC BY-NC-ND 3.0.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}


def words(text: str) -> list[str]:
    """Words in lower case, without punctuation, with one spelling of those in ``_SAME`` and of versions."""
    return [_SAME.get(w, w) for w in _WORD.findall(_VERSION.sub("version ", text.lower()))]


@dataclass(frozen=True)
class Template:
    licence: str
    grams: Mapping[tuple[str, str], int]
    size: int


@dataclass
class Scanner:
    """Finds the stretches of words whose Dice coefficient with a template reaches the threshold.

    A stretch begins and ends with one of the template's bigrams: cutting any other off an end only raises the Dice.

    Sizes count repeats. Dice >= t bounds a stretch of size a against a template of size b: t b / (2 - t) <= a <=
    b (2 - t) / t, and at least t b / (2 - t) of its bigrams must be the template's. Both prune; neither loses a match.
    """

    templates: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: TEMPLATES)
    threshold: float = THRESHOLD

    def __post_init__(self):
        self.known: list[Template] = []
        self.holders: dict[tuple[str, str], list[int]] = {}
        for licence, texts in self.templates.items():
            for text in texts:
                w = words(text)
                grams = Counter(zip(w, w[1:], strict=False))
                for g in grams:
                    self.holders.setdefault(g, []).append(len(self.known))
                self.known.append(Template(licence, grams, sum(grams.values())))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(licence, best Dice, matches, first and last segment of the best) of a whole text, best matches first claiming
        their words. Segments are lines and sentences."""
        if not text:
            return []
        flat: list[str] = []
        ends: list[int] = []
        for segment in _BREAK.split(_VERSION.sub("version ", text)):
            if w := words(segment):
                flat += w
                ends.append(len(flat))
        hits: dict[int, list[int]] = {}
        holders = self.holders
        for k, gram in enumerate(zip(flat, flat[1:], strict=False)):
            if gram in holders:
                for t in holders[gram]:
                    hits.setdefault(t, []).append(k)
        found: list[tuple[float, int, int, int, str]] = []
        for t, at in hits.items():
            if len(at) >= self.threshold * self.known[t].size / (2 - self.threshold) - 1e-9:
                found += self._stretches(self.known[t], at, flat)
        found.sort(key=lambda m: (-m[0], -m[1], m[2], m[4]))
        taken = bytearray(len(flat))
        best: dict[str, list] = {}
        for dice, _, i, j, licence in found:
            if not any(taken[i : j + 1]):
                taken[i : j + 1] = b"\1" * (j + 1 - i)
                best.setdefault(licence, [dice, 0, bisect_right(ends, i), bisect_right(ends, j)])[1] += 1
        return [(licence, *row) for licence, row in sorted(best.items())]

    def _stretches(self, template: Template, at: list[int], flat: list[str]) -> list[tuple[float, int, int, int, str]]:
        """Stretches, by first and last word, that begin and end with one of the template's bigrams, which start at ``at``."""
        most = template.size * (2 - self.threshold) / self.threshold + 1e-9
        least = max(1, math.ceil(self.threshold * template.size / (2 - self.threshold) - 1e-9))
        out = []
        for n in range(len(at) - least + 1):
            begin = at[n]
            if at[n + least - 1] - begin + 1 > most:
                continue
            common, left = 0, dict(template.grams)
            for k in at[n:]:
                size = k - begin + 1
                if size > most:
                    break
                gram = (flat[k], flat[k + 1])
                if left[gram]:
                    left[gram] -= 1
                    common += 1
                    dice = 2 * common / (size + template.size)
                    if dice >= self.threshold:
                        out.append((dice, template.size, begin, k + 1, template.licence))
        return out


def licence_scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each licence found in a document: (doc_id, license_id, dice, n_matches, first_segment, last_segment).

    Every whole text is scanned in place, without a shuffle. Null and empty texts give no row, a null doc_id stays null,
    repeated rows give repeated rows; a stretch that ties between templates goes to the longer template, then to the
    name that sorts first; an empty table gives none; other columns are never looked at.
    """
    scanner = scanner or Scanner()
    schema = pa.schema([("doc_id", pa.int64()), ("license_id", pa.string()), ("dice", pa.float64()), ("n_matches", pa.int64()), ("first_segment", pa.int64()), ("last_segment", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in scanner.scan(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license_id string, dice double, n_matches long, first_segment long, last_segment long")
