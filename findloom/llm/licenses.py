"""License scans: candidate blocks are compressed with each template as a zstandard raw dictionary, and winners are confirmed by their exact wording."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.llm.common import fresh, table, without

#: Short notices, file headers and full texts of licences, as their publishers word them.
TEMPLATES = {
    "AGPL-3.0": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-2.1": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
}
#: Names by which licences are referred to, beside their SPDX identifiers (GNU ones with a suffix too).
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPL v3"), "Apache-2.0": ("Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license"), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), "BSL-1.0": ("Boost Software License 1.0",), "CC-BY-4.0": ("CC BY 4.0 license",), "CC-BY-NC-4.0": ("CC BY-NC 4.0 license",), "CC-BY-SA-4.0": ("CC BY-SA 4.0 license",),
    "CC0-1.0": ("CC0 1.0 Universal license",), "GPL-2.0": ("GNU General Public License v2.0", "GNU GPLv2", "GPL v2"), "GPL-3.0": ("GNU General Public License v3.0", "GNU GPLv3", "GPL v3"), "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "LGPL v2.1"), "LGPL-3.0": ("GNU Lesser General Public License v3.0", "LGPL v3"), "MIT": ("MIT License", "MIT licence"), "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "Unlicense": ("The Unlicense",), "Zlib": ("zlib License",),
}


def _references(name: str) -> tuple[str, ...]:
    """One-line notices of a licence: its SPDX line and sentences with its names; GNU licences may apply alone or with any later version."""
    later = ("", " or later", " or any later version") if "GPL" in name else ("",)
    ids = [name + x for x in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    said = [f"{verb} under the {n}{x}" for n in NAMES.get(name, ()) for x in later for verb in ("Licensed", "Released", "Distributed")]
    return (*[f"SPDX-License-Identifier: {i}" for i in ids], *said)


#: A notice has a word with one of these near it; each template has one.
CUES = re.compile(r"licen[cs]e|copyright|rights[\W_]+reserved|redistribut|permi[ts]|granted|binary|warrant|public[\W_]+domain|creative[\W_]+commons|cc0|cc[\W_]+by", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: A template is confirmed in a block where it saves this share of the bytes that it takes itself.
FLOOR = 0.2
SPAN = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("license", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("reduction", T.DoubleType()), ("differences", T.LongType()))]))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("differences", pa.int64())]))
_STEP = 1 << 32


@cache
def _compressors():
    """Templates with their words, a compressor for each, their own compressed size and whether no word may differ; and a plain compressor."""
    import zstandard as z

    out, plain = [], z.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    for name, texts in TEMPLATES.items():
        short = _references(name) if name in NAMES else ()
        split = {tuple(w.lower() for w in WORD.findall(text)): text in short for text in (*short, *texts)}
        for words, exact in split.items():
            raw = " ".join(words).encode()
            press = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
            out.append((name, words, press, len(plain.compress(raw)), exact or len(words) <= 10))
    return out, plain


def laid(template: np.ndarray, block: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(differences, start, end) of the stretches of a block that become the template when at most `most` words are put in, taken out or replaced; of those
    that overlap the one with the fewest, then the first.

    The table of least differences is filled row by row for all ends at once; a cell carries the latest start that has its number.
    """
    n = len(block)
    places = np.arange(n + 1, dtype=np.int64)
    row = _STEP - 1 - places  # nothing of the template yet: every start is free
    for word in template:
        best = row + _STEP
        best[1:] = np.minimum(best[1:], row[:-1] + np.where(block == word, 0, _STEP))
        row = np.minimum.accumulate(best - places * _STEP) + places * _STEP
    cost, start = row // _STEP, _STEP - 1 - row % _STEP
    out: list[tuple[int, int, int]] = []
    for c, a, b in sorted((int(cost[e]), int(start[e]), int(e)) for e in np.flatnonzero(cost <= most) if start[e] < e):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((c, a, b))
    return out


def license_spans(text: str | None, slack: float = 0.1) -> list[tuple[str, int, int, float, int]]:
    """(license, start, end, reduction, differences) of each notice, by start; code points, end exclusive.

    For each template the words near cues, as many before and after as the template has, form blocks; long ones are cut into overlapping blocks of about four
    times its length, so neither line breaks nor comment signs matter. A block is compressed with the template as its dictionary; pairs that save at least FLOOR of what
    the template takes itself are ranked by the bytes that they save, and confirmed in this order where at most `slack` of the template's words differ, none in a template of ten words
    or fewer or a one-line reference. A pair that can't win on any cue of its block, as longer notices or one as long without a difference have been confirmed there, is passed over; so are templates that
    lack more words in the whole text than may differ. Of overlapping spans the one of more words stays, then of fewer differences, then of the better reduction, then the
    first by name. A notice none of whose cue words is left isn't found. Work is linear in the text for each template.
    """
    text = text or ""
    cues = [m.start() for m in CUES.finditer(text)]
    if not cues:
        return []
    words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    if not words:
        return []
    starts = np.array([w[1] for w in words])
    near = np.unique(np.maximum(np.searchsorted(starts, cues, "right") - 1, 0))
    templates, plain = _compressors()
    numbers: dict[str, int] = {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w, _, _ in words])
    ranked: list[tuple] = []
    for k, (name, t, press, own, exact) in enumerate(templates):
        most = 0 if exact else int(slack * len(t))
        if sum(w not in numbers for w in t) > most:
            continue
        for a, b in _blocks(near, len(t) + most, len(words)):
            block = " ".join([w for w, _, _ in words[a:b]]).encode()
            saved = len(plain.compress(block)) - len(press.compress(block))
            if saved >= FLOOR * own:
                ranked.append((-saved, -len(t), name, a, b, k, most))
    found: dict[tuple[int, int], tuple] = {}
    held = np.zeros((2, len(near)), np.int64)  # for each cue the words and differences of the longest notice confirmed around it
    for saved, _, name, a, b, k, most in sorted(ranked):
        mine, m = slice(*np.searchsorted(near, (a, b))), len(templates[k][1])
        if ((held[0, mine] > m) | ((held[0, mine] == m) & (held[1, mine] == 0))).all():
            continue  # can't win on any of the block's cues
        for n, i, j in laid(np.array([numbers.get(w, -1) for w in templates[k][1]]), coded[a:b], most):
            s = (-m, n, saved / templates[k][3], name, words[a + i][1], words[a + j - 1][2])
            found[s[4:]] = min(found.get(s[4:], s), s)
            inside = slice(*np.searchsorted(near, (a + i, a + j)))
            better = (m > held[0, inside]) | ((m == held[0, inside]) & (n < held[1, inside]))
            held[0, inside], held[1, inside] = np.where(better, m, held[0, inside]), np.where(better, n, held[1, inside])
    out: list[tuple] = []
    for s in sorted(found.values()):
        if all(s[5] <= o[4] or s[4] >= o[5] for o in out):
            out.append(s)
    return sorted(((name, a, b, -r, n) for _, n, r, name, a, b in out), key=lambda s: s[1])


def _blocks(near: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Stretches of words within `reach` of cues, those of more than four times it cut so that any `reach` words stand together in one."""
    low, high = np.maximum(near - reach, 0), np.minimum(near + reach + 1, n)
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    out = []
    for a, b in zip(low[np.concatenate([[0], cut])].tolist(), high[np.concatenate([cut - 1, [len(near) - 1]])].tolist()):
        while b - a > 4 * reach:
            out.append((a, a + 4 * reach))
            a += 3 * reach
        out.append((a, b))
    return out


def _spans(text: pa.Array) -> pa.Array:
    names = ("license", "start", "end", "reduction", "differences")
    return pa.array([[dict(zip(names, s, strict=True)) for s in license_spans(x)] if x and CUES.search(x) else [] for x in text.to_pylist()], _ARROW)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `licenses`, an array of (license, start, end, reduction, differences).

    Null and empty texts have none, nor have texts without a cue. Each row is judged alone, block by block, so very long texts, ties and repeated rows need nothing
    special; an empty table gives an empty result; an input column named licenses is replaced, after its use if it's the text.
    """
    own = fresh(docs, "text")
    return without(docs.withColumn(own, F.col(f"`{text}`").cast("string")), "licenses").withColumn("licenses", F.arrow_udf(_spans, SPAN)(own)).drop(own)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the number of notices, and each as license:start:end:differences."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.array_join(F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"), s["differences"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("license_ids"), listed.alias("notices"))
