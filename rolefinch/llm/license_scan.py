"""License scan by conditional compression.

A template can only lie where enough of its words stand on few neighbouring diagonals, that is at nearly the same
distance from their places in the template: words of text and template are matched by an index of all templates'
words, and their diagonals are counted over the whole text. Where enough meet, the words around are a candidate
block, about as long as the template; overlapping ones are one block. Each block is compressed on its own and
with each license template as a raw zstandard dictionary; the more a template shortens it, the likelier it is the
source. In this order the templates are confirmed by exact wording: the block must hold the template's words in
order but for a few, and every difference is listed. A text of any length goes the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

# Wording of common license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD": "Released under the BSD License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-source-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "MIT-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-notice": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
    "Unlicense-whole": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
}
_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def read_templates(folder: str) -> dict[str, str]:
    """The texts of a folder of licenses by file name, to be used as templates instead of ``TEMPLATES``."""
    return {p.name: p.read_text(encoding="utf-8") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def words_of(text: str) -> list[str]:
    return [x.lower() for x in _WORD.findall(text)]


class Notice(NamedTuple):
    first: int  # words of the text
    last: int
    missing: int
    added: int
    differences: list[str]


def align(block: np.ndarray, template: np.ndarray, most: int) -> tuple[int, int, list[tuple[int, int, int, int]]] | None:
    """The stretch of ``block`` with the fewest words missing and added, of ``most`` together at most, the earliest end of several.

    Its bounds, and the differences as (from, to) in the template and (from, to) in the block, in order.
    """
    n, size = len(template), len(block)
    steps = np.arange(size + 1, dtype=np.int32)
    rows = np.zeros((n + 1, size + 1), np.int16 if n + size < 30_000 else np.int32)
    for i in range(n):
        before = rows[i].astype(np.int32)
        now = before + 1
        now[1:] = np.minimum(now[1:], np.where(block == template[i], before[:-1], 1 << 20))
        rows[i + 1] = np.minimum.accumulate(now - steps) + steps
    end = int(rows[n].argmin())
    if rows[n, end] > most:
        return None
    i, j, apart = n, end, []
    while i:
        if j and block[j - 1] == template[i - 1] and rows[i, j] == rows[i - 1, j - 1]:
            i, j = i - 1, j - 1
            continue
        a, c = (i - 1, j) if rows[i, j] == rows[i - 1, j] + 1 else (i, j - 1)
        if apart and apart[-1][0] == i and apart[-1][2] == j:
            apart[-1] = (a, apart[-1][1], c, apart[-1][3])
        else:
            apart.append((a, i, c, j))
        i, j = a, c
    return j, end, apart[::-1]


class Templates:
    """Templates with their words, an index of the words' places, and dictionaries to compress with."""

    def __init__(self, listed: tuple[tuple[str, str], ...], tolerance: float):
        import ahocorasick

        self.names = [name for name, _ in listed]
        spoken = [words_of(text) for _, text in listed]
        self.number = {w: k for k, w in enumerate(sorted({w for x in spoken for w in x}))}
        self.words = [np.array([self.number[w] for w in x], np.int64) for x in spoken]
        self.said = spoken
        self.most = [int(tolerance * len(x)) for x in spoken]
        places = sorted((w, t, j) for t, x in enumerate(self.words) for j, w in enumerate(x))
        self.of, self.at = (np.array([p[k] for p in places], np.int64) for k in (1, 2))
        self.first = np.searchsorted([p[0] for p in places], np.arange(len(self.number) + 1))
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for _, text in listed]
        # Of the longest words of a template, one more than may be missing, a text without any holds no notice of it.
        self.sure = ahocorasick.Automaton()
        for x, most in zip(spoken, self.most):
            for w in sorted(x, key=len, reverse=True)[: most + 1]:
                self.sure.add_word(w, w)
        self.sure.make_automaton()

    def may_hold(self, text: str) -> bool:
        return next(self.sure.iter(text.lower()), None) is not None

    def candidates(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, last word, template) of all stretches in which the template can lie with few enough differences."""
        i = np.flatnonzero(numbers >= 0)
        w = numbers[i]
        count = self.first[w + 1] - self.first[w]
        at = np.repeat(self.first[w] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        template, shift = self.of[at], np.repeat(i, count) - self.at[at]
        out = []
        for t, (own, most) in enumerate(zip(self.words, self.most)):
            lines, met = np.unique(shift[template == t], return_counts=True)
            if not len(lines):
                continue
            upto = np.concatenate([[0], np.cumsum(met)])
            # Words missing and added shift what follows by one line each: all that match lie on most + 1 lines.
            held = upto[np.searchsorted(lines, lines + most, "right")] - upto[:-1] >= max(1, len(own) - most)
            last = None
            for line in lines[held].tolist():
                if last is not None and line <= last[1]:
                    last[1] = line + most
                else:
                    last = [line, line + most]
                    out.append((t, last))
        return sorted((max(0, lo), min(len(numbers), hi + len(self.words[t])), t) for t, (lo, hi) in out)

    def notices(self, numbers: np.ndarray, spoken: list[str], lo: int, hi: int, t: int) -> Iterator[Notice]:
        """The notices of a template in a stretch of words, the best first, then what lies on either side."""
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            found = align(numbers[lo:hi], self.words[t], self.most[t]) if hi - lo >= len(self.words[t]) - self.most[t] else None
            if found:
                a, z, apart = found
                said = [f"{'replace' if j > i and d > c else 'delete' if j > i else 'insert'}: {' '.join(self.said[t][i:j])} > {' '.join(spoken[lo + c : lo + d])}" for i, j, c, d in apart]
                yield Notice(lo + a, lo + z, sum(j - i for i, j, _, _ in apart), sum(d - c for _, _, c, d in apart), said)
                todo += [(lo, lo + a), (lo + z, hi)]

    def scan(self, text: str) -> Iterator[tuple]:
        """(block, start, end, name, saving, missing, added, differences) of each confirmed notice, in order."""
        places = [m.span() for m in _WORD.finditer(text)]
        spoken = [text[a:z].lower() for a, z in places]
        numbers = np.array([self.number.get(w, -1) for w in spoken], np.int64)
        stretches = self.candidates(numbers)
        k = block = 0
        while k < len(stretches):
            lo, hi, own = stretches[k][0], stretches[k][1], []
            while k < len(stretches) and stretches[k][0] < hi:
                hi = max(hi, stretches[k][1])
                own.append(stretches[k])
                k += 1
            raw = text[places[lo][0] : places[hi - 1][1]].encode("utf-8", "surrogatepass")
            alone = len(self.plain.compress(raw))
            saving = [alone - len(c.compress(raw)) for c in self.given]
            got: list[tuple] = []
            for a, z, t in sorted(own, key=lambda x: (-saving[x[2]], self.names[x[2]], x[0])):
                for n in self.notices(numbers, spoken, a, z, t):
                    if all(n.last <= b or n.first >= c for b, c, *_ in got):
                        got.append((n.first, n.last, t, n))
            for a, z, t, n in sorted(got, key=lambda x: x[0]):
                yield block, places[a][0], places[z - 1][1], self.names[t], saving[t] / alone, n.missing, n.added, n.differences
            block += bool(got)


@lru_cache(4)
def _templates(listed: tuple[tuple[str, str], ...], tolerance: float) -> Templates:
    return Templates(listed, tolerance)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, tolerance: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, block, start, end, license, saving, n_missing, n_added, differences``: one row for each confirmed notice.

    ``start`` and ``end`` are characters of the text. ``saving`` is the share of the block's compressed size that
    the template spares. A notice has at most ``tolerance`` of its template's words missing and added together; of
    notices that overlap the one stays whose template spares most (ties go to the name, then to the earlier place), and
    of a template's own the one with the fewest differences. Texts are read whole, however long. Null and empty
    texts, and those without a notice, give no row; a null id stays null; repeated rows each give theirs. An empty table
    gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    listed = tuple((templates or TEMPLATES).items())
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("block", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("license", T.StringType()), ("saving", T.DoubleType()), ("n_missing", T.IntegerType()), ("n_added", T.IntegerType()), ("differences", T.ArrayType(T.StringType()))))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def scan(batches):
        made = _templates(listed, tolerance)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                if text and made.may_hold(text):
                    rows.extend((i.as_py(), *row) for row in made.scan(text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)
