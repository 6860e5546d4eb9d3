"""License scans by diagonal voting.

Every run of ``K`` words of every document is hashed and joined by Spark to the positions at which a
license template has the same run.  A hit votes for its diagonal, the position in the document less
that in the template.  Votes are counted by document, template and diagonal; neighbouring diagonals
(words added or left out) are merged into spans; and each span is verified against the
document's own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import Words, field, hash_words, kgrams, maybe_broadcast, over_texts, ship, stored, texts_of

#: Words of a run that votes.
K = 3
#: Diagonals, at most, between votes of one span.
GAP = 6
#: Share of a template's runs that have to vote for a span before it is verified.
VOTES = 0.2
#: Share of a template's words that a verified span has to have, in order.
COVERAGE = 0.8
#: Words that a span may be longer than the template, per word of it.
SLACK = 1.3
#: Template runs that are sent to every executor, at most; a larger set of templates is joined by shuffle.
BROADCAST_RUNS = 300_000

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'

#: Whole license texts, from the first condition to the disclaimer.
TEXTS: list[tuple[str, str]] = [
    ("MIT", f"{_MIT}: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
]

#: Public license notices and license texts: (license, text).
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", _MIT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License version 2"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved"),
    *TEXTS,
]


def template_words(templates: list[tuple[str, str]]) -> list[np.ndarray]:
    return [hash_words(text) for _, text in templates]


def template_runs(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """run, template, at: each run of ``k`` words of each template (templates of fewer words have none)."""
    rows = []
    for t, (_, text) in enumerate(templates):
        words = Words(pa.array([text]))
        rows += [(int(h), t, int(a)) for h, a in zip(kgrams(words, k)[0].view(np.int64), kgrams(words, k)[1])]
    return spark.createDataFrame(rows, "run long, template int, at int")


def document_runs(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """id, __wl_key (hash of the text), pos, run: every run of ``k`` words of every document."""
    keyed = texts_of(docs, id_col, text_col).withColumn("__wl_key", F.xxhash64(text_col))
    schema = T.StructType([field(docs, id_col), T.StructField("__wl_key", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("run", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        h, at = kgrams(words, k)
        doc = words.doc[at]
        row = pa.array(doc)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(h.view(np.int64))], names=schema.names)

    return keyed.mapInArrow(over_texts(work), schema)


def spans(votes: DataFrame, id_col: str, gap: int = GAP) -> DataFrame:
    """Votes (id, __wl_key, template, pos, at) to spans: votes of neighbouring diagonals, merged; lo, hi: first and last position.

    Votes of one diagonal that are further apart than the template is long are of different spans too.
    """
    keys = [id_col, "__wl_key", "template"]
    diagonal = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    counted = diagonal.groupBy(*keys, "diagonal").agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = Window.partitionBy(*keys).orderBy("diagonal")
    begins = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= gap, 0).otherwise(1)
    merged = counted.withColumn("b", begins).withColumn("span", F.sum("b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*keys, "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def common_words(span: np.ndarray, template: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, and the least number of words of ``span`` from its start that hold one."""
    best = np.zeros(len(template) + 1, np.int64)
    most, end = 0, 0
    for i in range(len(span)):
        row = np.maximum(np.where(span[i] == template, best[:-1] + 1, 0), best[1:])
        best[1:] = np.maximum.accumulate(row)
        if best[-1] > most:
            most, end = int(best[-1]), i + 1
    return most, end


def aligned(span: np.ndarray, template: np.ndarray) -> tuple[int, int, int]:
    """Words of ``template`` that ``span`` has in order, and where the tightest such stretch of earliest end begins and ends."""
    got, end = common_words(span, template)
    _, back = common_words(span[:end][::-1], template[::-1])
    return got, end - back, end


def stretches(words: np.ndarray, template: np.ndarray, need: int, most: int, rows: int = 4096) -> list[tuple[int, int, int]]:
    """(matched words, begin, end) of stretches of at most ``most`` words that have at least ``need`` words of ``template`` in order.

    Of each begin, the first end of every number of matched words.  A stretch begins and ends with a matched word.
    """
    member = np.isin(words, template)
    total = np.concatenate([[0], np.cumsum(member)])
    at = np.flatnonzero(member)
    at = at[total[np.minimum(at + most, len(words))] - total[at] >= need]
    out: list[tuple[int, int, int]] = []
    for i in range(0, len(at), rows):
        begin = at[i : i + rows]
        best = np.zeros((len(begin), len(template) + 1), np.int32)
        for j in range(most):
            live = begin + j < len(words)
            same = (words[np.minimum(begin + j, len(words) - 1)][:, None] == template) & live[:, None]
            had = best[:, -1].copy()
            row = np.maximum(np.where(same, best[:, :-1] + 1, 0), best[:, 1:])
            np.maximum.accumulate(row, axis=1, out=best[:, 1:])
            more = np.flatnonzero((best[:, -1] > had) & (best[:, -1] >= need))
            out += zip(best[more, -1].tolist(), begin[more].tolist(), (begin[more] + j + 1).tolist())
    return out


def verify(found: DataFrame, docs: DataFrame, templates: list[tuple[str, str]], id_col: str, text_col: str, k: int = K, coverage: float = COVERAGE, slack: float = SLACK) -> DataFrame:
    """Spans that hold, word by word, at least ``coverage`` of their template, in a stretch of at most ``slack`` words for each word of it and one.

    Every such stretch at a span competes; the words come from the documents again.
    """
    names = [n for n, _ in templates]
    hashes = template_words(templates)
    schema = T.StructType([field(docs, id_col), T.StructField("license", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("template", "start", "end", "votes")), T.StructField("coverage", T.DoubleType())])
    wanted = found.groupBy(F.col(id_col).alias("__wl_id"), F.col("__wl_key").alias("__wl_k")).agg(F.collect_list(F.struct("template", "lo", "hi", "votes")).alias("__wl_spans"))
    text = texts_of(docs, id_col, text_col).withColumn("__wl_tk", F.xxhash64(text_col))
    both = text.join(maybe_broadcast(stored(wanted)), (F.col("__wl_tk") == F.col("__wl_k")) & F.col(id_col).eqNullSafe(F.col("__wl_id")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(batch.column(1))
        rows: list[tuple] = []
        for r, asked in enumerate(batch.column(2).to_pylist()):
            here: list[tuple] = []
            own = words.hash[words.first[r] : words.first[r + 1]]
            for s in asked:
                t, n = s["template"], len(hashes[s["template"]])
                need, most = max(1, int(np.ceil(coverage * n - 1e-9))), int(slack * n + 1)
                at = max(0, s["lo"] - most)
                for got, first, last in stretches(own[at : s["hi"] + k + most], hashes[t], need, most):
                    here.append((-got, -round(got / n, 6), t, last - first, at + first, at + last, s["votes"]))
            kept: list[tuple] = []
            taken = np.zeros(len(own), bool)
            for x in sorted(set(here)):
                if not taken[x[4] : x[5]].any():
                    taken[x[4] : x[5]] = True
                    kept.append(x)
            rows += [(r, names[t], t, first, last, votes, -share) for _, share, t, _, first, last, votes in sorted(kept, key=lambda x: x[4])]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in rows])), pa.array([x[1] for x in rows], pa.string()), *(pa.array([int(x[c]) for x in rows], pa.int32()) for c in (2, 3, 4, 5)), pa.array([x[6] for x in rows], pa.float64())], names=schema.names)

    return both.select(id_col, text_col, "__wl_spans").mapInArrow(over_texts(work), schema)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = K, gap: int = GAP, coverage: float = COVERAGE, slack: float = SLACK) -> DataFrame:
    """A row per license span: id, license, template (its number), start and end (words, from 0), votes, coverage.

    A template may be found several times; an empty table has no spans.  Very long texts are scanned whole.  Of spans that overlap, the one with the most matched words stays,
    then the one of more coverage, then the template listed first, then the shortest.  Null and empty texts have none; so has a text or template of fewer than
    ``k`` words.  Repeated rows of one id and text are reported once per row, with votes counted once.
    """
    spark = docs.sparkSession
    ship(spark)
    templates = TEMPLATES if templates is None else templates
    runs = maybe_broadcast(template_runs(spark, templates, k), BROADCAST_RUNS)
    votes = document_runs(docs, id_col, text_col, k).join(runs, "run")
    long = [len(h) for h in template_words(templates)]
    shape = F.array(*[F.lit(max(1, int(np.ceil(VOTES * (n - k + 1))))) for n in long]) if long else F.array(F.lit(1))
    found = spans(votes, id_col, gap).where(F.col("votes") >= shape[F.col("template")])
    return verify(found, docs, templates, id_col, text_col, k, coverage, slack)
