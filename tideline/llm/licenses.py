"""License scan (operator 8): diagonal voting of word k-grams against license texts.

Words are letters, digits and non-ASCII, A-Z lowered. All rolling ``GRAM``-word hashes of
all texts are joined to the positions of the templates' k-grams (a local table, broadcast while
it has at most ``MAX_BROADCAST`` rows). Hits are summed by text,
template and offset diagonal; diagonals within ``NEAR`` words of each other (words added
or left out) are one span; a span is verified by the template words that its hits cover:
``COVER`` of the template, or ``LONG`` words at that share of the span. Of verified spans that
overlap, those of the most covered words stand, since licenses share sentences.

Texts are keyed by their hash, so exact copies are summed together before the shuffle.
The base beside it counts the places of fixed phrases; its labels stay.

``score``: the best verified coverage; 0.5 where only a phrase was found; else 0.

Defined results. Null or blank text: no words, no label (labels are empty strings), score
0, first_word and last_word null. Repeated rows: one row each, and null doc_id stays null.
Further columns are ignored; an empty table gives an empty result. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.plans.scratch import stored

GRAM, NEAR, COVER, LONG = 4, 3, 0.8, 30
#: Rows of a template table up to which it is broadcast; larger ones are joined by shuffle.
MAX_BROADCAST = 200_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, short: str) -> str:
    """The notice of a GNU license."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/{short}."
    )


# Whole texts of short public licenses, the notices of long ones, and sentences that name them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", _gnu("General Public License", "")),
    ("lgpl", _gnu("Lesser General Public License", "")),
    ("agpl", _gnu("Affero General Public License", "")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", f"{_BSD_GRANT} {_BSD_WARRANTY}"),
    ("bsd", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def _hashes(text: str) -> np.ndarray:
    b = K.block_of([text])
    s, e, _ = b.spans(K.ALNUM)
    return b.hashes(s, e)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(gram, template, tpos): a row for each k-gram of each template. Shorter templates have none."""
    rows = []
    for t, (_, text) in enumerate(templates):
        h = _hashes(text)
        rows += [(int(x), t, i) for i, x in enumerate(K.grams(h, h, gram).view(np.int64))]
    out = spark.createDataFrame(rows, "gram long, template int, tpos int")
    return F.broadcast(out) if len(rows) <= MAX_BROADCAST else out


def _grams(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """Rows to (text_hash, grams): all rolling k-gram hashes of the words."""
    for batch in batches:
        for part, block in K.blocks(batch.column(1)):
            s, e, rows = block.spans(K.ALNUM)
            g = K.grams(block.hashes(s, e), rows, gram).view(np.int64)
            size = np.maximum(block.counts(rows) - gram + 1, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(g[K.whole(rows, gram)]))
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], lists], ["text_hash", "grams"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to the words and the places of the fixed phrases."""
    phrases = [(label, _hashes(p)) for p, label in PHRASES.items()]
    for batch in batches:
        for part, block in K.blocks(batch.column(2)):
            s, e, rows = block.spans(K.ALNUM)
            h, n = block.hashes(s, e), block.counts(rows)
            at = np.concatenate([[0], np.cumsum(n)])
            where, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (_, p) in enumerate(phrases):
                ok = K.whole(rows, len(p))
                for k, x in enumerate(p):
                    ok &= h[k : k + len(ok)] == x
                where.append(np.flatnonzero(ok))
                label.append(np.full(len(where[-1]), i))
            where, label = np.concatenate(where), np.concatenate(label)
            row = rows[where] if len(where) else where
            first, last = np.full(block.n, 1 << 62), np.full(block.n, -1)
            np.minimum.at(first, row, where - at[row])
            np.maximum.at(last, row, where - at[row])
            names = [set() for _ in range(block.n)]
            for r, i in zip(row, label, strict=True):
                names[r].add(phrases[i][0])
            none = last < 0
            own = [c[part.start : part.stop] for c in batch.columns[:2]]
            cols = [pa.array(n), pa.array(block.counts(row)), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *cols], ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base"])


_SCHEMA = "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>"


def spans(rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """Verified spans of ``rows`` (text_hash, text): text_hash, label, coverage, first_word, last_word."""
    spark = rows.sparkSession
    grams = rows.select("text_hash", "text").mapInArrow(lambda it: _grams(it, gram), "text_hash long, grams array<long>")
    hits = grams.select("text_hash", F.posexplode("grams").alias("pos", "gram")).join(template_grams(spark, templates, gram), "gram")
    votes = hits.groupBy("text_hash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("tpos"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    over = "over (partition by text_hash, template order by diagonal)"
    fresh = F.expr(f"if(diagonal - lag(diagonal) {over} <= {NEAR}, 0, 1)")
    runs = votes.withColumn("fresh", fresh).withColumn("run", F.expr(f"sum(fresh) {over}"))
    runs = runs.groupBy("text_hash", "template", "run").agg(F.flatten(F.collect_list("tpos")).alias("tpos"), F.min("first").alias("first_word"), (F.max("last") + gram - 1).alias("last_word"))
    length = spark.createDataFrame([(t, label, len(_hashes(text))) for t, (label, text) in enumerate(templates)], "template int, label string, words int")
    covered = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda p: F.sequence(p, p + gram - 1)))))
    length = F.broadcast(length) if len(templates) <= MAX_BROADCAST else length
    got = runs.join(length, "template").withColumn("covered", covered).withColumn("coverage", F.col("covered") / F.col("words"))
    dense = (F.col("covered") >= LONG) & (F.col("covered") >= COVER * (F.col("last_word") - F.col("first_word") + 1))
    verified = got.where((F.col("coverage") >= COVER) | dense)
    # Licenses share sentences: of spans that overlap, those of the most covered words stand.
    order = "partition by text_hash order by first_word, last_word, template, run"
    begins = F.expr(f"if(first_word <= max(last_word) over ({order} rows between unbounded preceding and 1 preceding), 0, 1)")
    placed = verified.withColumn("begins", begins).withColumn("place", F.expr(f"sum(begins) over ({order} rows unbounded preceding)"))
    most = placed.withColumn("most", F.expr("max(covered) over (partition by text_hash, place)")).where("covered = most")
    return most.select("text_hash", "label", "coverage", "first_word", "last_word")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """A row for each row of ``docs``; see the module."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    base = rows.mapInArrow(_phrases, _SCHEMA)
    found = spans(rows, templates, gram).groupBy("text_hash").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    out = base.join(stored(found, "licenses"), "text_hash", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.coalesce("coverage", F.when(F.col("n_base") > 0, F.lit(0.5)), F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
