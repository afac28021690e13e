"""Licence scan by a trained paragraph classifier, in built-in functions and Spark ML.

Paragraphs are the lines of a text. A multinomial logistic regression with a sparse
penalty on hashed one- and two-word features names the licence family. ``unknown``
is a class of its own, learned from corpus paragraphs that resemble no template, and
is calibrated: a family needs a probability that hardly any paragraph without a
template's words reaches, counted over the whole corpus. A named family is confirmed by
the three-word shingles that the paragraph shares with the family's template. Training
reads a bounded sample; scoring and calibration, every paragraph. An expression of
several licences is named only where one of them outweighs the others.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import discard, staged, table
from anchorage.llm.quality import UPPER, words_of

#: Most corpus paragraphs that the fit reads.
SAMPLE = 6_000
FEATURES = 1 << 12
UNKNOWN = "unknown"
#: Share of all paragraphs that may reach the threshold without a template's words, its lowest value, and its steps up to 1.
MISTAKEN, LEAST, STEPS = 0.001, 0.6, 400
CONFIRM = 0.6
SHINGLE = 3
SHORTEST = 4

# Wording of licence notices, by family.
TEMPLATES = {
    "apache-2.0": (
        "Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "This project is licensed under the MIT License. See the LICENSE file for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "isc": (
        "ISC License",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ),
    "bsd": (
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "GNU General Public License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Licensed under the GPL, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "GNU Lesser General Public License",
        "Licensed under the LGPL, version 2.1.",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "agpl": (
        "GNU Affero General Public License",
        "Licensed under the AGPL, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "mpl-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "Eclipse Public License - v 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-1.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "public-domain": (
        "The Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: Unlicense",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
    ),
}
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))


def split_words(paragraph: str) -> list[str]:
    """Words as ``paragraph_words`` makes them, for the templates."""
    kept = "".join(c if c.isascii() and c.isalnum() or not c.isascii() or c in ".-" else " " for c in paragraph)
    return [w.strip(".") for w in kept.lower().split() if w.strip(".")]


def paragraph_words(paragraph: Column) -> Column:
    """Lower-case words; ASCII punctuation but inner points and hyphens parts them."""
    marks = "!\"#$%&'()*+,/:;<=>?@[\\]^_`{|}~"
    plain = F.translate(F.translate(paragraph, UPPER, UPPER.lower()), marks, " " * len(marks))
    return F.filter(F.transform(words_of(plain), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def features(rows: DataFrame) -> DataFrame:
    """Add ``terms``, the one- and two-word features of ``words``, and their hashed vector."""
    n = F.size("words")
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    rows = rows.withColumn("terms", F.concat("words", pairs))
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows)


def shingles(words: Column) -> Column:
    count = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def family_shingles() -> dict[str, list[str]]:
    found = {}
    for family, notices in TEMPLATES.items():
        words = [split_words(n) for n in notices]
        found[family] = sorted({" ".join(w[i : i + SHINGLE]) for w in words for i in range(max(1, len(w) - SHINGLE + 1))})
    return found


def examples() -> list[tuple[list[str], int]]:
    """(words, class) of the templates, their ends cut and single words left out."""
    rows = []
    for family, notices in TEMPLATES.items():
        for words in map(split_words, notices):
            cut = [words[:k] for k in range(max(SHORTEST, len(words) // 2), len(words))]
            cut += [words[k:] for k in range(1, len(words) // 2) if len(words) - k >= SHORTEST]
            cut += [words[:k] + words[k + 1 :] for k in range(len(words)) if len(words) > SHORTEST]
            rows += [(w, FAMILIES.index(family)) for w in [words] * 4 + cut]
    return rows


def resemblance(words: Column, known: dict[str, list[str]]) -> Column:
    """Per family the share of the paragraph's shingles that its template holds."""
    own = shingles(words)
    every = F.size(own)
    return F.array(
        F.lit(0.0), *(F.size(F.array_intersect(own, F.array(*map(F.lit, known[f])))) / every for f in FAMILIES[1:])
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, words) of every line with a word.

    Words are made before the lines are exploded, so what reads them in a lambda
    finds them ready.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), paragraph_words)
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(lines).alias("at", "words"))
    return rows.filter(F.size("words") > 0)


def template_shingles() -> Column:
    return F.array(*map(F.lit, sorted({s for found in family_shingles().values() for s in found})))


def train(docs: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel:
    """The classifier.

    Unknown examples are paragraphs of hash-chosen documents that share no shingle
    with a template.
    """
    spark = docs.sparkSession
    total = docs.select("doc_id").count()
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample / max(total, 1)) * (1 << 20))
    plain = paragraphs(chosen).filter(~F.arrays_overlap(shingles(F.col("words")), template_shingles()))
    plain = plain.withColumn("draw", F.xxhash64("text_hash", "at")).orderBy("draw", "doc_id").limit(sample)
    taught = spark.createDataFrame(examples(), "words array<string>, label int")
    rows = plain.select("words", F.lit(0).alias("label")).union(taught)
    rows = staged(features(rows).select("features", F.col("label").cast("double").alias("label")).coalesce(4), "licence-examples")
    model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=25).fit(rows)
    discard(rows)
    return model


def threshold_of(scored: DataFrame, paragraphs_: int) -> float:
    """The lowest probability from ``LEAST`` on that at most ``MISTAKEN`` of all paragraphs reach without a template's words.

    ``scored`` holds (probability, strange) of the paragraphs that reach ``LEAST``; they are
    counted in ``STEPS`` steps, so a row for each step comes back.
    """
    step = F.floor((F.col("probability") - LEAST) / (1 - LEAST) * STEPS).cast("int").alias("step")
    counts = {r["step"]: r["n"] for r in scored.filter("strange").groupBy(step).agg(F.count("*").alias("n")).collect()}
    above, found = 0, STEPS + 1
    for k in range(STEPS, -1, -1):
        above += counts.get(k, 0)
        if above > MISTAKEN * paragraphs_:
            break
        found = k
    return LEAST + (1 - LEAST) * found / STEPS


def scan(docs: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_paragraphs, n_named, n_confirmed,
    families (sorted, confirmed), best_probability.

    A null or empty text has no paragraphs; a very long paragraph is one paragraph.
    Repeated rows give equal rows, a null doc_id stays null, other columns are ignored,
    and an empty table gives no rows.
    """
    chance = vector_to_array("probability")
    families = F.array(*map(F.lit, FAMILIES))
    scored = model.transform(features(paragraphs(docs)))
    scored = scored.select("doc_id", "text_hash", "at", "words", F.slice(chance, 2, len(FAMILIES) - 1).alias("chances"))
    scored = scored.withColumn("probability", F.array_max("chances")).filter(F.col("probability") >= LEAST)
    scored = scored.withColumn("class", F.array_position("chances", F.col("probability")).cast("int"))
    alike = F.get(resemblance(F.col("words"), family_shingles()), F.col("class"))
    strange = ~F.arrays_overlap(shingles(F.col("words")), template_shingles())
    scored = scored.select("doc_id", "text_hash", "at", "probability", "class", alike.alias("alike"), strange.alias("strange"))
    scored = staged(scored, "licence-scores")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, " \t\x0b\x0c\r", "") != "")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(lines).alias("n_paragraphs"))
    rows = staged(rows, "paragraph-counts")
    threshold = threshold_of(scored, rows.agg(F.sum("n_paragraphs")).first()[0] or 0)
    named = (
        scored.filter(F.col("probability") >= threshold)
        .select("doc_id", "text_hash", "at", "probability", F.get(families, F.col("class")).alias("family"), (F.col("alike") >= CONFIRM).alias("sure"))
        .distinct()
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count("*").alias("n_named"),
            F.sum(F.col("sure").cast("long")).alias("n_confirmed"),
            F.sort_array(F.collect_set(F.when(F.col("sure"), F.col("family")))).alias("families"),
            F.max("probability").alias("best_probability"),
        )
        .withColumnsRenamed({"doc_id": "n_doc", "text_hash": "n_text"})
    )
    same = rows["doc_id"].eqNullSafe(named["n_doc"]) & (rows["text_hash"] == named["n_text"])
    return rows.join(named, same, "left").select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("n_named", F.lit(0)).alias("n_named"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        "best_probability",
    )


def op3_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licence families of every document of the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).withColumn("families", F.array_join("families", ","))
