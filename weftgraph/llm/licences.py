"""License scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

What is compared are all runs of words, wherever in a line they begin and end.  A template of b bigrams can reach the threshold t only
with runs of t / (2 - t) * b to (2 - t) / t * b distinct bigrams, and only if the text shares t / 2 * (b + the least size) of its
bigrams with it.  Templates of which a text shares fewer and runs of other sizes are not compared, nor runs that begin or end with a
bigram that the template lacks, since they are better without it.  Distinct bigrams are met in the order of their next
occurrence, so a repetition, however long, costs nothing.

Cases: null, empty and wordless texts match nothing; ties go to the shorter run, then the earlier, and for a text's best licence to the first name; each of
repeated rows gets the same result; other columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.8

#: Notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "BSD": "Redistributed under the terms of the BSD License.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved. No part of this work may be reproduced without permission.",
}

_words = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _words(text.lower())


def bigrams(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:]))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.names, self.t = sorted(templates), threshold
        self.sets = [bigrams(words(templates[n])) for n in self.names]
        self.least = [threshold / (2 - threshold) * len(s) for s in self.sets]
        self.most = [(2 - threshold) / threshold * len(s) for s in self.sets]
        self.need = [threshold / 2 * (len(s) + lo) for s, lo in zip(self.sets, self.least, strict=True)]
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, s in enumerate(self.sets):
            for b in s:
                self.index.setdefault(b, []).append(k)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first line, last line, Dice) of the best run for each template that reaches the threshold."""
        if not text:
            return []
        ws = words(text)
        hits = self.index.keys() & set(zip(ws, ws[1:]))
        if not hits:
            return []
        shared = [0] * len(self.sets)
        for b in hits:
            for k in self.index[b]:
                shared[k] += 1
        few = [k for k, n in enumerate(shared) if n and n >= self.need[k] - 1e-9]
        if not few:
            return []
        ws, at = [], []  # all words, and their lines
        for i, x in enumerate(text.split("\n")):
            own = words(x)
            ws += own
            at += [i] * len(own)
        best: dict[int, tuple] = {}
        following: dict[tuple[str, str], int] = {}  # each bigram's next occurrence, the nearest last
        for i in range(len(ws) - 2, -1, -1):
            g = (ws[i], ws[i + 1])
            following.pop(g, None)
            following[g] = i
            for k in self.index.get(g, ()):
                if k not in few:
                    continue
                own, most, least, common = self.sets[k], self.most[k], self.least[k], 0
                for n, (x, j) in enumerate(reversed(following.items()), 1):
                    if n > most + 1e-9:
                        break
                    if x not in own:
                        continue
                    common += 1
                    if n < least - 1e-9:
                        continue
                    dice = 2 * common / (n + len(own))
                    if dice >= self.t:
                        first, last = at[i], at[j + 1]
                        if k not in best or (dice, first - last, -first) > best[k][0]:
                            best[k] = ((dice, first - last, -first), (self.names[k], first, last, dice))
        return [best[k][1] for k in few if k in best]


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col`` and ``found``, an array of (licence, first_line, last_line, dice), for each row."""
    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    item = T.StructType([T.StructField("licence", T.StringType()), T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType()), T.StructField("dice", T.DoubleType())])
    schema = T.StructType([slim.schema[0], T.StructField("found", T.ArrayType(item))])

    def run(batches):
        tool = Scanner(templates, threshold)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("dice", pa.float64())]))
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 1024):
                batch = whole.slice(at, 1024)
                rows = [[dict(zip(("licence", "first_line", "last_line", "dice"), f, strict=True)) for f in tool.scan(t)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: how many templates match, which, the best and its Dice coefficient and lines."""
    best = F.element_at(F.array_sort("found", lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["licence"] < b["licence"], -1).otherwise(1)), 1)
    out = scan(docs).withColumn("best", F.when(F.size("found") > 0, best))
    return out.select(
        "doc_id",
        F.size("found").alias("n_licences"),
        F.array_join(F.transform("found", lambda x: x["licence"]), ",").alias("licences"),
        F.col("best.licence").alias("best_licence"),
        F.col("best.dice").alias("dice"),
        F.col("best.first_line").alias("first_line"),
        F.col("best.last_line").alias("last_line"),
    )
