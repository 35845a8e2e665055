"""Licence notices in texts, by a trained paragraph classifier in DataFrame operations alone.

A paragraph is a line, or lines that were wrapped: a line break after ``WRAPPED`` characters that end no sentence
parts no paragraph if the next line starts in lower case, or in upper case alone. Its features are the distinct word 1- to 3-grams with a word that starts with one of
``STEMS`` or with one of ``PHRASES``; a sparse softmax regression over them, fitted on the notices below, gives the probabilities of
the families and of ``none``. Temperature and the bound under which a family becomes ``unknown`` are set on notices that were held out: of families that
the classifier knows, and of families that it was not shown, each of which is held out once. A prediction is confirmed
by the share of the paragraph's trigrams with a stem or phrase that its family's texts have, without those that many families have.
As every feature needs a stem or a phrase, and every notice has a feature, paragraphs without one are ``none`` and are left out by one pattern before
anything is split; the others' features meet the weights (``MAX_FEATURES`` at most) in a broadcast join.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
MAX_FEATURES, ROUNDS, RATE, MOMENTUM, LASSO = 6_000, 120, 2.0, 0.9, 1e-4
MIN_SIMILARITY, PRECISION, FOLDS = 0.5, 0.84, 5
#: Families from which on a trigram is common to them.
COMMON = 4
#: A line break that wraps a sentence: behind 40 characters or more of a line that does not end a sentence.
WRAPPED = r"(?<=[^\n]{40}[^\s.!?:;])\n(?=[ \t]*(?:[a-z0-9(\"']|[A-Z]{2}))"

STEMS = ("licen", "unlicen", "copyright", "warrant", "redistribut", "apache", "gnu", "gpl", "lgpl", "agpl", "affero", "creativecommons", "reserved", "proprietary", "permission", "sublicen", "relicen", "spdx", "mozilla", "mpl", "epl", "bsd", "by-nc", "by-sa", "by-nd", "attribution", "sharealike", "noncommercial", "noderiv", "unencumbered", "wtfpl", "cc")
#: Words that only together hint at a notice; "mit" alone is also a German word.
PHRASES = ("the mit", "under mit", "under a mit", "public domain", "released under", "available under", "terms of the")
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
GRAM = rf"(?:^| )(?:{'|'.join(STEMS)}|(?:{'|'.join(PHRASES)})(?: |$))"
GATE = rf"(?<![a-z0-9])(?:{'|'.join(STEMS)}|(?:{'|'.join(p.replace(' ', '[^a-z0-9]+') for p in PHRASES)})(?![a-z0-9]))"

#: How a family is called, and sentences that name one. Their combinations are training texts.
NAMES = {
    "MIT": ["MIT License", "Expat MIT License", "MIT", "MIT licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL version 3", "GNU General Public License", "GPL-3.0-or-later", "GPL-3.0-only"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL version 2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL", "LGPL-2.1-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0-only", "AGPL-3.0-or-later", "Affero GPL", "GNU Affero General Public Licence", "Affero General Public License", "GNU Affero Public License, version 3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "BSD license", "BSD-3-Clause", "New BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC license", "ISC"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0"],
    "Zlib": ["zlib License", "zlib/libpng License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0", "Artistic-2.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["WTFPL", "WTFPL, version 2"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC-BY-4.0", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial license", "CC-BY-NC-4.0"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
#: Identifiers of families beside their names.
TAGS = {
    "GPL-3.0": ["GPL-3.0", "GPL-3.0+"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0+"],
    "LGPL": ["LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only"],
    "AGPL-3.0": ["AGPL-3.0"],
    "CC-BY": ["CC-BY-3.0"],
    "CC-BY-SA": ["CC-BY-SA-3.0"],
}
TAG = r"spdx-license-identifier:[ \t]*([a-z0-9][a-z0-9.+-]*)"
FORMS = [
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the {}, see the LICENSE file for details.",
    "SPDX-License-Identifier: {}",
    "Distributed under the terms of the {}.",
    "The text is available under a {}.",
    "This program is free software: you can redistribute it under the terms of the {} as published.",
]

#: Paragraphs of each family's own, as their public texts and headers have them, and sentences with a stem that are no notice.
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.',
    ],
    "Apache-2.0": [
        "You may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation under one or more contributor license agreements.",
    ],
    "GPL-3.0": [
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "See the GNU Lesser General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
        "Released under the GNU Affero General Public License, version 3.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software.',
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means; it is unencumbered.",
        "For more information, please refer to https://unlicense.org/",
    ],
    "CC0-1.0": [
        "CC0 1.0 Universal",
        "This work is dedicated to the public domain.",
        "This document is dedicated to the public domain.",
        "The author has dedicated this work to the public domain.",
        "The authors have dedicated the work to the public domain by waiving all of their rights worldwide.",
        "The text has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Proprietary": [
        "Copyright 2024 Example Inc. All rights reserved.",
        "Copyright (c) 2019 the authors. All rights reserved.",
        "All rights reserved.",
        "This software is proprietary and confidential; no license is granted.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying is strictly prohibited without permission.",
        "All rights reserved, proprietary and confidential.",
    ],
    NONE: [
        "She showed her driving licence to the officer at the gate.",
        "The restaurant lost its liquor license after the inspection.",
        "He asked for permission to leave the room early.",
        "The car comes with a five year warranty on the engine.",
        "The police had a warrant for his arrest.",
        "The tribe lived near the apache river for many years.",
        "This table is reserved for two people at eight.",
        "A reserved man, he seldom spoke of copyright or of money.",
        "The study found that licensing of teachers did not change results.",
        "Wealth was redistributed among the poor after the reform.",
        "The gnu is a large antelope that lives on the plain.",
        "Copyright law has changed a lot since the last century.",
        "The bank holds a licence from the central authority.",
        "The proprietary blend of herbs is sold in small jars.",
        "Fishing without a license is forbidden in this lake.",
        "Parents must give written permission for the school trip.",
        "You need a pilot licence to fly over the city.",
        "Seats are reserved for members of the club.",
        "The court denied the request for a search warrant.",
        "They talked about license fees for television in the pub.",
        "The invention has no attribution to any one person.",
        "A license.",
        "Copyright.",
        "Permission was denied.",
        "The album was released under a new name in the spring.",
        "The prisoner was released under guard after a week.",
        "The details were released under pressure from the press.",
        "Both sides agreed on the terms of the treaty.",
        "The terms of the deal were not known for a year.",
        "She taught at the MIT for ten years before she came home.",
        "A MIT study of the river found little change.",
        "The engine has 250 cc and two wheels.",
        "Please send the letter with cc to the whole office.",
        "Old songs in the public domain were sung at the fair.",
        "The matter is in the public domain since the trial.",
        "This is a free and public library with many books, and its reserved seats are warm.",
        "The attribution of the painting to her pupil is in doubt.",
        "All warranties on the kitchen end after two years.",
    ],
}

NOTICES = {f: [form.format(name) for name in NAMES.get(f, []) for form in FORMS] + [f"SPDX-License-Identifier: {t}" for t in TAGS.get(f, [])] + SENTENCES.get(f, []) for f in [*NAMES, "Proprietary", NONE]}


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def telling(gram: str) -> bool:
    return any(p.startswith(STEMS) for p in gram.split()) or any(f" {p} " in f" {gram} " for p in PHRASES)


def features(text: str) -> set[str]:
    w = tokens(text)
    return {g for n in (1, 2, 3) for g in grams(w, n) if telling(g)}


def _train(rows: list[set[str]], y: np.ndarray, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(features, weights, biases): softmax regression with an L1 proximal step, all classes that occur weighing the same."""
    names = sorted({g for r in rows for g in r})
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, [at[g] for g in r]] = 1
    count = np.bincount(y, minlength=k)
    share = (1 / count[y])[:, None].astype(np.float32) / (count > 0).sum()
    w, b, gold = np.zeros((len(names), k), dtype=np.float32), np.where(count > 0, 0.0, -20.0).astype(np.float32), np.eye(k, dtype=np.float32)[y]
    speed = np.zeros_like(w)
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (gold - p) * share
        speed = MOMENTUM * speed + x.T @ d
        w += RATE * speed
        b += RATE / 4 * d.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - LASSO * RATE, 0)
    full = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    if len(full) > MAX_FEATURES:
        raise ValueError(f"{len(full)} features of weight: at most {MAX_FEATURES} are sent to all tasks")
    return [names[i] for i in full], w[full].astype(np.float64), b.astype(np.float64)


def _logits(rows: list[set[str]], names: list[str], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = {g: i for i, g in enumerate(names)}
    return np.array([b + w[[at[g] for g in sorted(r) if g in at]].sum(axis=0) for r in rows])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identifiers(family: str) -> set[str]:
    """What a machine-readable tag may call a family: its names without a blank, and its other identifiers."""
    return {f"spdx:{n.lower()}" for n in [*NAMES.get(family, []), *TAGS.get(family, [])] if " " not in n}


def tag(text: str) -> str | None:
    """The identifier of a tag, as a template has it."""
    found = re.search(TAG, text.lower())
    return f"spdx:{found[1]}" if found else None


def templates(families: list[str], left_out: set[str] = frozenset()) -> tuple[dict[str, set[str]], set[str]]:
    """(the trigrams of each family's texts that tell it and its identifiers, the trigrams of ``COMMON`` families or more, which tell nothing)."""
    every = {f: {g for t in NOTICES[f] if t not in left_out for g in grams(tokens(t), 3) if telling(g)} for f in families if f != NONE}
    times: dict[str, int] = {}
    for own in every.values():
        for g in own:
            times[g] = times.get(g, 0) + 1
    common = {g for g, n in times.items() if n >= COMMON}
    return {f: own - common | identifiers(f) for f, own in every.items()}, common


def likeness(text: str, template: set[str], common: set[str]) -> float:
    """Share of a paragraph's telling trigrams, or of the template's if those are fewer, that both have; a paragraph with a tag is what the tag says, 1 or 0."""
    if named := tag(text):
        return float(named in template)
    own, known = {g for g in grams(tokens(text), 3) if telling(g)} - common, {g for g in template if not g.startswith("spdx:")}
    return len(own & known) / min(len(own), len(known)) if own and known else 0.0


@cache
def model() -> tuple[list[str], list[str], np.ndarray, np.ndarray, float, float]:
    """(families with ``none`` last, features, weights, biases, temperature, bound of unknown).

    Of each fold, a share of the families and a share of the others' notices are held out. A confirmed prediction for a family that was held out is wrong.
    """
    families = [*(f for f in NOTICES if f != NONE), NONE]
    texts = [t for f in families for t in NOTICES[f]]
    rows = [features(t) for t in texts]
    y = np.array([i for i, f in enumerate(families) for _ in NOTICES[f]])
    turn = np.concatenate([np.arange(len(NOTICES[f])) % FOLDS for f in families])
    logits, truth, like = [], [], []
    for k in range(FOLDS):
        strange = np.isin(y, [i for i in range(len(families) - 1) if i % FOLDS == k])
        held = strange | (turn == k)
        z = _logits([r for r, h in zip(rows, held) if h], *_train([r for r, h in zip(rows, held) if not h], y[~held], len(families)))
        known, common = templates(families, {t for t, h in zip(texts, held) if h})
        best = z.argmax(axis=1)
        logits.append(z)
        truth.append(np.where(strange[held], -1, y[held]))
        like.append(np.array([likeness(t, known[families[i]], common) if families[i] != NONE else 0.0 for t, i in zip([t for t, h in zip(texts, held) if h], best)]))
    z, t, like = np.concatenate(logits), np.concatenate(truth), np.concatenate(like)
    heats = np.geomspace(0.1, 10, 60)
    own = t >= 0
    heat = float(heats[np.argmin([-np.log(_softmax(z[own] / h)[np.arange(own.sum()), t[own]] + 1e-12).mean() for h in heats])])
    p = _softmax(z / heat)
    told = (p.argmax(axis=1) != len(families) - 1) & (like >= MIN_SIMILARITY)
    sure, right = p.max(axis=1), p.argmax(axis=1) == t
    bound = float(next((q for q in np.arange(0.2, 0.99, 0.02) if right[told & (sure >= q)].sum() >= PRECISION * max(1, (told & (sure >= q)).sum())), 0.98))
    return families, *_train(rows, y, len(families)), heat, bound


def _native_grams(words: Column, n: int) -> Column:
    """Word n-grams of an array of words, in order."""
    if n == 1:
        return words
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def split(text: str | None) -> list[str]:
    """The paragraphs of a text, as ``paragraphs`` has them."""
    return re.sub(WRAPPED, " ", text or "").split("\n")


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, body): the paragraphs that have a word with a stem or a phrase; repeated rows give one."""
    body = F.col(f"`{text}`").cast("string")
    whole = F.split(F.regexp_replace(body, WRAPPED, " "), "\n")
    rows = docs.where(F.lower(body).rlike(GATE)).select(F.col(f"`{doc_id}`").alias("doc_id"), F.posexplode(whole).alias("paragraph", "body"))
    return rows.where(F.lower("body").rlike(GATE)).distinct()


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): a row for each paragraph that isn't ``none``.

    ``paragraph`` is its place in the text from 0. Families that are not sure enough or that their templates do not
    confirm are ``unknown``, with the probability and similarity of the family they were taken for. Null and
    empty texts have no paragraphs, long texts are read whole. Rows that repeat id and text count once; ties go to the first family.
    """
    spark = docs.sparkSession
    families, names, w, b, heat, bound = model()
    weights = spark.createDataFrame([(g, [float(x) for x in r]) for g, r in zip(names, w)], "gram string, weight array<double>")
    own_grams, common = templates(families)
    # a template's identifiers are no trigrams: they count for paragraphs with a tag alone
    known = spark.createDataFrame([(f, sorted(t), sorted(common)) for f, t in own_grams.items()], "family string, template array<string>, common array<string>")
    words = paragraphs(docs, doc_id, text).withColumn("words", F.regexp_extract_all(F.lower("body"), F.lit(TOKEN), 0))
    rows = words.withColumn("threes", F.array_distinct(_native_grams(F.col("words"), 3)))
    every = F.array_distinct(F.concat("words", _native_grams(F.col("words"), 2), F.col("threes")))
    key = ["doc_id", "paragraph", "body"]
    hits = rows.select(*key, F.explode(every).alias("gram")).join(F.broadcast(weights), "gram")
    sums = hits.groupBy(*key).agg(*[F.sum(F.col("weight")[i]).alias(f"z{i}") for i in range(len(families))])
    # a paragraph without a feature of weight keeps the biases alone
    sums = sums.withColumnsRenamed({k: f"_{k}" for k in key})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("paragraph") == F.col("_paragraph")) & (F.col("body") == F.col("_body"))
    joined = rows.join(sums, same, "left")
    z = F.array(*[(F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + float(b[i])) / heat for i in range(len(families))])
    best = F.array_max("z")
    out = joined.select(*key, "threes", z.alias("z")).withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - best)))
    out = out.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in families]), F.array_position("z", best).cast("int"))).where(F.col("family") != NONE)
    out = out.join(F.broadcast(known), "family")
    out = out.withColumn("own", F.array_except(F.filter("threes", lambda g: g.rlike(GRAM)), "common")).withColumn("tag", F.regexp_extract(F.lower("body"), TAG, 1))
    both, least = F.size(F.array_intersect("own", "template")), F.least(F.size("own"), F.size(F.filter("template", lambda g: ~g.startswith("spdx:"))))
    tagged = F.array_contains("template", F.concat(F.lit("spdx:"), "tag")).cast("double")
    out = out.withColumn("similarity", F.when(F.col("tag") != "", tagged).when(least > 0, both / least).otherwise(F.lit(0.0)))
    # an identifier behind a tag confirms its family by itself
    sure = (F.col("probability") >= bound) & (F.col("similarity") >= MIN_SIMILARITY) | ((F.col("tag") != "") & (F.col("similarity") == 1))
    return out.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), sure.alias("confirmed"))
