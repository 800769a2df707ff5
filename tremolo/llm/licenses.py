"""License scan: a trained paragraph classifier in DataFrame expressions.

A paragraph is a line, with the lines that it is wrapped into: a line break that follows no sentence
end, and no blank line, is a space. Words are runs of letters or of digits, so that GPLv3 or
CC-BY-SA-4.0 fall into their parts. Features are word n-grams (one to three words) that hold an
anchor word; a sparse multinomial logistic regression over them names the licence family or the
class ``unknown``. Probabilities are calibrated by a temperature, and a family below
``least_probability`` becomes ``unknown``. The named family is then compared with its templates by
word pairs, which confirms the prediction or leaves it unconfirmed.

The model is fitted on the library below, on the driver; applying it uses built-in functions only.
The library: notices and passages of licences, the names and identifiers of each family in frames
such as "Released under ...", and sentences that state no licence. Anchor words are the words of the names,
and words that notices are made of. Only paragraphs with an anchor word are judged, on all their
n-grams of the model; a passage that has neither a word of a name nor a notice word is not found. Paragraphs that surely state no licence (``least_licence``) give no row.

Defined results of odd inputs: null and empty texts have no paragraphs and no rows; repeated
rows give repeated results; a null doc_id is returned as null; an empty table gives an empty
result; further columns are ignored; very long lines are scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Names and identifiers of public licences, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "Apache Software License", "ASL 2.0"),
    "mit": ("MIT", "MIT License", "Expat License", "X11 license", "MIT-style license"),
    "bsd": ("BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD License", "BSD 3-Clause License", "New BSD License", "BSD-style license"),
    "gpl": ("GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later", "GNU GPL v3", "GNU General Public License", "GNU General Public License, version 3"),
    "lgpl": ("LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1-only", "LGPL-3.0-or-later", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License"),
    "agpl": ("AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-or-later", "GNU AGPL", "GNU Affero General Public License", "Affero GPL"),
    "mpl-2.0": ("MPL", "MPL-2.0", "MPL 2.0", "Mozilla Public License", "Mozilla Public License, v. 2.0"),
    "epl": ("EPL-2.0", "EPL 1.0", "Eclipse Public License", "Eclipse Public License v2.0"),
    "isc": ("ISC", "ISC License", "Internet Systems Consortium license"),
    "zlib": ("Zlib", "zlib License", "zlib/libpng license"),
    "boost": ("BSL-1.0", "Boost Software License", "Boost Software License, Version 1.0"),
    "artistic": ("Artistic-2.0", "Artistic License", "Artistic License 2.0", "Perl Artistic License"),
    "cc-by-nc": ("CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike"),
    "cc-by": ("CC BY", "CC BY 4.0", "CC-BY-4.0", "CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike"),
    "public-domain": ("CC0", "CC0 1.0 Universal", "CC0-1.0", "Unlicense", "The Unlicense", "public domain dedication"),
}
# Frames that names stand in.
FRAMES = ("Licensed under {}.", "Released under the {}.", "Distributed under {}.", "Available under {}", "This project is licensed under the {}.", "License: {}", "Code: {}", "SPDX-License-Identifier: {}", "{}", "Lizenz: {}")
# Notices and passages of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GPL version 2 or later.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "agpl": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "artistic": (
        "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself, the Artistic License.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, the Artistic License, but changing it is not allowed.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes; Creative Commons Attribution-NonCommercial license.",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung - Nicht kommerziell 4.0 International Lizenz.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution-ShareAlike license.",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.",
        "Cette oeuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal license.",
        "The author waives all copyright and related rights and places this work in the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, a work in the public domain.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "This software is proprietary; unauthorized copying is prohibited. All rights reserved.",
        "Proprietary and confidential.",
        "Alle Rechte vorbehalten.",
        "Copyright 2019 beim Verlag. Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Tous droits reserves.",
        "Todos los derechos reservados.",
        "Tutti i diritti riservati.",
        "Todos os direitos reservados.",
        "Alle rechten voorbehouden.",
    ),
}
# Sentences with words of licence language that state no licence.
OTHERS = (
    "He lost his driving license last year.", "A licensed plumber must sign the form.", "The copyright of the song was disputed in court.", "The warranty covers parts for two years.",
    "Human rights are reserved to no one.", "You need a fishing license in this county.", "The council granted permission for the public event.", "Public libraries are free for all.",
    "The redistribution of wealth was debated.", "Licensing fees rose again this quarter.", "The license plate was found in the river.", "Apache helicopters were seen over the valley.",
    "Poetic license allows for such a phrase.", "The software is provided by the vendor under a contract with warranty.", "A license agreement was signed by both parties.", "Please read the license before you go on.",
    "All seats are reserved.", "The rights to the film were sold.", "His license to practise medicine expired.", "The copyright office is closed today.", "Copyright law protects authors.",
    "The public domain of the king was large.", "Permission to land was denied.", "The warranty is void if the seal is broken.", "Ask for a license key.", "License", "Copyright", "Permission", "warranty", "licensed",
    "Er fährt mit der Bahn nach Hause.", "Sie kam mit dem Hund.", "mit freundlichen Grüßen", "Das Haus mit dem roten Dach steht leer.", "She studied physics at MIT in Boston.", "MIT researchers found a new way.", "Er geht mit.", "mit", "zusammen mit ihm",
    "Wir gehen mit euch.", "Kaffee mit Milch", "Das ist mit Abstand das Beste.", "mit und ohne Zucker", "Ein Mann mit Hut.", "Die Stadt mit dem Hafen", "Sie sprach mit ihm.", "nicht mit uns", "mit einer Tasse", "sich mit der Zeit", "und mit den Kindern", "Der Tag begann mit Regen.", "ist mit", "mit in", "von mit", "mit zu",
    "The Apache people lived in the south.", "The solar eclipse was public news.", "A total eclipse of the sun.", "An artistic skater won the prize.", "Her artistic talent showed early.", "A boost for the local economy.", "Mozilla released a new browser.",
    "Perl is an old language.", "The gnu grazes on the plain.", "A gnu was seen near the river.", "BSD systems boot quickly.", "The meeting was cc'd to all.", "Please cc me on the mail.", "100 cc of water", "Die Rechte der Kinder sind wichtig.",
    "Seine Rechte traf den Gegner.", "Les droits des femmes ont changé.", "Los derechos humanos son de todos.", "Der Führerschein ist eine Lizenz zum Fahren.", "La licence de pêche est obligatoire.", "She holds a licence to trade.", "The general public was not admitted.",
    "In general, public license plates are white.", "Commons members debated the bill.", "Creative people work at night.", "A creative idea for the garden.", "The house of commons met today.", "Attribution of the painting is doubtful.", "Permission was granted to the pilot.",
    "The store disclaims liability for lost coats.", "Proprietary traders lost money.", "The proprietary recipe is secret.", "The GPL team met in Rome.", "Reserved seating only.", "Two tables were reserved for us.", "Warranty claims must be sent by mail.", "The domain name expired.", "A public park and a public pool.",
)
# Words that licence notices are made of.
NOTICE_WORDS = ("license", "licensed", "licenses", "licensing", "sublicense", "licence", "licenced", "licences", "lizenz", "lizenziert", "licencia", "licenza", "spdx", "copyright", "copyrighted", "permission", "permissions", "permitted", "redistribution", "redistributions", "redistribute", "reserved", "vorbehalten", "réservés", "reserves", "reservados", "riservati", "voorbehouden", "warranty", "warranties", "unencumbered", "proprietary", "unauthorized")
# Words of names that are common words by themselves.
PLAIN = frozenset("the of to and v version general public software style terms new systems internet international library universal domain dedication attribution system by sa nd or later only u x".split())


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters or of digits, as the expressions below take them."""
    import regex

    return regex.findall(r"\p{L}+|\p{Nd}+", text.lower())


def _anchors() -> tuple[str, ...]:
    named = {w for names in NAMES.values() for n in names for w in words_of(n) if not w.isdigit() and w not in PLAIN}
    return tuple(sorted(named | set(NOTICE_WORDS) | {"domain"}))


ANCHORS = _anchors()


def grams_of(words: list[str]) -> set[str]:
    """The features of a paragraph: its anchor words, and n-grams of two and three words."""
    return (set(ANCHORS) & set(words)) | {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def library() -> list[tuple[str, str, int]]:
    """(family, text, number of its origin): every notice, every name in every frame, and the
    sentences that state no licence. Texts of one origin are kept back together."""
    rows, origin = [], 0
    for family in (*TEMPLATES, UNKNOWN):
        for name in NAMES.get(family, ()):
            rows += [(family, frame.format(name), origin) for frame in FRAMES]
            origin += 1
        for text in TEMPLATES.get(family, OTHERS):
            rows.append((family, text, origin))
            origin += 1
    return rows


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # one row for each n-gram
    bias: np.ndarray
    temperature: float

    def probabilities(self, grams: set[str]) -> np.ndarray:
        at = {g: k for k, g in enumerate(self.vocabulary)}
        z = (self.bias + sum((self.weights[at[g]] for g in sorted(grams) if g in at), np.zeros(len(self.families)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _regress(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 0.02, steps: int = 400, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient descent; classes weigh alike."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    one = np.eye(classes)[y]
    weight = (1.0 / (np.bincount(y, minlength=classes)[y] * classes))[:, None]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one) * weight
        w -= rate * (x.T @ g * classes + ridge * w)
        b -= rate * g.sum(0)
    return w, b


@cache
def train(kept_back: int = 3, part: int = -1) -> Model:
    """Fits the model on the library: whole texts, and beginnings and ends of long ones, which
    stand for notices that are cut short. The temperature is set on texts that the model has not
    seen: each of ``kept_back`` parts of the origins is predicted by a model of the other parts.
    ``part``: leave this part of the origins out of the library, and the temperature at 1."""
    families = (*TEMPLATES, UNKNOWN)
    rows: list[tuple[set[str], int, int]] = []
    for family, text, origin in library():
        words = words_of(text)
        parts = {tuple(words)}
        if len(words) > 12:
            parts |= {tuple(words[: len(words) * 2 // 3]), tuple(words[len(words) // 3 :])}
        for piece in sorted(parts):
            if origin % kept_back != part and set(ANCHORS) & set(piece):
                grams = grams_of(list(piece))
                rows.append((grams, families.index(family), origin % kept_back))
    vocabulary = tuple(sorted(set().union(*(g for g, _, _ in rows))))
    at = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, (grams, _, _) in enumerate(rows):
        x[r, [at[g] for g in grams]] = 1.0
    y, fold = np.array([k for _, k, _ in rows]), np.array([f for _, _, f in rows])
    z = np.zeros((len(rows), len(families)))
    for f in range(kept_back if part < 0 else 0):
        if f != part:
            w, b = _regress(x[fold != f], y[fold != f], len(families), steps=60)
            z[fold == f] = x[fold == f] @ w + b

    def loss(t: float) -> float:
        v = z / t
        v -= v.max(1, keepdims=True)
        return float((np.log(np.exp(v).sum(1)) - v[np.arange(len(v)), y]).mean())

    temperature = 1.0 if part >= 0 else min((0.15, 0.2, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    w, b = _regress(x, y, len(families), steps=150)
    return Model(families, vocabulary, np.round(w.astype(np.float64), 9), np.round(b.astype(np.float64), 9), temperature)


def _words(line: Column) -> Column:
    apart = F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{Nd}]+", " "), r"(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})", " ")
    return F.filter(F.split(apart, " +"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(words, i + 1, 2))))


def paragraph_texts(text: Column) -> Column:
    """The paragraphs of a text: lines, those joined that a sentence is wrapped over."""
    whole = F.regexp_replace(text, r"(?<![.!?:;][\"')\]]{0,1})(?<!\s)[ \t\r]*\n(?![ \t\r]*(?:\n|$))", " ")
    return F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != "")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, words) of the paragraphs with an anchor word; numbers count from 0."""
    text = F.col(f"`{text_col}`").cast("string")
    anchors = F.array(*[F.lit(a) for a in ANCHORS])
    # A look at runs of letters first: most texts have no anchor at all.
    some = F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}]+"), anchors)
    lines = F.transform(paragraph_texts(text), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), _words(x).alias("words")))
    lines = F.filter(lines, lambda s: F.arrays_overlap(s["words"], anchors))
    return docs.where(some).select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(lines).alias("p")).select("doc_id", "p.line_no", "p.line", "p.words")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_probability: float = 0.5, least_likeness: float = 0.5, least_licence: float = 0.5) -> DataFrame:
    """One row for each paragraph that states a licence with a probability of ``least_licence`` or
    more: doc_id, line_no, family, probability,
    likeness (to the nearest template of the family), confirmed."""
    spark = docs.sparkSession
    model = train()
    anchors = F.array(*[F.lit(a) for a in ANCHORS])
    # The model is a table of as many rows as the library has n-grams: a fixed size.
    weights = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in zip(model.vocabulary, model.weights, strict=True)], "gram string, w array<double>")
    base = paragraphs(docs, id_col, text_col).select("doc_id", "line_no", "words", F.xxhash64("doc_id", "line_no", "line", F.monotonically_increasing_id()).alias("row"))
    n = F.size("words")
    grams = F.array_distinct(F.flatten(F.concat(F.array(F.transform(F.array_intersect("words", anchors), lambda w: F.array(w))), F.transform(F.array(F.lit(2), F.lit(3)), lambda k: F.transform(F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice("words", i, k))))))
    sums = [F.sum(F.coalesce(F.col("w")[c], F.lit(0.0))).alias(f"s{c}") for c in range(len(model.families))]
    scored = base.select("doc_id", "line_no", "row", "words", F.explode_outer(grams).alias("g")).withColumn("gram", F.concat_ws(" ", "g")).join(F.broadcast(weights), "gram", "left").groupBy("doc_id", "line_no", "row").agg(F.first("words").alias("words"), *sums)
    z = F.array(*[(F.col(f"s{c}") + float(model.bias[c])) / model.temperature for c in range(len(model.families))])
    scored = scored.withColumn("z", z).withColumn("top", F.array_max("z")).withColumn("mass", F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    best = F.array_position("z", F.col("top")).cast("int")
    names = F.array(*[F.lit(f) for f in model.families])
    none = F.exp(F.element_at("z", len(model.families)) - F.col("top")) / F.col("mass")
    named = scored.where(1 - none >= least_licence).select("doc_id", "line_no", "words", F.element_at(names, best).alias("guess"), (1 / F.col("mass")).alias("probability"))
    named = named.withColumn("family", F.when(F.col("probability") >= least_probability, F.col("guess")).otherwise(UNKNOWN))
    kinds = spark.createDataFrame([(f, [_template_pairs(t) for t in texts]) for f, texts in _shapes().items()], "t_family string, shapes array<array<string>>")
    own = _pairs(F.col("words"))
    likeness = F.array_max(F.transform("shapes", lambda s: F.size(F.array_intersect(s, F.col("own"))) / F.greatest(F.lit(1), F.least(F.size(s), F.size("own")))))
    out = named.withColumn("own", own).join(F.broadcast(kinds), F.col("family") == F.col("t_family"), "left").withColumn("likeness", F.coalesce(likeness, F.lit(0.0)))
    return out.select("doc_id", "line_no", "family", F.round("probability", 6).alias("probability"), F.round("likeness", 6).alias("likeness"), ((F.col("family") != UNKNOWN) & (F.col("likeness") >= least_likeness)).alias("confirmed"))


def _shapes() -> dict[str, list[str]]:
    """Texts of each family, whole notices and names."""
    return {f: [*TEMPLATES[f], *NAMES.get(f, ())] for f in TEMPLATES}


def _template_pairs(text: str) -> list[str]:
    words = words_of(text)
    return sorted({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))})


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
