"""Operator 4: licence scans by a trained paragraph classifier, with Spark's own functions on the scan.

Training runs on the driver over a fixed set of notices: each family's templates, with words left
out, added and replaced by a seeded generator, against sentences that use the same words otherwise and notices of licences outside the list. A softmax regression
over word 1- to 3-grams that hold a cue word learns sparse weights; small ones are dropped. One temperature is then
fitted on held-out variants, and the bar under which a paragraph counts as unknown is set so that at most
one in a hundred held-out negatives passes and at most a quarter of the notices of licences (``LEFT_OUT``) that training never saw; the comparison with templates stops those.

A paragraph is a line together with the lines that it is wrapped over: one that ends in a letter, digit or comma goes on in a next line that begins in lower case. Paragraphs without any cue word have no feature and so are unknown; one pattern
finds the others. Their n-grams are looked up in the weights, and a predicted family counts as confirmed if
at least ``overlap`` of the words of the smaller of the paragraph and a template of the family are met in the template's order (at most ``LOOK`` words
of it may be passed over at once), one of the words that of all families this one's template alone has is among the paragraph's, if there are any, and
none that make it another licence (``OTHER``: CC BY-ND, MIT-0, Apache 1.1) are.

Defined cases: null text counts as empty; texts without findings have empty lists; equal rows give equal rows;
ties between families go to the first in ``FAMILIES``; very long texts are scanned whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.links import fresh

#: Words that make a paragraph worth classifying.
CUES = ("licence", "licensed", "license", "licenses", "licensing", "copyright", "copyrighted", "gnu", "gpl", "lgpl", "agpl", "apache", "mit", "bsd", "mozilla", "mpl", "isc", "cc", "cc0", "creative", "commons", "rights", "reserved", "permission", "warranty", "redistribution", "unlicense", "spdx", "proprietary", "lizenz", "lizenziert", "licencia", "licenciado", "rechte", "droits", "derechos", "atribuci", "compartirigual", "nocomercial")
#: Short notices of each family, as their publishers word them.
TEMPLATES = {
    "mit": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Sous licence MIT.", "Publié sous la licence MIT.", "Lizenziert unter der MIT-Lizenz.", "Veröffentlicht unter der MIT-Lizenz.", "Licenciado bajo la licencia MIT."),
    "apache": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0", "This software is distributed under the Apache License 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Sous licence Apache, version 2.0.", "Lizenziert unter der Apache-Lizenz, Version 2.0.", "Licenciado bajo la licencia Apache, versión 2.0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v2", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "Dieses Werk steht unter der GNU General Public License, Version 3.", "Lizenziert unter der GNU GPL.", "Cette œuvre est sous licence GNU General Public License, version 3.", "Sous licence GNU GPL.", "Esta obra está bajo la licencia GNU General Public License, versión 3.", "Licenciado bajo la GNU GPL."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see the licenses page.", "Lizenziert unter der GNU LGPL.", "Sous licence GNU LGPL.", "Licenciado bajo la GNU LGPL."),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "under the terms of the GNU Affero General Public License", "You should have received a copy of the GNU Affero General Public License along with this program.", "Lizenziert unter der GNU AGPL.", "Sous licence GNU AGPL.", "Licenciado bajo la GNU AGPL."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Lizenziert unter der BSD-Lizenz.", "Sous licence BSD.", "Licenciado bajo la licencia BSD."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site.", "Lizenziert unter der Mozilla Public License 2.0.", "Sous licence Mozilla Public License 2.0.", "Licenciado bajo la Mozilla Public License 2.0."),
    "isc": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Lizenziert unter der ISC-Lizenz.", "Sous licence ISC.", "Licenciado bajo la licencia ISC."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Lizenziert unter CC BY 4.0.", "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "Sous licence CC BY 4.0.", "Cette œuvre est mise à disposition sous licence Creative Commons Attribution 4.0 International.", "Licenciado bajo CC BY 4.0.", "Esta obra está bajo una licencia Creative Commons Atribución 4.0 Internacional."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Lizenziert unter CC BY-SA 4.0.", "Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0 International Lizenz.", "Sous licence CC BY-SA 4.0.", "Licence Creative Commons Attribution - Partage dans les mêmes conditions 4.0 International.", "Licenciado bajo CC BY-SA 4.0.", "Esta obra está bajo una licencia Creative Commons Atribución-CompartirIgual 4.0 Internacional."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Lizenziert unter CC BY-NC 4.0.", "Creative Commons Namensnennung - Nicht kommerziell 4.0 International Lizenz.", "Sous licence CC BY-NC 4.0.", "Licence Creative Commons Attribution - Pas d'utilisation commerciale 4.0 International.", "Licenciado bajo CC BY-NC 4.0.", "Esta obra está bajo una licencia Creative Commons Atribución-NoComercial 4.0 Internacional."),
    "cc0": ("Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under the Creative Commons CC0 license", "This is free and unencumbered software released into the public domain under the Unlicense.", "Veröffentlicht unter CC0 1.0 Universell.", "Sous licence CC0 1.0 universel.", "Publicado bajo CC0 1.0 Universal."),
    "reserved": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "This document is proprietary and confidential; all rights are reserved by the copyright holder.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."),
}
#: The same words in other use.
OTHERWISE = ("She renewed her driving license last week.", "The bill of rights was debated for years.", "A fishing license costs ten dollars.", "He asked for permission to leave the room.", "The house of commons met again today.", "The car is still under warranty until June.", "Apache helicopters flew over the valley.", "The apache web server answers requests.", "She studied physics at MIT in Boston.", "Seats are reserved for guests.", "A creative mind finds another way.", "The license plate was missing.", "Human rights are not negotiable.", "The gnu is a large antelope of the plains.", "Copyright law changed a great deal.", "Please cc me on the reply.", "The seeds' redistribution by wind takes days.", "The table is reserved under my name.", "Licensing hours end at midnight.", "Mozilla released a browser update.", "Er kam mit dem Zug nach Hause.", "Sie spielte mit den Kindern im Garten.", "Er machte die Lizenz zum Fliegen.", "Die Rechte der Kinder sind wichtig.", "Elle prépare une licence de lettres.", "Les droits de douane ont augmenté.", "La licencia de conducir venció ayer.", "Los derechos humanos son de todos.")
#: Notices of licences outside the list, of which training learns what is none of its families.
OUTSIDE = ("Licensed under the Common Development and Distribution License, version 1.0.", "This software is provided under the zlib License.", "Licensed under the Artistic License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Academic Free License version 3.0.", "Licensed under the Microsoft Public License.", "Python Software Foundation License, version 2", "Licensed under the IBM Public License Version 1.0", "Do what you want to Public License", "Licensed under the PostgreSQL License.", "Licensed under the Ruby License.", "Lizenziert unter der Zlib-Lizenz.", "Sous licence Artistique 2.0.", "Licenciado bajo la licencia PostgreSQL.")
#: Of others that it never sees; the bar is set by them.
LEFT_OUT = ("Eclipse Public License - v 2.0", "Licensed under the Eclipse Public License, Version 2.0.", "This program is made available under the terms of the Eclipse Public License 2.0", "Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public Licence, version 1.2.", "Lizenziert unter der Eclipse Public License 2.0.", "Sous licence EUPL 1.2.", "Licenciado bajo la EUPL 1.2.")
#: Words that make a licence another one than the family's, however alike the rest is.
NO_DERIVATIVES, NON_COMMERCIAL, SHARE_ALIKE = ("nd", "noderivs", "noderivatives", "keine bearbeitung", "keine bearbeitungen", "pas de modification", "sinderivadas"), ("nc", "noncommercial", "nicht kommerziell", "pas d utilisation", "nocomercial"), ("sa", "sharealike", "weitergabe", "partage", "compartirigual")
OTHER = {
    "mit": ("mit 0", "mit cmu", "mit feh", "mit enna", "mit modern", "no attribution"), "apache": ("apache 1", "license 1", "lizenz 1", "licence 1", "licencia 1", "version 1"), "gpl": ("lesser", "affero", "library general"), "lgpl": ("affero",),
    "mpl": ("mpl 1", "license 1", "version 1", "v 1"), "cc-by": (*NO_DERIVATIVES, *NON_COMMERCIAL, *SHARE_ALIKE), "cc-by-sa": (*NO_DERIVATIVES, *NON_COMMERCIAL), "cc-by-nc": (*NO_DERIVATIVES, *SHARE_ALIKE), "reserved": ("some rights",),
}
FAMILIES = tuple(TEMPLATES)
#: How many words of a template are looked at for the next one of a paragraph.
LOOK = 4
WORD = r"[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@dataclass
class Model:
    #: Weights of each n-gram, one per family and last of all unknown.
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    least: float


def varied(text: str, rng: random.Random, filler: list[str]) -> list[str]:
    """The words of a notice with some left out or replaced, and other words around it."""
    out = []
    for w in tokens(text):
        u = rng.random()
        if u < 0.06:
            continue
        out.append(rng.choice(filler) if u < 0.1 else str(rng.randint(1, 9)) if w.isdigit() and u < 0.5 else w)
    lead, tail = (rng.choices(filler, k=rng.choice((0, 0, 0, 3, 12))) for _ in "ab")
    return lead + out + tail


@lru_cache(maxsize=1)
def train(copies: int = 40, steps: int = 300, ridge: float = 2e-4, least_weight: float = 0.05, seed: int = 11) -> Model:
    rng = random.Random(seed)
    filler = sorted({w for t in OTHERWISE for w in tokens(t)} - set(CUES)) + ["der", "und", "la", "les", "que", "los", "thing", "river"]
    texts = [(k, t) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]] + [(len(FAMILIES), t) for t in (*OTHERWISE, *OUTSIDE)]
    rows = [(k, tokens(t)) for k, t in texts] + [(k, varied(t, rng, filler)) for k, t in texts for _ in range(copies)]
    # lone cue words among others are unknown too
    rows += [(len(FAMILIES), rng.choices(filler, k=4) + [rng.choice(CUES)] + rng.choices(filler, k=4)) for _ in range(copies * 8)]
    cues = set(CUES)
    known = {g for k, t in texts for g in grams(tokens(t)) if cues & set(g.split(" "))} | cues
    names = sorted(known)
    col = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    y = np.array([k for k, _ in rows])
    for i, (_, w) in enumerate(rows):
        for g in grams(w):
            if g in col:
                x[i, col[g]] += 1
    held = np.arange(len(rows)) % 5 == 4
    w, b = np.zeros((len(names), len(FAMILIES) + 1)), np.zeros(len(FAMILIES) + 1)
    one = np.eye(len(b))[y]
    m = [np.zeros_like(w), np.zeros_like(b)]
    for _ in range(steps):  # gradient steps with momentum
        z = x[~held] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) - one[~held]
        m = [0.9 * m[0] + x[~held].T @ p / len(p) + ridge * w, 0.9 * m[1] + p.mean(0)]
        w, b = w - 0.5 * m[0], b - 0.5 * m[1]
    w[np.abs(w) < least_weight] = 0
    z = x[held] @ w + b

    def chances(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min(np.linspace(0.5, 3, 26), key=lambda t: -np.log(chances(t)[np.arange(held.sum()), y[held]] + 1e-12).mean())
    negative = chances(temperature)[y[held] == len(FAMILIES)][:, :-1].max(1)
    new = np.array([[tokens_of.count(g) for g in names] for tokens_of in ([g for g in grams(tokens(t))] for t in LEFT_OUT)])
    z = new @ w + b
    unseen = chances(temperature)[:, :-1].max(1)
    least = max(0.5, float(np.quantile(negative, 0.99)), float(np.quantile(unseen, 0.75)))
    return Model({g: [round(float(v), 4) for v in w[i]] for g, i in col.items() if w[i].any()}, [round(float(v), 4) for v in b], round(float(temperature), 3), round(least, 4))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


CUE = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(CUES)) + r")(?![a-z0-9])"
#: Where a line goes on in the next one.
WRAP = r"(?<=[A-Za-z0-9,])[ \t\r]*\n[ \t]*(?=[a-z])"


def own_words() -> list[list[list[str]]]:
    """For each family and template its words that no other family's templates have."""
    every = {f: {w for t in TEMPLATES[f] for w in tokens(t)} for f in FAMILIES}
    return [[sorted({w for w in tokens(t) if not any(w in every[o] for o in FAMILIES if o != f)}) for t in TEMPLATES[f]] for f in FAMILIES]


def paragraphs(docs: DataFrame, model: Model, text: str = "text", overlap: float = 0.6) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: array of (paragraph, family, chance, confirmed), by paragraph from 0."""
    found_at, *working = fresh(docs.columns, "found", "words", "grams", "logits", "scored")
    words_at, grams_at, logits_at, scored_at = working
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.when(t.rlike(CUE), F.split(F.regexp_replace(t, WRAP, " "), "\n")).otherwise(F.array().cast("array<string>"))
    at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    words = F.transform(F.filter(at, lambda x: x.line.rlike(CUE)), lambda x: F.struct(x.i.alias("i"), F.regexp_extract_all(F.lower(x.line), F.lit(WORD), F.lit(0)).alias("w")))
    out = docs.withColumn(words_at, words)
    names, table = sorted(model.weights), _literal(model.weights, "map<string,array<double>>")

    def ngrams(w: Column) -> Column:
        def of(n: int) -> Column:
            n_at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(n_at, lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.filter(F.concat(of(1), of(2), of(3)), lambda g: g.isin(names))

    out = out.withColumn(grams_at, F.transform(words_at, lambda x: F.struct(x.i.alias("i"), x.w.alias("w"), ngrams(x.w).alias("g"))))
    start = F.array(*[F.lit(float(b)) for b in model.bias])
    logits = F.transform(grams_at, lambda x: F.struct(x.i.alias("i"), x.w.alias("w"), F.aggregate(x.g, start, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda p, q: p + q)).alias("z")))
    out = out.withColumn(logits_at, logits)
    scored = F.transform(logits_at, lambda x: F.struct(x.i.alias("i"), x.w.alias("w"), F.array_position(x.z, F.array_max(x.z)).cast("int").alias("k"), (F.lit(1.0) / F.aggregate(x.z, F.lit(0.0), lambda a, z: a + F.exp((z - F.array_max(x.z)) / model.temperature))).alias("p")))
    out = out.withColumn(scored_at, F.filter(scored, lambda x: (x.k <= len(FAMILIES)) & (x.p >= model.least)))
    forms = _literal([[{"w": tokens(t), "own": own} for t, own in zip(TEMPLATES[f], o, strict=True)] for f, o in zip(FAMILIES, own_words(), strict=True)], "array<array<struct<w:array<string>,own:array<string>>>>")
    others = _literal([[f" {w} " for w in OTHER.get(f, ())] for f in FAMILIES], "array<array<string>>")
    family = F.array(*[F.lit(f) for f in FAMILIES])

    def aligned(mine: Column, form: Column) -> Column:
        """How many words are met in the template's order."""

        def step(s: Column, w: Column) -> Column:
            ahead = F.array_position(F.slice(form, s.at + 1, LOOK), w).cast("int")
            return F.when(ahead > 0, F.struct((s.at + ahead).alias("at"), (s.n + 1).alias("n"))).otherwise(s)

        return F.aggregate(mine, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step, lambda s: s.n)

    def confirmed(x: Column) -> Column:
        told = F.concat(F.lit(" "), F.array_join(x.w, " "), F.lit(" "))
        like = F.exists(F.element_at(forms, x.k), lambda f: ((F.size(f.own) == 0) | F.arrays_overlap(x.w, f.own)) & (aligned(x.w, f.w) >= overlap * F.least(F.size(x.w), F.size(f.w))))
        return like & ~F.exists(F.element_at(others, x.k), lambda w: F.contains(told, w))

    found = F.transform(scored_at, lambda x: F.struct(x.i.alias("paragraph"), F.element_at(family, x.k).alias("family"), F.round(x.p, 6).alias("chance"), confirmed(x).alias("confirmed")))
    return out.withColumn(found_at, found).drop(*working), found_at


def scan(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, families (confirmed, sorted, joined with commas), the number of findings, and all findings as JSON."""
    found, at = paragraphs(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model or train())
    sure = F.array_sort(F.array_distinct(F.transform(F.filter(at, lambda x: x.confirmed), lambda x: x.family)))
    return found.select(F.col("key").alias(key), F.array_join(sure, ",").alias("families"), F.size(at).cast("long").alias("n_findings"), F.to_json(at).alias("findings"))
