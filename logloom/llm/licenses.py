"""Licence scans: paragraphs classified into licence families by a trained sparse n-gram model.

A paragraph is a line, or lines that follow each other and only together hold a notice. Its features are the word n-grams of
one to three words that the training notices have and that hold at least one anchor, a word of TEMPLATES that is no
function word, whatever the corpus; a paragraph without an anchor has no features and is ordinary. A softmax regression
over families, "none" and "unknown" is fitted to notices drawn from TEMPLATES, to notices of other licences, some of
made-up names, to look-alikes, and to at most BACKGROUND different paragraphs of the corpus chosen by a hash (a bounded
parameter) from all places; paragraphs that hold LIKE of a template's word pairs are left out of these. Its probabilities
are calibrated by a temperature on held-out notices, and the cut for a family so that of notices of families that a model
was not shown at most NOVEL pass it.

A paragraph that is likelier a notice than not has the family that the model is sure of if the comparison with the family's
templates confirms it: at least CONFIRM of a template's word pairs are in the paragraph, and no sibling whose template is there as well has
more words of its own; a whole template needs a probability of WHOLE alone. Else its family is "unknown". A paragraph that denies a licence is ordinary. The identifiers of an SPDX
expression are judged one by one.

Whole texts are scanned. Null and empty texts have no paragraphs; a repeated row gives a row each time, an empty table none.
The result's column may not be there already; other columns pass through.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BACKGROUND, CONFIRM, LIKE, NOVEL = 4000, 0.6, 0.5, 0.05
#: The least probability of a family of which a whole template is in the paragraph.
WHOLE = 0.5
TOKEN = re.compile(r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*")
TEMPLATES = {
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "licensed under the mit license", "spdx-license-identifier mit"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org", "spdx-license-identifier apache-2.0"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gnu general public license version 2", "spdx-license-identifier gpl-3.0"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "you can redistribute it under the terms of the gnu lesser general public license"],
    "AGPL": ["licensed under the gnu affero general public license version 3", "you can redistribute it under the terms of the gnu affero general public license"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the 3-clause bsd license"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "CC": ["licensed under cc by-nc 4.0", "licensed under cc by 4.0", "licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution-noncommercial license"],
    "Public-Domain": ["this work is released into the public domain", "licensed under cc0 1.0 universal public domain dedication", "this is free and unencumbered software released into the public domain"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved", "no part of this work may be reproduced without written permission all rights reserved"],
}
#: Licences of one house, whose notices differ by their names alone: (family, name, short names, SPDX identifiers).
HOUSE = [
    ("GPL", "gnu general public license", ["gplv3", "gplv2", "gpl-3.0", "gnu gpl", "gnu gplv3", "gpl"], ["gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-2.0", "gpl-3.0"]),
    ("LGPL", "gnu lesser general public license", ["lgplv3", "lgplv2.1", "lgpl-2.1", "gnu lgpl", "gnu lgplv3", "lgpl"], ["lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgpl-2.1", "lgpl-3.0"]),
    ("LGPL", "gnu library general public license", [], []),
    ("AGPL", "gnu affero general public license", ["agplv3", "agpl-3.0", "gnu agpl", "gnu agplv3", "agpl"], ["agpl-3.0-only", "agpl-3.0-or-later", "agpl-3.0"]),
]
#: Further wordings of the families, and the identifiers of those without a house.
MORE = {
    "MIT": ["mit license", "the mit license mit", "license mit", "distributed under the mit license", "available under the terms of the mit license", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "Apache-2.0": ["apache license version 2.0 january 2004", "license apache 2.0", "distributed under the apache 2.0 license", "released under the apache license 2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "BSD": ["bsd 3-clause license", "bsd 2-clause license", "governed by a bsd-style license", "use of this source code is governed by a bsd-style license", "licensed under the bsd license", "new bsd license", "license bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "MPL-2.0": ["mozilla public license version 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at mozilla.org", "license mpl-2.0", "released under the mpl 2.0"],
    "CC": ["creative commons attribution-sharealike 3.0 unported", "creative commons attribution 3.0 unported", "creative commons attribution-noncommercial-sharealike 4.0 international", "creative commons attribution-noderivatives 4.0 international license", "creative commons license", "available under a creative commons attribution license", "licensed under cc by-nc-sa 3.0"],
    "Public-Domain": ["released under cc0", "licensed under cc0", "cc0 1.0 universal", "distributed under the unlicense", "released under the unlicense", "license unlicense", "dedicated to the public domain", "placed in the public domain"],
    "Proprietary": ["this software is proprietary and confidential unauthorized copying is strictly prohibited", "proprietary license"],
}
IDS = {
    "MIT": ["mit", "mit-0"], "Apache-2.0": ["apache-2.0"], "BSD": ["bsd-3-clause", "bsd-2-clause", "bsd-4-clause", "0bsd"], "MPL-2.0": ["mpl-2.0", "mpl-1.1"], "CC": ["cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-3.0"], "Public-Domain": ["cc0-1.0", "unlicense"],
}
for family, wordings in MORE.items():
    TEMPLATES[family] += wordings
for family, name, short, ids in HOUSE:
    TEMPLATES[family] += [name, f"{name} version 3 29 june 2007", f"{name} version 2 june 1991", f"licensed under the {name}", f"released under the {name}", f"under the terms of the {name} version 2 or at your option any later version"]
    TEMPLATES[family] += [f"this program is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation", f"you should have received a copy of the {name} along with this program"]
    TEMPLATES[family] += [t.format(x) for x in short for t in ("license {}", "licensed under the {}", "released under the {}")]
    IDS[family] = IDS.get(family, []) + ids
for family, ids in IDS.items():
    TEMPLATES[family] += [f"spdx-license-identifier {x}" for x in ids]
#: Notices of licences that are no family here, and what others say with any name: they teach the class "unknown".
OTHERS = [
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "use modification and distribution are subject to the boost software license version 1.0",
    "the contents of this file are subject to the terms of the common development and distribution license", "licensed under the eupl version 1.2", "do what you want to public license", "licensed under the academic free license version 3.0",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee is hereby granted", "covered by the microsoft public license", "this library is licensed under the open software license version 3.0", "licensed under the zlib license",
]
NAMED = [
    "licensed under the {} license", "licensed under the {} license version {}", "licensed under the {} public license {}", "released under the {} license", "released under the terms of the {} public license version {}", "distributed under the terms of the {} license {}",
    "this work is made available under the {} licence", "this program and the accompanying materials are made available under the terms of the {} public license {}", "spdx-license-identifier {}", "this file is subject to the {} license see the file license for details",
    "this software is licensed under the {} license version {}",
]
FAMILIES = ["none", *TEMPLATES, "unknown"]
UNKNOWN = len(FAMILIES) - 1
FUNCTION = set("a all and any as at be by except for from in is it may no of on or part person that the this to under with without you".split())
ANCHORS = frozenset(w for ts in TEMPLATES.values() for t in ts for w in t.split() if w not in FUNCTION and not w.isdigit())
LOOKALIKES = [
    "his driving license expired last year", "the apache helicopter landed at the base version 2.0", "the general public was informed about the work", "students of mit released a study",
    "the license plate was unreadable", "poetic license is allowed here", "all seats are reserved for members", "the public library is part of the domain", "a fishing license costs ten euros", "source code is taught in the third year",
    "the rights of all citizens", "this work was released last year", "she lost her license to sell alcohol", "the file was released to the public", "version 2.0 of the plan was released", "permission to land was granted", "the software is in the public eye", "he may copy this file", "a copy of the report was made available to the public", "the program was made available last year", "terms of the contract are subject to change", "terms of the general agreement", "licensed doctors under the age of forty",
]


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def grams(words: list[str], anchors: set[str] | None = None) -> set[str]:
    out = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            part = words[i : i + n]
            if anchors is None or any(w in anchors for w in part):
                out.add(" ".join(part))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    anchors: frozenset[str]
    features: dict[str, int]
    weights: np.ndarray  # families x features
    bias: np.ndarray
    temperature: float
    cut: float  #: the least probability of a family that is sure

    def probabilities(self, sets: list[set[str]]) -> np.ndarray:
        z = np.stack([self.bias + self.weights[:, [self.features[g] for g in s if g in self.features]].sum(axis=1) for s in sets]) / self.temperature
        return softmax(z)


Notice = tuple[list[str], int]


def drawn(seed: int = 5, each: int = 120) -> list[Notice]:
    """Notices with their classes: templates and notices of other licences in small variations, and look-alikes of no family."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "co", "di", "fen", "gol", "ka", "lum", "mor", "ne", "pri", "sa", "tor", "vex", "zi"]) for _ in range(r.randint(1, 3)))

    def varied(words: list[str]) -> list[str]:
        if len(words) > 5 and r.random() < 0.5:
            del words[r.randrange(len(words))]
        before = r.choice([[], ["this", "file", "is"], ["copyright", str(r.randint(1990, 2030))], ["the", "code", "is"], ["see", "notice"]])
        after = r.choice([[], ["see", "the", "file", "for", "details"], ["and", "no", "other"]])
        return before + words + after

    known = [(t, FAMILIES.index(f)) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in OTHERS]
    out = [(varied(t.split()), label) for t, label in known for _ in range(each // 3)]
    for t in NAMED:
        for _ in range(each // 2):
            name = " ".join(word() for _ in range(r.randint(1, 2)))
            out.append((varied(t.format(name, f"{r.randint(1, 4)}.{r.randint(0, 2)}").split()), UNKNOWN))
    return out + [(t.split() + r.choice([[], ["today"], ["as", "they", "said"]]), 0) for t in LOOKALIKES for _ in range(each // 3)]


def trained(data: list[Notice], steps: int = 160) -> tuple[Model, np.ndarray]:
    """A model whose temperature is fitted to every fourth notice, which its weights are not, and which notices these are."""
    sets, labels = [grams(w, ANCHORS) for w, _ in data], np.array([y for _, y in data])
    seen = Counter(g for s, y in zip(sets, labels, strict=True) if y for g in s)
    features = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    rows, cols = (np.array(x, dtype=np.int64) for x in ([i for i, s in enumerate(sets) for g in s if g in features], [features[g] for s in sets for g in s if g in features]))
    held = np.arange(len(sets)) % 4 == 0
    k = len(FAMILIES)
    weights, bias, speed_w, speed_b = np.zeros((k, len(features))), np.zeros(k), np.full((k, len(features)), 1e-8), np.full(k, 1e-8)
    goal = np.eye(k)[labels]
    z = np.zeros((len(sets), k))

    def scores() -> np.ndarray:
        z[:] = bias
        for c in range(k):
            z[:, c] += np.bincount(rows, weights[c, cols], len(sets))
        return z

    for _ in range(steps):  # Adagrad on the whole of the bounded sample
        miss = (softmax(scores()) - goal) * ~held[:, None] / (~held).sum()
        for c in range(k):
            g = np.bincount(cols, miss[rows, c], len(features)) + 1e-6 * weights[c]
            speed_w[c] += g * g
            weights[c] -= 0.5 * g / np.sqrt(speed_w[c])
        gb = miss.sum(axis=0)
        speed_b += gb * gb
        bias -= 0.5 * gb / np.sqrt(speed_b)
    z = scores()[held].copy()
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), labels[held]] + 1e-12).mean()
    return Model(ANCHORS, features, weights, bias, float(min(np.linspace(0.5, 3, 26), key=loss)), 0.5), held


def fit(background: list[str], seed: int = 5, folds: int = 3) -> Model:
    """The model of all families, with a cut from models that were not shown some of them: of these families' notices at most
    NOVEL reach it for another family, and the template comparison has still to confirm those that do."""
    plain = [w for p in background if not resembles(w := tokens(p))] or [[]]
    data = drawn(seed) + [(w, 0) for w in plain]
    model, _ = trained(data)
    strange = []
    for fold in range(folds):
        hidden = {i for i in range(1, UNKNOWN) if i % folds == fold}
        other, _ = trained([x for x in data if x[1] not in hidden], 40)
        p = other.probabilities([grams(w, ANCHORS) for w, y in data if y in hidden])
        strange.append(p[:, 1:UNKNOWN].max(axis=1))
    return replace(model, cut=float(min(0.95, max(0.5, np.quantile(np.concatenate(strange), 1 - NOVEL)))))


WORDS = {f: frozenset(w for t in ts for w in t.split()) for f, ts in TEMPLATES.items()}
#: A paragraph that says that something does not hold is no notice of it.
NEGATED = re.compile(r"\b(?:not|never|neither|nor|isn.t|aren.t|no longer|without being)\W+(?:\w+\W+){0,2}(?:licen[sc]ed|released|distributed|covered|governed|available|under|in the public domain)\b", re.I)
#: SPDX expressions: behind their key, or a line of at least two identifiers alone.
ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
EXPRESSION = re.compile(rf"^[^A-Za-z0-9]*(?:(?:SPDX-License-Identifier|License|Licence)\s*:\s*({ID}(?:\s+(?:OR|AND|WITH)\s+{ID})*)|({ID}(?:\s+(?:OR|AND)\s+{ID})+))[^A-Za-z0-9]*$")


def identifiers(line: str) -> list[str]:
    """The licences that an SPDX expression names, without exceptions; none for other lines."""
    m = EXPRESSION.match(line)
    if not m:
        return []
    parts = re.split(r"\s+(OR|AND|WITH)\s+", m[1] or m[2])
    names = [parts[0], *(name for sign, name in zip(parts[1::2], parts[2::2], strict=True) if sign != "WITH")]
    return [n.strip("()").rstrip("+").lower() for n in names]


PAIRS = {f: [set(zip(t.split(), t.split()[1:], strict=False)) for t in ts] for f, ts in TEMPLATES.items()}


def contained(family: str, words: list[str]) -> float:
    """The largest part of a template's word pairs that the paragraph has."""
    own = set(zip(words, words[1:], strict=False))
    return max(len(p & own) / len(p) for p in PAIRS[family])


def outdone(family: str, words: list[str]) -> bool:
    """Whether a sibling, whose template is in the paragraph too, has more words of its own there: words that the other's
    templates don't have."""
    own = set(words)
    rivals = [g for g in TEMPLATES if g != family and contained(g, words) >= CONFIRM]
    return any(len(own & WORDS[g] - WORDS[family]) > len(own & WORDS[family] - WORDS[g]) for g in rivals)


def resembles(words: list[str]) -> bool:
    """Whether a paragraph may be a notice of some family, so that nobody may call it ordinary."""
    return any(contained(f, words) >= LIKE for f in TEMPLATES)


def judged(texts: list[list[str]], model: Model) -> list[dict | None]:
    """Of each paragraph's words its family, or unknown, the likeliest known family and how alike its templates are; None if it is no notice."""
    out: list[dict | None] = []
    if not texts:
        return out
    for words, p in zip(texts, model.probabilities([grams(w, model.anchors) for w in texts]), strict=True):
        if p[0] >= 0.5 or NEGATED.search(" ".join(words)):
            out.append(None)
            continue
        best = 1 + int(p[1:UNKNOWN].argmax())
        like = contained(FAMILIES[best], words)
        sure = bool(like >= CONFIRM and p[best] >= (WHOLE if like == 1 else model.cut) and not outdone(FAMILIES[best], words))
        out.append({"family": FAMILIES[best] if sure else "unknown", "guess": FAMILIES[best], "probability": float(p[best]), "likeness": like, "confirmed": sure})
    return out


def scan(text: str | None, model: Model) -> list[dict]:
    """Of each licence paragraph its place, number of lines, family, and what speaks for it.

    Lines with anchors are judged one by one. Those without a family of their own are judged again together with their
    neighbours, as a notice may be wrapped; where that gives none, neighbours that are unknown are one paragraph."""
    if not text or model.anchors.isdisjoint(TOKEN.findall(text.lower())):
        return []
    lines = text.split("\n")
    named = {i: ids for i, p in enumerate(lines) if (":" in p or " OR " in p or " AND " in p) and len(p) < 500 and (ids := identifiers(p)) and not model.anchors.isdisjoint(tokens(p))}
    held = [(i, w) for i, p in enumerate(lines) if i not in named and not model.anchors.isdisjoint(w := tokens(p))]
    found = judged([w for _, w in held], model)
    runs: list[list[int]] = []
    for k, one in enumerate(found):
        if one and one["confirmed"]:
            continue
        if runs and runs[-1][-1] == k - 1 and held[k - 1][0] == held[k][0] - 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    out = [{"place": held[k][0], "lines": 1, **one} for k, one in enumerate(found) if one and one["confirmed"]]
    for i, ids in named.items():
        as_key, as_name = (judged([[key, x] for x in ids], model) for key in ("spdx-license-identifier", "license"))
        for one in (max(pair, key=lambda x: x["likeness"] if x else -1.0) for pair in zip(as_key, as_name, strict=True)):
            out.append({"place": i, "lines": 1, **(one or {"family": "unknown", "guess": "none", "probability": 0.0, "likeness": 0.0, "confirmed": False})})
    wrapped = [r for r in runs if len(r) > 1]
    together = judged([[w for k in r for w in held[k][1]] for r in wrapped], model) if wrapped else []
    whole = {r[0]: one for r, one in zip(wrapped, together, strict=True) if one and one["confirmed"]}
    for run in runs:
        if run[0] in whole:
            out.append({"place": held[run[0]][0], "lines": len(run), **whole[run[0]]})
            continue
        last = None
        for k in (k for k in run if found[k]):
            if last is not None and k == last + 1:
                best = max(out[-1], found[k], key=lambda x: x["likeness"])
                out[-1] |= {c: best[c] for c in ("guess", "probability", "likeness")} | {"lines": out[-1]["lines"] + 1}
            else:
                out.append({"place": held[k][0], "lines": 1, **found[k]})
            last = k
    return joined(sorted(out, key=lambda x: x["place"]), dict(held), model)


def joined(found: list[dict], words: dict[int, list[str]], model: Model) -> list[dict]:
    """A notice that one of its lines already shows takes the unknown lines before and behind it that are of one paragraph with it: together
    they have the same family."""
    out: list[dict] = []
    for one in found:
        last = out[-1] if out else None
        if last and last["place"] + last["lines"] == one["place"] and last["confirmed"] != one["confirmed"]:
            places = range(last["place"], one["place"] + one["lines"])
            both = judged([[w for i in places for w in words.get(i, [])]], model)[0]
            family = last["family"] if last["confirmed"] else one["family"]
            if both and both["confirmed"] and both["family"] == family:
                out[-1] = {"place": last["place"], "lines": len(places), **both}
                continue
        out.append(one)
    return out


FOUND = "array<struct<place: int, lines: int, family: string, guess: string, probability: double, likeness: double, confirmed: boolean>>"


def train(docs: DataFrame, text: str = "text", rows: int = BACKGROUND) -> Model:
    """A model with at most `rows` different background paragraphs, whole, chosen by their hashes from all places."""
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("p")).where("p <> ''").select("p", F.xxhash64("p").alias("h"))
    every = max(1, lines.count() // (2 * rows))
    while True:  # copies count once: where they are many, more hashes are let in
        least = lines.where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["p"]).orderBy("h", "p").limit(rows).collect()
        if every == 1 or len(least) >= rows // 2:
            return fit([r["p"] for r in least])
        every = max(1, every // 8)


def with_licences(docs: DataFrame, model: Model, text: str = "text", name: str = "licences") -> DataFrame:
    """docs with an array of the licence paragraphs of each text."""
    if name in docs.columns:
        raise ValueError(f"column {name} is there already; give another name")

    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([scan(t, model) for t in texts])

    return docs.withColumn(name, F.pandas_udf(found, FOUND)(F.col(text)))


def op1(docs: DataFrame) -> DataFrame:
    out = with_licences(docs.select("doc_id", "text"), train(docs))
    paragraphs = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    places = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["place"].cast("string"), x["family"], F.when(x["confirmed"], "confirmed").otherwise("unconfirmed"))), ",")
    return out.select("doc_id", F.coalesce(paragraphs, F.lit(0)).cast("long").alias("n_paragraphs"), F.size("licences").cast("long").alias("n_licences"), families.alias("families"), places.alias("found"))
