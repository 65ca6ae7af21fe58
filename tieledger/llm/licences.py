"""Licence notices in whole texts: a trained paragraph classifier whose predictions templates confirm.

Everything that touches the corpus runs on DataFrame functions.

* A paragraph is a block of lines between blank ones; a line of comment marks alone is blank.  What is judged are its lines, and
  windows of ``WINDOW`` words over the whole block every half window, for notices that are wrapped.  Lines with an anchor or a
  gate word are candidates.  Gate words are chosen from all words of the templates, so that half of the bigrams of any template
  cannot be without one: nothing that could be confirmed is passed over.
* Features are distinct word unigrams, bigrams and trigrams that occur in the templates.  A logistic regression for each
  family, with L1, is fitted to templates, to templates with words lost, swapped or added, and to candidates of a bounded
  sample of the corpus that resemble no template.  The sparse weights become a map in the plan.
* A candidate whose best family stays below a threshold is ``unknown``.  The threshold is calibrated on what training has
  not seen: it best parts kept-out notices from plain paragraphs and from notices of families that were kept out whole.
* In a line of identifiers joined by OR or AND each is judged for itself.
* A family is confirmed if the unit holds half of the word bigrams of one of its templates, or if half of the unit's own are
  in a template and one of those has the family's name.  The best of the confirmed families is predicted; without one the unit
  is ``unknown``.  A family that only windows show counts once a block.

Defined cases: a null or blank text has no paragraphs; repeated rows are treated alike; an empty table gives an empty one; with
an empty corpus the model is fitted to templates alone; other columns are not looked at.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices by family, as they are commonly written above or below a text.
TEMPLATES = {
    "AGPL": [
        "SPDX-License-Identifier: AGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the AGPL v3 license.",
    ],
    "Apache-1.1": [
        "SPDX-License-Identifier: Apache-1.1",
        "Licensed under the Apache License, Version 1.1.",
        "The Apache Software License, Version 1.1.",
    ],
    "Apache-2.0": [
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "BSD": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "CC BY 4.0",
        "Text is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC, no commercial use.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Text is available under the Creative Commons Attribution-NoDerivatives License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC0": [
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "EPL": [
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License.",
        "Eclipse Public License 2.0",
    ],
    "EUPL": [
        "SPDX-License-Identifier: EUPL-1.2",
        "Licensed under the European Union Public Licence (EUPL), version 1.2.",
        "Licensed under the EUPL.",
    ],
    "GFDL": [
        "SPDX-License-Identifier: GFDL-1.3",
        "Licensed under the GNU Free Documentation License, version 1.3.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
    ],
    "GPL": [
        "SPDX-License-Identifier: GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL v2 license.",
        "GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-2.0",
        "GPL v3",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "LGPL": [
        "SPDX-License-Identifier: LGPL-2.1",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL.",
        "GNU Lesser General Public License v2.1",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT license. See the LICENSE file for details.",
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under MPL 2.0 license.",
    ],
    "Proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying is prohibited. All rights reserved.",
    ],
}
FAMILIES = sorted(TEMPLATES)
#: A line with one of these, in lower case, is a candidate in any case.
ANCHORS = ("licen", "copyright", "rights reserved", "redistribut", "public domain", "creative commons", "permission is", "cc0", "gpl")
#: Share of template bigrams that confirms, or of the unit's own.  A template with fewer bigrams than NAMED whose family has names
#: confirms only with one of them; one with fewer than SHORT whose family has none, by the lesser share of the two.
CONFIRMS, NAMED, SHORT = 0.5, 8, 5
#: Words of which a short notice has one, by family.
NAMES = {"AGPL": ["affero", "agpl"], "Apache-1.1": ["apache"], "Apache-2.0": ["apache"], "BSD": ["bsd"], "CC0": ["cc0"], "EPL": ["eclipse", "epl"], "EUPL": ["eupl"], "GFDL": ["gfdl"], "GPL": ["gpl"], "ISC": ["isc"], "LGPL": ["lesser", "lgpl"], "MIT": ["mit"], "MPL-2.0": ["mozilla", "mpl"]}
#: Parts of the templates that are kept out in turn.
FOLDS = 3
#: Words of a window.  Half a window of running words of any template is more than half of its bigrams.
WINDOW = 40
#: Words of the templates that are common elsewhere, and gate words only at need.
COMMON = frozenset("0 1 2 3 4 a all and any are as at be by can deal except for found free has in is it may met no not of or part person prior public see text that the this to under use v version with without work you".split())

_SPLIT = r"[^\p{L}\p{N}]+"
#: Ends of line with nothing between them but marks; atomic, since CR LF is one end.
_BLANK = r"(?>\r\n|\r|\n)(?:[^\p{L}\p{N}\r\n]*+(?>\r\n|\r|\n))+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower().replace("licence", "license")) if w]


def grams_of(words: list[str], longest: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(paragraph), F.lit("licence"), F.lit("license")), _SPLIT), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Distinct word n-grams of an array of words; the words behind each are laid beside it, so the work grows with their number."""
    def from_(i: int) -> Column:
        return F.slice(words, i + 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))

    out = from_(0)
    for i in range(1, n):
        out = F.zip_with(out, from_(i), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(out)


def _places(words: Column) -> Column:
    """Where in an array of words there are words of templates, which are few in most texts."""
    known = F.array_intersect(words, _strings(TEMPLATE_WORDS))
    every = F.sequence(F.lit(0), F.size(words) - 1)
    return _once(known, lambda k: F.filter(every, lambda i: F.array_contains(k, F.get(words, i))))


def _grams_at(words: Column, places: Column, n: int) -> Column:
    """The n-grams that begin there; all that occur in templates are among them."""
    def gram(i: Column) -> Column:
        return reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.get(words, i + k) for k in range(n)])

    return F.array_compact(F.transform(places, gram))


def bigrams_of(text: str) -> set[str]:
    return {g for g in grams_of(words_of(text), 2) if " " in g}


def gate_words() -> list[str]:
    """Few words such that any half of the bigrams of any template has one, and the names of families."""
    texts = [t for f in FAMILIES for t in TEMPLATES[f]]
    left = [[set(g.split()) for g in bigrams_of(t)] for t in texts]
    most = [math.ceil(CONFIRMS * len(pairs)) - 1 for pairs in left]
    usable = sorted({w for f in FAMILIES for t in TEMPLATES[f] for w in words_of(t)})
    chosen = sorted({w for ws in NAMES.values() for w in ws})

    left = [[g for g in pairs if not g & set(chosen)] for pairs in left]
    while now := sum(max(0, len(pairs) - m) for pairs, m in zip(left, most, strict=True)):
        gain = dict.fromkeys(usable, 0)
        for pairs, m in zip(left, most, strict=True):
            for w in set().union(*pairs):
                over = len(pairs) - m
                gain[w] += max(0, over) - max(0, over - sum(w in g for g in pairs))
        # a common one only where no other helps
        chosen.append(min(usable, key=lambda w: (not gain[w], w in COMMON, now - gain[w], w)))
        left = [[g for g in pairs if chosen[-1] not in g] for pairs in left]
    return sorted(chosen)


GATE = gate_words()


def gate_pairs() -> list[str]:
    """Bigrams such that any half of those of any template has one, and those with the name of a family; of common words at need only."""
    chosen = set()
    for f in FAMILIES:
        for t in TEMPLATES[f]:
            own = sorted(bigrams_of(t), key=lambda g: (-sum(w in COMMON for w in g.split()), g))
            chosen.update(own[math.ceil(CONFIRMS * len(own)) - 1 :])
            chosen.update(g for g in own if set(g.split()) & set(NAMES.get(f, ())))
    return sorted(chosen)


PAIRS = gate_pairs()
#: All words of templates, and all bigrams.
TEMPLATE_WORDS = sorted({w for f in FAMILIES for t in TEMPLATES[f] for w in words_of(t)})
LISTED_PAIRS = sorted({g for f in FAMILIES for t in TEMPLATES[f] for g in bigrams_of(t)})


def _strings(values: list[str]) -> Column:
    """A constant array, handed over as one text; words and n-grams hold no line feed."""
    return F.split(F.lit("\n".join(values)), "\n")


def _numbers(values: list[float]) -> Column:
    return F.split(F.lit(" ".join(map(repr, map(float, values)))), " ").cast("array<double>")


def _rows_of_numbers(rows: list[list[float]]) -> Column:
    """A constant array of arrays, of which one is taken without a copy of the others."""
    return F.from_json(F.lit(json.dumps([[float(x) for x in row] for row in rows])), "array<array<double>>")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _anchored(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in ANCHORS])


def _holds_anchor(text: Column) -> Column:
    return _once(F.lower(text), _anchored)


def _may_hold(text: Column) -> Column:
    """Whether a text can have a candidate: an anchor or a gate word, of which only short ones need their bounds here."""
    long = [w for w in GATE if len(w) > 4 and not any(a in w for a in ANCHORS)]
    short = [w for w in GATE if len(w) <= 4 and not any(a in w for a in ANCHORS)]
    bounded = r"(?<![\p{L}\p{N}])(?:" + "|".join(short) + r")(?![\p{L}\p{N}])"
    # one of the short words is what most texts with any have, so it is looked for first
    return _once(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.rlike(bounded), _anchored(low), *[F.contains(low, F.lit(w)) for w in long]]))


def _gated(words: Column) -> Column:
    return F.arrays_overlap(words, _strings(GATE))


#: An identifier of a licence, and several of them joined.
_ID = r"(?:MIT|ISC|[A-Za-z]+[0-9]?(?:-[A-Za-z]+)*-[0-9][A-Za-z0-9.+-]*)"
_JOINED = rf"{_ID}(?: WITH [A-Za-z0-9.+-]+)?\)?(?: +(?:OR|AND) +\(?{_ID}(?: WITH [A-Za-z0-9.+-]+)?\)?)+"
_UNITS = "array<struct<no:int,line:int,w:array<string>,p:string>>"


def _lines(block: Column) -> Column:
    return F.filter(F.split(block, r"[\r\n]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _line_units(block: Column, no: Column) -> Column:
    """One unit a line; where identifiers are joined by OR or AND, one for each of them."""

    def unit(text: Column, i: Column) -> Column:
        return F.struct(no.alias("no"), i.alias("line"), _words(text).alias("w"), text.alias("p"))

    def of_line(x: Column, i: Column) -> Column:
        named = F.regexp_extract_all(F.regexp_replace(F.regexp_extract(x, _JOINED, 0), " WITH [A-Za-z0-9.+-]+", ""), F.lit(_ID), F.lit(0))
        each = F.transform(named, lambda y: unit(F.concat(F.lit("SPDX-License-Identifier: "), y), i))
        joined = (F.contains(x, F.lit(" OR ")) | F.contains(x, F.lit(" AND "))) & x.rlike(_JOINED)
        return F.when(joined, each).otherwise(F.array(unit(x, i)))

    each = F.flatten(F.transform(_lines(block), of_line))
    return F.filter(each, lambda x: _gated(x["w"]) | _holds_anchor(x["p"])).cast(_UNITS)


def _window_units(block: Column, no: Column, lines: Column) -> Column:
    """Windows over the words of a block; none where its only line is one window, which is judged as a line.

    A line that holds a notice by itself is left out, so that it is not read again as a relative of its family.  Only confirmed
    windows count, so those are left out that have no bigram without which none is confirmed.
    """
    def settled(i: Column) -> Column:
        return F.exists(lines, lambda y: (y["paragraph"] == no) & (y["line"] == i) & y["confirmed"] & (y["similarity"] >= CONFIRMS))

    words = F.flatten(F.transform(_lines(block), lambda x, i: F.when(settled(i), F.array(F.lit("\n"))).otherwise(_words(x))))

    def paired(w: Column) -> Column:
        """Whether there is such a bigram at all; of a block without, no window is cut."""
        return F.arrays_overlap(_grams_at(w, _places(w), 2), _strings(PAIRS))

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))
        each = F.transform(starts, lambda i: F.struct(no.alias("no"), F.lit(None).cast("int").alias("line"), F.slice(w, i, WINDOW).alias("w"), F.lit("").alias("p")))
        return F.filter(each, lambda x: _gated(x["w"]) & F.arrays_overlap(_grams(x["w"], 2), _strings(PAIRS)))

    several = F.size(_lines(block)) > 1
    return _once(words, lambda w: F.when((several | (F.size(w) > WINDOW)) & paired(w), cut(w)).otherwise(F.array().cast(_UNITS))).cast(_UNITS)


def _blocks(text: Column) -> Column:
    """Blocks that may have a candidate, each with its number among all; none for most texts."""
    lettered = F.filter(F.split(text, _BLANK), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    numbered = F.transform(lettered, lambda x, i: F.struct(i.alias("no"), x.alias("text")))
    return F.filter(numbered, lambda x: _may_hold(x["text"]))


def _units_of(blocks: Column, of) -> Column:
    """Array of struct (number of the block, of the line or null, words, text)."""
    return F.flatten(F.transform(blocks, lambda x: of(x["text"], x["no"]))).cast(_UNITS)


def _units(text: Column, of) -> Column:
    return _units_of(_blocks(text), of)


def candidate_paragraphs(text: Column) -> Column:
    """Units that are lines."""
    return _units(text, _line_units)


@dataclass
class LicenceModel:
    bias: list[float]
    weights: dict[str, list[float]]
    threshold: float

    def scores(self, grams: set[str]) -> list[float]:
        out = list(self.bias)
        for g in grams:
            for k, w in enumerate(self.weights.get(g, ())):
                out[k] += w
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in out]


def _variants(text: str, draw: random.Random, noise: list[str], n: int) -> list[str]:
    """Other ways to write a notice: words lost or swapped, foreign words before or behind."""
    out = []
    for _ in range(n):
        words = words_of(text)
        if draw.random() < 0.5 and len(words) > 5:
            del words[draw.randrange(len(words))]
        if draw.random() < 0.2 and len(words) > 5:
            i = draw.randrange(len(words) - 1)
            words[i], words[i + 1] = words[i + 1], words[i]
        extra = [draw.choice(noise) for _ in range(draw.randrange(8))] if noise else []
        out.append(" ".join(words + extra if draw.random() < 0.5 else extra + words))
    return out


def _regress(rows: list[tuple[list[int], int]], n_features: int, n_families: int, turns: int = 30, rate: float = 0.3, l1: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of each family against the rest, by stochastic steps with per-coordinate rates and soft thresholds."""
    w, seen = np.zeros((n_features, n_families)), np.ones((n_features, n_families))
    bias, bias_seen = np.full(n_families, -2.0), np.ones(n_families)
    feats, own = [np.array(x, np.int64) for x, _ in rows], np.arange(n_families)
    order, draw = list(range(len(rows))), random.Random(n_families)
    for _ in range(turns):
        draw.shuffle(order)
        for i in order:
            x, y = feats[i], rows[i][1]
            at = w[x]
            g = 1 / (1 + np.exp(-np.clip(bias + at.sum(0), -60.0, 60.0))) - (own == y)
            moves = np.abs(g) >= 1e-4
            if not moves.any():
                continue
            g *= moves
            bias_seen += g * g
            bias -= rate * g / np.sqrt(bias_seen)
            seen[x] += g * g
            new = at - rate * g / np.sqrt(seen[x])
            w[x] = np.where(moves, np.sign(new) * np.maximum(0.0, np.abs(new) - l1), at)
    return bias, w


def _threshold(hits: list[float], alarms: list[float], relatives: list[float]) -> float:
    """The score that best parts kept-out notices from plain paragraphs and from notices of unlisted families, a share of each weighing alike."""

    def over(scores: list[float], t: float) -> float:
        return sum(s >= t for s in scores) / max(1, len(scores))

    return max((t / 100 for t in range(5, 100)), key=lambda t: (over(hits, t) - over(alarms, t) - over(relatives, t), t))


def fit(docs: DataFrame, max_docs: int = 4000, max_negatives: int = 600, max_stretches: int = 200, seed: int = 3) -> LicenceModel:
    """Fit to the templates, and to candidates without resemblance from about ``max_docs`` documents chosen by a hash.

    The threshold comes from what training has not seen: in turn, a third of the templates with all their variants and of the paragraphs
    without a notice, and then a third of the families, are kept out and judged by a model of the rest.
    """
    draw = random.Random(seed)
    texts = docs.select("text").where("text IS NOT NULL")
    n, hashed = texts.count(), F.pmod(F.xxhash64("text"), F.lit(2**31))
    part = texts.where(hashed < int(2**31 * min(1.0, max_docs / max(1, n))))
    found = part.select(F.explode(candidate_paragraphs(F.col("text"))).alias("x")).select(F.col("x.p").alias("p")).distinct()
    known = {t: grams_of(words_of(t), 2) for f in FAMILIES for t in TEMPLATES[f]}
    known_pairs = [bigrams_of(t) for t in known]

    def draw_from(words: list[str], n: int = 60) -> list[str]:
        """A stretch of running words somewhere in a text."""
        i = draw.randrange(max(1, len(words) - n))
        return words[i : i + n]

    corpus = [r["p"] for r in found.orderBy(F.xxhash64("p"), "p").limit(max_negatives).collect()]
    # a stretch of a text is cut out where the text is, so that whole texts do not travel
    place = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.length("text") - 600, F.lit(1))).cast("int") + 1
    stretches = part.select(hashed.alias("h"), F.substring("text", place, F.lit(600)).alias("p")).orderBy("h", "p").limit(max_stretches)
    plain = [draw_from(words_of(r["p"])) for r in stretches.collect()]
    noise = sorted({w for ws in plain for w in ws})[:4000]

    def like(p: str) -> float:
        # a line of a wrapped notice resembles by its own bigrams
        own, pairs = grams_of(words_of(p), 2), bigrams_of(p)
        return max(max(len(own & t) / len(t) for t in known.values()), max(len(pairs & t) for t in known_pairs) / max(1, len(pairs)))

    negatives = [p for p in corpus if like(p) < 0.3]
    # sentences of the corpus with an anchor word put in are no notices either
    for ws in plain:
        if len(ws) > 6:
            anchor = draw.choice(["license", "licensed under", "copyright", "public domain", "the license", "released under"])
            i = draw.randrange(len(ws))
            negatives.append(" ".join([*ws[:i], anchor, *ws[i:]]))
    rows = [(v, k, i % FOLDS) for k, f in enumerate(FAMILIES) for i, t in enumerate(TEMPLATES[f]) for v in [t] * 3 + _variants(t, draw, noise, 12)]
    rows += [(p, -1, i % FOLDS) for i, p in enumerate(negatives)]
    vocabulary = sorted({g for f in FAMILIES for t in TEMPLATES[f] for g in grams_of(words_of(t))})
    ids = {g: i for i, g in enumerate(vocabulary)}
    coded = [(sorted(ids[g] for g in grams_of(words_of(p)) if g in ids), y, fold) for p, y, fold in rows]

    def trained(used: list, turns: int) -> tuple[np.ndarray, np.ndarray]:
        return _regress([(x, y) for x, y, _ in used], len(ids), len(FAMILIES), turns)

    bias, w = trained(coded, 30)
    weights = {g: w[i].tolist() for g, i in ids.items() if np.abs(w[i]).max() > 1e-3}
    model = LicenceModel(bias.tolist(), weights, 0.5)
    hits, alarms, relatives = [], [], []

    def best_of(bias: np.ndarray, w: np.ndarray, feats: list[int], listed: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip((bias + w[feats].sum(0))[listed].max(), -60.0, 60.0))))

    for fold in range(FOLDS):
        bias, w = trained([r for r in coded if r[2] != fold], 6)
        for feats, y, of in coded:
            if of == fold:
                (alarms if y < 0 else hits).append(best_of(bias, w, feats, np.ones(len(FAMILIES), bool)))
        # families that the model has not seen stand for those that nobody listed
        listed = np.arange(len(FAMILIES)) % FOLDS != fold
        bias, w = trained([r for r in coded if r[1] < 0 or listed[r[1]]], 6)
        relatives += [best_of(bias, w, feats, listed) for feats, y, _ in coded if y >= 0 and not listed[y]]
    model.threshold = _threshold(hits, alarms, relatives)
    return model


def _judged(words: Column, model: LicenceModel) -> Column:
    """struct (k, score, similarity, sure) of the words of one unit: the best of the families that are confirmed, or else of all."""
    grams = sorted(model.weights)
    listed, weights = _strings(grams), _rows_of_numbers([model.weights[g] for g in grams])
    own = _once(_places(words), lambda at: F.array_intersect(F.concat(*[_grams_at(words, at, n) for n in (1, 2, 3)]), listed))
    of = lambda g: F.get(weights, F.array_position(listed, g).cast("int") - 1)
    sums = F.aggregate(own, _numbers(model.bias), lambda s, g: F.zip_with(s, of(g), lambda a, b: a + b))

    def likeness(pairs: Column) -> Column:
        """Those of the unit's bigrams that are listed, against each family; how many it has in all counts only then."""
        none = F.array(*[F.struct(F.lit(0.0).alias("like"), F.lit(0.0).alias("own"))] * len(FAMILIES))
        return F.when(F.size(pairs) > 0, _once(F.size(_grams(words, 2)), lambda n: F.array(*against(pairs, n)))).otherwise(none)

    def against(pairs: Column, n: Column) -> list[Column]:
        out = []
        for f in FAMILIES:
            each, own = [], [F.lit(0.0)]
            for t in TEMPLATES[f]:
                grams = sorted(bigrams_of(t))
                shared = F.size(F.array_intersect(_strings(grams), pairs))  # the second array is hashed
                named = [g for g in grams if set(g.split()) & set(NAMES.get(f, ()))]
                like = shared / F.lit(float(max(1, len(grams))))
                if named and len(grams) < NAMED:
                    like = F.when(F.arrays_overlap(pairs, _strings(named)), like).otherwise(0.0)
                elif not named and len(grams) < SHORT:
                    like = F.least(like, shared / F.greatest(n, F.lit(1)))
                each.append(like)
                if named:
                    own.append(F.when(F.arrays_overlap(pairs, _strings(named)), shared / F.greatest(n, F.lit(1))).otherwise(0.0))
            out.append(F.struct(F.greatest(*each).alias("like"), F.greatest(F.lit(0.0), *own).alias("own")))
        return out

    like = _once(F.array_intersect(_grams_at(words, _places(words), 2), _strings(LISTED_PAIRS)), likeness)

    def family(x: Column, y: Column) -> Column:
        score = 1 / (1 + F.exp(-x))
        sure = (score >= model.threshold) & (F.greatest(y["like"], y["own"]) >= CONFIRMS)
        return F.struct(sure.alias("sure"), score.alias("score"), y["like"].alias("similarity"))

    scored = F.transform(F.zip_with(sums, like, family), lambda x, i: F.struct(x["sure"].alias("sure"), x["score"].alias("score"), (-i).alias("first"), x["similarity"].alias("similarity")))
    return F.array_max(scored)


_LISTED = "array<struct<paragraph:int,line:int,family:string,score:double,similarity:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: LicenceModel, text: str = "text") -> DataFrame:
    """``docs`` with ``licences``: array of struct (paragraph, line, family, score, similarity, confirmed).

    There is one for every candidate line, and one without a line for each family that only windows of a paragraph show.
    """
    names = _strings(FAMILIES)

    def finished(x: Column) -> Column:
        j = _judged(x["w"], model)
        return F.element_at(F.transform(F.array(F.struct(x["no"].alias("no"), x["line"].alias("line"), j.alias("j"))), listed), 1)

    def listed(x: Column) -> Column:
        j = x["j"]
        family = F.when(j["sure"], F.element_at(names, 1 - j["first"])).otherwise(F.lit("unknown"))
        return F.struct(x["no"].alias("paragraph"), x["line"].alias("line"), family.alias("family"), j["score"].alias("score"), j["similarity"].alias("similarity"), j["sure"].alias("confirmed"))

    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # lines and windows are both cut from the blocks, which are found once
    out = docs.withColumn("__blocks", _blocks(own)).withColumn("__lines", F.transform(_units_of(F.col("__blocks"), _line_units), finished).cast(_LISTED))
    out = out.withColumn("__wide", F.transform(_units_of(F.col("__blocks"), lambda x, i: _window_units(x, i, F.col("__lines"))), finished).cast(_LISTED))

    def known(x: Column, others: Column) -> Column:
        return F.exists(others, lambda y: (y["paragraph"] == x["paragraph"]) & (y["family"] == x["family"]))

    def add(a: Column, x: Column) -> Column:
        return F.when(x["confirmed"] & ~known(x, a), F.concat(a, F.array(x))).otherwise(a).cast(_LISTED)

    return out.withColumn("licences", F.aggregate("__wide", F.col("__lines"), add)).drop("__blocks", "__lines", "__wide")


def report(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_notices, families (sorted, joined by commas; unknown ones apart), best_score."""
    found = scan(docs.select("doc_id", "text"), model)
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform("licences", lambda x: x["score"])), F.lit(0.0)).alias("best_score"),
    )
