"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

A multinomial logistic regression over the presence of word uni- and bigrams judges paragraphs: each line, and each two
lines that follow one another without a blank one between, since a sentence may be wrapped (such a pair counts only if
neither line is judged by itself, and not again where the pair before it has the same family). The model is trained on
the driver from statements made of the tables below, with words dropped and surroundings added; the unknown class learns
from common words, near misses, and statements of licences with invented names. On held-out examples a temperature is
fitted, and the least probability is set that keeps the unknown ones unknown. A prediction counts only if the paragraph
holds at least `CONFIRM` of the n-grams of some template of its family: a name, an SPDX line or a clause.

Before n-grams are made, lines pass a gate that loses nothing: for every template it holds some words without which
less than `CONFIRM` of the template's n-grams can be there (`gate`), so a line with none of them is never confirmed.

The scan is made of DataFrame functions alone: n-grams are exploded only for paragraphs that pass the gate, meet the
weights by a broadcast of the model (bounded by the templates' own n-grams), and are gathered for each paragraph.

Defined cases: a null or empty text has no licence; a long text is scanned whole; repeated rows are each scanned; a
paragraph takes its most probable family (ties: the first in code-point order), a text its most probable paragraph (ties:
that family again, then the better similarity); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRM = 0.7
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"

#: SPDX identifiers, names as they are written in statements, and clauses of the licence texts themselves.
LICENSES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "AGPL-3.0": (("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), ("gnu affero general public license version 3", "gnu affero general public license", "agplv3", "gnu agpl v3", "agpl version 3", "agpl 3.0"), ("terms of the gnu affero general public license as published by the free software foundation",)),
    "Apache-2.0": (("Apache-2.0",), ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache software license", "apache license v2", "apache 2.0", "apache license"), ("you may not use this file except in compliance with the license", "apache license version 2.0 january 2004", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "you may obtain a copy of the license at")),
    "Artistic": (("Artistic-1.0", "Artistic-2.0"), ("artistic license 2.0", "perl artistic license", "artistic license"), ()),
    "BSD": (("BSD-2-Clause", "BSD-3-Clause", "0BSD"), ("3 clause bsd license", "bsd 3 clause license", "2 clause bsd license", "bsd 2 clause license", "new bsd license", "modified bsd license", "simplified bsd license", "bsd style license", "bsd license"), ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products")),
    "BSL-1.0": (("BSL-1.0",), ("boost software license version 1.0", "boost software license"), ("boost software license version 1.0 august 17th 2003",)),
    "CC-BY": (("CC-BY-3.0", "CC-BY-4.0"), ("cc by 4.0", "cc by 3.0", "cc by license", "creative commons attribution 4.0 international", "creative commons attribution 3.0", "creative commons attribution license"), ()),
    "CC-BY-NC": (("CC-BY-NC-3.0", "CC-BY-NC-4.0"), ("cc by nc 4.0", "cc by nc 3.0", "cc by nc license", "creative commons attribution noncommercial 4.0 international", "creative commons attribution non commercial license", "creative commons attribution noncommercial"), ()),
    "CC-BY-NC-ND": (("CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0"), ("cc by nc nd 4.0", "cc by nc nd license", "creative commons attribution noncommercial noderivatives 4.0 international", "creative commons attribution non commercial no derivatives"), ()),
    "CC-BY-NC-SA": (("CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"), ("cc by nc sa 4.0", "cc by nc sa license", "creative commons attribution noncommercial sharealike 4.0 international", "creative commons attribution non commercial share alike"), ()),
    "CC-BY-ND": (("CC-BY-ND-3.0", "CC-BY-ND-4.0"), ("cc by nd 4.0", "cc by nd license", "creative commons attribution noderivatives 4.0 international", "creative commons attribution no derivatives"), ()),
    "CC-BY-SA": (("CC-BY-SA-3.0", "CC-BY-SA-4.0"), ("cc by sa 4.0", "cc by sa 3.0", "cc by sa license", "creative commons attribution sharealike 4.0 international", "creative commons attribution sharealike 4.0", "creative commons attribution sharealike license", "creative commons attribution share alike license"), ()),
    "CC0": (("CC0-1.0",), ("cc0 1.0 universal", "cc0 1.0", "cc0 license", "cc0 public domain dedication"), ("the author has waived all copyright and related or neighboring rights to this work", "to the extent possible under law")),
    "CDDL": (("CDDL-1.0", "CDDL-1.1"), ("common development and distribution license", "cddl version 1.0"), ()),
    "EPL": (("EPL-1.0", "EPL-2.0"), ("eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v1.0", "eclipse public license"), ("accompanying materials are made available under the terms of the eclipse public license",)),
    "EUPL": (("EUPL-1.1", "EUPL-1.2"), ("european union public licence", "european union public license version 1.2", "eupl version 1.2"), ()),
    "GPL": ((), ("gnu general public license", "gnu gpl license", "gpl license"), ("redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license as published by", "you should have received a copy of the gnu general public license along with this program", "see the gnu general public license for more details")),
    "GPL-2.0": (("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), ("gnu general public license version 2", "gnu general public license v2.0", "gnu gpl version 2", "gpl license version 2", "gpl version 2", "gnu gpl v2", "gpl 2.0", "gplv2"), ()),
    "GPL-3.0": (("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), ("gnu general public license version 3", "gnu general public license v3.0", "gnu gpl version 3", "gpl license version 3", "gpl version 3", "gnu gpl v3", "gpl 3.0", "gplv3"), ()),
    "ISC": (("ISC",), ("isc license", "internet systems consortium license"), ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    "LGPL": (("LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only"), ("gnu lesser general public license version 2.1", "gnu lesser general public license version 3", "gnu lesser general public license", "gnu library general public license", "lgpl license", "lgplv3", "gnu lgpl v2.1", "lgpl 2.1"), ("terms of the gnu lesser general public license as published by the free software foundation",)),
    "MIT": (("MIT",), ("mit license", "mit licence", "the mit license mit", "mit x11 license", "expat license"), ("permission is hereby granted free of charge to any person obtaining a copy", "to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied")),
    "MPL-2.0": (("MPL-2.0", "MPL-1.1"), ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v 2.0", "mozilla public license", "mpl version 2.0", "mpl 2.0"), ("this source code form is subject to the terms of the mozilla public license",)),
    "OFL-1.1": (("OFL-1.1",), ("sil open font license version 1.1", "sil open font license", "open font license"), ()),
    "proprietary": ((), ("all rights reserved",), ("no part of this publication may be reproduced without prior written permission", "unauthorized copying of this file via any medium is strictly prohibited", "proprietary and confidential")),
    "PSF": (("PSF-2.0", "Python-2.0"), ("python software foundation license version 2", "python software foundation license"), ()),
    "Unlicense": (("Unlicense",), ("the unlicense license", "unlicense license"), ("this is free and unencumbered software released into the public domain",)),
    "WTFPL": (("WTFPL",), ("do what the fuck you want to public license", "wtfpl license", "wtfpl version 2"), ()),
    "Zlib": (("Zlib",), ("zlib license", "zlib libpng license"), ("this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software")),
}
#: What stands before a name, and what stands for one in statements of licences that are none of these.
LEADS = ("licensed under the", "licensed under", "released under the", "released under", "distributed under the", "distributed under", "available under the", "published under the terms of the", "this work is licensed under the", "covered by the", "subject to the", "under the terms of the", "text is available under the", "is free software under the", "license", "")
OTHERS = ("{} license", "{} public license", "{} public license version 2.0", "{} software license version 1.0", "{} license 2.0", "{} general license version 3", "{} open license", "{} community license agreement", "{} source license", "{} {} public license", "{} license version 3", "{} free documentation license", "{} attribution license", "{} commons license")
#: What is near a licence and is none.
NEAR_MISSES = (
    "his driving license was taken away", "the license plate of the car was blue", "she asked permission to leave the room", "the court issued a warrant", "a fishing license is required here", "general public opinion on the matter",
    "the apache helicopter landed near the river", "students of mit asked for permission", "the warranty of the washing machine ran out", "copyright law is a subject of study", "redistribution of wealth was debated",
    "version 3 of the report needs a license fee", "the public license office opens at nine", "a creative license taken by the author", "the software needs a license key", "mozilla asked for permission to test", "nurses must be licensed under state law",
    "the film rights were licensed to a studio", "marriage license", "license to kill", "pub licensed under the act of 1964", "he warrants that the goods are new", "gnu herds need no license", "version 2.0 of the software is available", "the european union public opinion", "a common development and distribution plan",
    "the commons voted on attribution of the work", "artistic freedom needs no license", "the boost to software sales", "the eclipse was public and free", "mit der zeit", "see the license for details", "all rights are equal", "the python in the zoo", "an open font of wisdom", "the license",
    "all rights are reserved to the state", "permission was granted to any person", "the source code and binary forms of the word", "free of charge to any person", "a copy of the software and its documentation files", "the author of this work has no right", "version 3 of the program",
)
BACKGROUND = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so what time up go about than into could state only new year some take come these know see use get like then first any work now may such give over think most even find day also after way many must look before great back through long where much should well people down own just because good each those feel seem how high too place little world very still nation hand old life tell write become here show house both between need mean call develop under last right move thing general school never same another begin while number part turn real leave might want point form off child few small since against ask late home interest large person end open public follow during present without again hold govern around possible head consider word program problem however lead system set order eye plan run keep face fact group play stand increase early course change help line city put close case force meet once water upon war build hear light unite live every country bring center let side try provide continue name certain power pay result question study woman member until far night always service away report something company week church toward start social room figure nature though young less enough almost read include president nothing yet better big boy cost business value second why clear expect family complete act sense mind experience art next near direct car law industry important girl god several matter usual rather per often kind among white reason action return foot care simple within love human along appear doctor believe speak active student month drive concern best door hope example inform body ever least understand reach effect different idea whole control condition field pass fall note special talk particular today measure walk teach low hour type carry rate remain full street easy although record sit determine level local sure receive thus moment spirit train college religion perhaps music grow free cause serve age book board recent sound office cut step class true history position above strong friend necessary add court deal tax support party whether either land material happen education death agree arm mother across quite anything town past view society manage answer break organize half fire lose money stop actual already effort wait department able political learn voice air together shall cover common subject draw short wife treat limit road letter color behind produce send term total university rise century success minute remember purpose test fight watch situation south ago difference stage father table rest bear entire market prepare explain offer plant charge ground west picture hard front lie modern dark surface rule regard dance peace observe future wall farm claim firm operation further pressure property morning amount top outside piece sometimes beauty trade fear demand wonder list accept judge paint mile soon responsible allow secretary heart union slow island enter drink story experiment stay paper space apply decide share desire spend sign therefore various visit supply officer doubt private immediate wish contain feed raise describe ready horse son exist north suggest station effective food deep wide alone character english happy critic unit product respect drop nor fill cold represent sudden basic kill fine trouble mark single press heavy attempt origin standard everything committee moral black red bad earth accord else mere die remark basis except equal east event employ defense smile river improve game detail account cent sort reduce club buy attention ship decision wear inside win suppose ride operate realize sale choose park square vote price district dead foreign window beyond direction strike instead trial practice catch opportunity likely recognize permit serious attack floor association spring lot stock lack hair science relation profession pattern quick medical influence occasion machine compare husband blue international fair especially indeed imagine surprise average official temperature difficult sing hit tree race police touch relative throw quality former pull chance prove argue settle growth date heat save performance count production listen main pick size cool army patient combine summer hall slight command enjoy length proper express health chief evening store language degree lay current gun dog hotel strange separate boat fail clean dress anyone gain pain object knowledge depend relate below dollar advance shape arrange population yes sell mention dry check poet sleep join hot bed electric dream due season manner fit left progress neither strength notice finish opinion bill western truth wrong travel suit bank exact honor brother quiet marry corner handle danger hospital pool promise conclusion beside born coast somehow".split()


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(text: str) -> list[str]:
    """Distinct word uni- and bigrams."""
    w = words_of(text)
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


def templates() -> list[tuple[str, list[str]]]:
    """(family, n-grams) of every name, SPDX line and clause."""
    return [(f, ngrams(t)) for f, (ids, names, clauses) in sorted(LICENSES.items()) for t in (*(f"SPDX-License-Identifier: {i}" for i in ids), *names, *clauses)]


def gate() -> list[str]:
    """Words of which every paragraph that can be confirmed holds one.

    For each template, words are taken until the n-grams they stand in are more than a paragraph may lack; long and
    uncommon ones first, and those that serve another template already.
    """
    taken: set[str] = set()
    common = set(BACKGROUND) | {"this", "these", "do", "does", "can", "am", "were", "being"}
    for _, grams in sorted(templates(), key=lambda t: (len(t[1]), t)):
        words = sorted((g for g in grams if " " not in g), key=lambda w: (w in common, len(w) < 4, w not in taken, -len(w), w))
        lost: set[str] = set()
        for w in words:
            if len(grams) - len(lost) < CONFIRM * len(grams):
                break
            lost |= {g for g in grams if w in g.split()}
            taken.add(w)
    return sorted(taken)


def _gates() -> tuple[list[str], str]:
    """The gate's words of five characters and more, which are looked for anywhere, and a pattern that finds the others as words."""
    return [w for w in gate() if len(w) > 4], "(^|[^a-z0-9])(" + "|".join(re.escape(w) for w in gate() if len(w) < 5) + ")([^a-z0-9]|$)"


class Model:
    """Families, n-gram weights against the unknown class, biases, temperature and least probability."""

    def __init__(self, seed: int = 7, each: int = 40, rounds: int = 300):
        r = random.Random(seed)
        self.families = sorted(LICENSES)
        self.templates = templates()
        stop = set(BACKGROUND) - {"public", "general", "open", "free", "python", "boost", "common", "commons", "union", "library", "law", "rights", "work", "program"}
        self.features = sorted({g for _, t in self.templates for g in t if g not in stop} | {g for x in (*LEADS, *OTHERS) for g in ngrams(x.replace("{}", " ")) if g not in stop})
        at = {g: k for k, g in enumerate(self.features)}

        def around(words: list[str]) -> str:
            return " ".join([*r.choices(BACKGROUND, k=r.randint(0, 9)), *words, *r.choices(BACKGROUND, k=r.randint(0, 9))])

        def invented() -> str:
            return r.choice(BACKGROUND) if r.random() < 0.6 else "".join(r.choices("abcdefghiklmnoprstuvw", k=r.randint(3, 9)))

        def examples(n: int) -> tuple[np.ndarray, np.ndarray]:
            texts: list[tuple[str, int]] = []
            for k, f in enumerate(self.families, 1):
                ids, names, clauses = LICENSES[f]
                pool = [*(f"SPDX-License-Identifier: {i}" for i in ids), *names, *clauses, *(x for x in names if x.count(" ") < 2)]
                for i in range(n):
                    whole = pool[i % len(pool)]
                    words = words_of(f"{r.choice(LEADS)} {whole}" if whole in names and f != "proprietary" and r.random() < 0.6 else whole)
                    kept = [w for w in words if r.random() > 0.05] if whole in clauses else words
                    texts.append((around(kept), k))
            for _ in range(3 * n):
                texts.append((around([]), 0))
                texts.append((around(words_of(r.choice(NEAR_MISSES))), 0))
                texts.append((around(r.sample([g for g in self.features if " " not in g], 3)), 0))
            for _ in range(12 * n):
                name = re.sub(r"{}", lambda _: invented(), r.choice(OTHERS))
                texts.append((around(words_of(f"{r.choice(LEADS)} {name}")), 0))
            x = np.zeros((len(texts), len(self.features)), np.float32)
            for i, (t, _) in enumerate(texts):
                x[i, [at[g] for g in ngrams(t) if g in at]] = 1
            return x, np.array([k for _, k in texts])

        x, y = examples(each)
        want = np.eye(len(self.families) + 1, dtype=np.float32)[y]
        w, b = np.zeros((len(self.features), want.shape[1]), np.float32), np.zeros(want.shape[1], np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - want) / len(x)
            vw, vb = 0.9 * vw + x.T @ d + 1e-5 * w, 0.9 * vb + d.sum(axis=0)
            w, b = w - 1.5 * vw, b - 1.5 * vb
        self.weights = np.round((w[:, 1:] - w[:, :1]).astype(float), 4)  # against the unknown class
        self.bias = np.round((b[1:] - b[0]).astype(float), 4)
        hx, hy = examples(max(8, each // 2))
        z = np.c_[np.zeros(len(hx)), hx @ self.weights + self.bias]

        def probabilities(t: float) -> np.ndarray:
            e = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        self.temperature = min((k / 10 for k in range(3, 41)), key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(hy)), hy], 1e-12)).mean())
        chance = probabilities(self.temperature)
        highest = chance[hy == 0, 1:].max(axis=1)
        self.least = round(float(min(0.9, max(0.5, np.quantile(highest, 0.99)))), 6)
        self.accuracy = float((np.where(chance[:, 1:].max(axis=1) >= self.least, chance[:, 1:].argmax(axis=1) + 1, 0) == hy).mean())


@functools.cache
def model() -> Model:
    return Model()


def _grams(words: Column) -> Column:
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _judged(grams: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (`by`, _id, _of), one for each n-gram that the model knows: a row for each paragraph that is confirmed, with _p, _k (less the family's number) and _s.

    Paragraphs that hold too little of every template go first; the others alone meet the weights.
    """
    m = model()
    lengths = F.array(*[F.lit(float(len(x))) for _, x in m.templates])
    of_family = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(len(x))).alias("n")) for t, (f, x) in enumerate(m.templates) if f == name]) for name in m.families])
    gathered = grams.groupBy(*by).agg(F.collect_list("_id").alias("_ids"), F.flatten(F.collect_list("_of")).alias("_hits"))
    held = lambda t, n: F.size(F.filter("_hits", lambda h: h == t)) / n
    near = gathered.filter(F.exists(F.array_distinct("_hits"), lambda t: held(t, F.element_at(lengths, t + 1)) >= F.lit(CONFIRM)))
    met = near.select(*by, "_hits", F.explode("_ids").alias("_id")).join(F.broadcast(weights), "_id")
    summed = met.groupBy(*by).agg(F.collect_list("_w").alias("_ws"), F.first("_hits").alias("_hits"))
    z = F.aggregate("_ws", _doubles(m.bias.tolist()), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    odds = F.transform(z, lambda v: F.exp(F.least(v / F.lit(m.temperature), F.lit(700.0))))
    ranked = summed.select(*by, "_hits", odds.alias("_e")).withColumn("_b", F.array_max(F.transform("_e", lambda v, k: F.struct(v.alias("e"), (-k).alias("k")))))
    ranked = ranked.withColumn("_p", F.col("_b.e") / (F.aggregate("_e", F.lit(1.0), lambda a, v: a + v))).withColumn("_k", F.col("_b.k")).filter(F.col("_p") >= F.lit(m.least))
    share = F.array_max(F.transform(F.element_at(of_family, 1 - F.col("_k")), lambda t: held(t["t"], t["n"])))
    return ranked.withColumn("_s", share).filter(F.col("_s") >= F.lit(CONFIRM)).select(*by, "_p", "_k", "_s")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_paragraphs (with a licence), families (distinct, comma-joined, in order), family, probability and similarity of the most probable paragraph."""
    m = model()
    none = [0.0] * len(m.families)
    weights = dict(zip(m.features, m.weights.tolist(), strict=True))
    of: dict[str, list[int]] = {}
    for t, (_, grams) in enumerate(m.templates):
        for g in grams:
            of.setdefault(g, []).append(t)
    every = sorted({*weights, *of})
    table = df.sparkSession.createDataFrame([(g, k, of.get(g, [])) for k, g in enumerate(every)], "_gram string, _id int, _of array<int>")
    weighed = df.sparkSession.createDataFrame([(k, weights.get(g, none)) for k, g in enumerate(every)], "_id int, _w array<double>")

    long, short = _gates()
    passes = lambda c: functools.reduce(lambda a, b: a | b, [c.contains(s) for s in long]) | c.rlike(short)
    rows = df.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    # a line that may be a licence, at an even place, and its pairs with the lines before and after it, at odd ones
    lines = rows.filter(passes(F.col("_text"))).select("_row", F.split("_text", "\n").alias("_l"))
    lines = lines.withColumn("_y", F.transform("_l", passes))
    blank = lambda c: F.trim(c) == ""
    here = lambda i: F.element_at("_l", i)
    single = F.transform(F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_y", i)), lambda i: F.struct((2 * i).alias("at"), here(i).alias("line")))
    starts = F.when(F.size("_l") > 1, F.sequence(F.lit(1), F.size("_l") - 1)).otherwise(F.array().cast("array<int>"))
    couple = F.filter(starts, lambda i: (F.element_at("_y", i) | F.element_at("_y", i + 1)) & ~blank(here(i)) & ~blank(here(i + 1)))
    couple = F.transform(couple, lambda i: F.struct((2 * i + 1).alias("at"), F.concat_ws(" ", here(i), here(i + 1)).alias("line")))
    units = lines.select("_row", F.explode(F.concat(single, couple)).alias("_u")).select("_row", F.col("_u.at").alias("_at"), F.regexp_extract_all("_u.line", F.lit(f"({WORD})"), 1).alias("_words"))
    grams = units.select("_row", "_at", F.explode(_grams(F.col("_words"))).alias("_g")).join(F.broadcast(table), F.col("_g") == F.col("_gram"))
    found = _judged(grams.select("_row", "_at", "_id", "_of"), weighed, ["_row", "_at"])

    # what counts in a text: lines, and pairs that touch none of these nor follow a pair of the same family
    all_of = found.groupBy("_row").agg(F.collect_list(F.struct("_p", "_k", "_s", "_at")).alias("_all"))
    alone = F.transform(F.filter("_all", lambda x: x["_at"] % 2 == 0), lambda x: x["_at"])
    paired = F.transform(F.filter("_all", lambda x: x["_at"] % 2 == 1), lambda x: F.struct(x["_at"], x["_k"]))
    marked = all_of.select("_row", "_all", alone.alias("_alone"), paired.alias("_paired"))
    counted = F.filter("_all", lambda x: (x["_at"] % 2 == 0) | ~(F.array_contains("_alone", x["_at"] - 1) | F.array_contains("_alone", x["_at"] + 1) | F.array_contains("_paired", F.struct((x["_at"] - 2).alias("_at"), x["_k"].alias("_k")))))
    best = marked.select("_row", counted.alias("_c")).select(F.col("_row").alias("_of_row"), F.size("_c").alias("_n"), F.array_sort(F.array_distinct(F.transform("_c", lambda x: F.element_at(F.array(*map(F.lit, m.families)), 1 - x["_k"])))).alias("_f"), F.array_max("_c").alias("_top"))
    top = F.when(F.col("_top").isNotNull(), F.element_at(F.array(*map(F.lit, m.families)), 1 - F.col("_top._k")))
    out = rows.drop("_text").join(best, F.col("_row") == F.col("_of_row"), "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce(F.array_join("_f", ","), F.lit("")).alias("families"), top.alias("family"), F.round("_top._p", 6).alias("probability"), F.round("_top._s", 6).alias("similarity")
    )


def sql() -> str:
    """The same scan in DuckDB's SQL, with the model's numbers written out."""
    m = model()
    grams = sorted({*m.features, *(g for _, t in m.templates for g in t)})
    weights = dict(zip(m.features, m.weights.tolist(), strict=True))
    zero = [0.0] * len(m.families)
    table = ",\n  ".join(f"('{g}', {weights.get(g, zero)}, {[k for k, (_, t) in enumerate(m.templates) if g in t]}::INT[])" for g in grams)
    families = ", ".join(f"({k}, '{f}', {float(b)!r})" for k, (f, b) in enumerate(zip(m.families, m.bias, strict=True)))
    lengths = ", ".join(f"({k}, {m.families.index(f)}, {len(t)})" for k, (f, t) in enumerate(m.templates))
    long, short = _gates()
    passes = lambda c: "(" + " OR ".join(f"contains({c}, '{x}')" for x in long) + f" OR regexp_matches({c}, '{short}'))"
    return f"""
WITH model(gram, w, tpl) AS (VALUES
  {table}
), fam(k, family, bias) AS (VALUES {families}), tpl(t, k, n) AS (VALUES {lengths}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, lower(text) AS body FROM documents),
cut AS (SELECT rid, string_split(body, chr(10)) AS l FROM docs WHERE {passes('body')}),
numbered AS (SELECT rid, i, l[i] AS line, l[i + 1] AS next FROM (SELECT rid, l, unnest(range(1, len(l) + 1)) AS i FROM cut)),
units AS (
  SELECT rid, 2 * i AS pos, line FROM numbered WHERE {passes('line')}
  UNION ALL SELECT rid, 2 * i + 1, line || ' ' || next FROM numbered WHERE next IS NOT NULL AND trim(line, ' ') <> '' AND trim(next, ' ') <> '' AND ({passes('line')} OR {passes('next')})
),
words AS (SELECT rid, pos, regexp_extract_all(line, '{WORD}') AS w FROM units),
grams AS (SELECT rid, pos, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS gram FROM words),
met AS (SELECT rid, pos, w, tpl FROM grams JOIN model USING (gram)),
sums AS (SELECT rid, pos, fam.k AS k, sum(w[fam.k + 1]) AS z FROM met, fam GROUP BY ALL),
hits AS (SELECT rid, pos, t, count(*) AS n FROM (SELECT rid, pos, unnest(tpl) AS t FROM met) GROUP BY ALL),
share AS (SELECT rid, pos, tpl.k AS k, max(hits.n / CAST(tpl.n AS DOUBLE)) AS s FROM hits JOIN tpl USING (t) GROUP BY ALL),
odds AS (SELECT rid, pos, k, exp(least((z + bias) / {m.temperature!r}, 700.0)) AS e FROM sums JOIN fam USING (k)),
chance AS (SELECT rid, pos, k, e / (sum(e) OVER (PARTITION BY rid, pos) + 1.0) AS p FROM odds),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid, pos ORDER BY p DESC, k) AS r FROM chance),
yes AS (SELECT ranked.rid, ranked.pos, ranked.k, family, p, s FROM ranked JOIN fam USING (k) JOIN share ON share.rid = ranked.rid AND share.pos = ranked.pos AND share.k = ranked.k WHERE r = 1 AND p >= {m.least!r} AND s >= {CONFIRM}),
counted AS (SELECT * FROM yes y WHERE pos % 2 = 0 OR NOT EXISTS (SELECT 1 FROM yes x WHERE x.rid = y.rid AND (x.pos = y.pos - 1 OR x.pos = y.pos + 1 OR x.pos = y.pos - 2 AND x.k = y.k))),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, k, s DESC) AS r FROM counted),
per_row AS (SELECT rid, count(*) AS n, array_to_string(list_sort(list_distinct(list(family))), ',') AS families, max(CASE WHEN r = 1 THEN family END) AS family, max(CASE WHEN r = 1 THEN p END) AS p, max(CASE WHEN r = 1 THEN s END) AS s FROM best GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_paragraphs, coalesce(families, '') AS families, family, round(p, 6) AS probability, round(s, 6) AS similarity FROM docs LEFT JOIN per_row USING (rid)
"""
