import math
import re

import duckdb
import pytest

from starquilt.llm import licenses as c

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "it under the terms of the GNU General Public License as published by": "GPL",
    "Distributed under GPLv3": "GPL-3.0",
    "You should have received a copy of the GNU Lesser General Public License": "LGPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under CC BY-SA 4.0.": "CC-BY-SA",
    "Distributed under CC BY 4.0": "CC-BY",
    "Creative Commons Attribution 4.0 International": "CC-BY",
    "Creative Commons Attribution-ShareAlike 4.0": "CC-BY-SA",
    "Text is available under the Creative Commons Attribution-ShareAlike License": "CC-BY-SA",
    "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication": "CC0",
    "Released under the MIT License.": "MIT",
    "MIT License": "MIT",
    "The MIT License (MIT)": "MIT",
    "# SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "Mozilla Public License 2.0": "MPL-2.0",
    "Licensed under the Eclipse Public License version 2.0": "EPL",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This program is distributed under the zlib license.": "Zlib",
    "Copyright 2019 Jane Roe. All rights reserved.": "proprietary",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "BSD",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
}
#: Nothing like a licence, and licences that the model has never seen.
OTHER = (
    "Her fishing license was valid in version 2 of the park.", "The apache flew over MIT while the general public watched.", "A license.", "permission", "The students at MIT received a license to fly the Apache helicopter.",
    "The court held that all rights are reserved to the state and the people.", "She said that the software is provided free of charge to any person with a license.", "Der Weg mit dem Hund ist version 3.0 der Geschichte.",
    "Licensed under the Microsoft Public License (MS-PL)", "Distributed under the PostgreSQL License", "Released under the Ruby License", "Licensed under the Academic Free License version 3.0", "Open Data Commons Attribution License",
    "GNU Free Documentation License", "IBM Public License Version 1.0", "Licensed under the Frobnicate Public License version 2.0", "under the OpenSSL license", "Sleepycat License", "Licensed under the Vim license",
)


def brute_line(line):
    """The decision in plain Python from the model's numbers and the tables alone."""
    m = c.model()
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", line.lower())
    have = set(words) | {" ".join(x) for x in zip(words, words[1:])}
    z = list(m.bias)
    for g, row in zip(m.features, m.weights):
        if g in have:
            z = [a + b for a, b in zip(z, row)]
    e = [math.exp(min(v / m.temperature, 700)) for v in z]
    k = max(range(len(e)), key=lambda i: (e[i], -i))
    p, family = e[k] / (1 + sum(e)), m.families[k]
    ids, names, clauses = c.LICENSES[family]
    share = 0
    for t in [f"spdx license identifier {i.lower().replace('-', ' ')}" for i in ids] + [*names, *clauses]:
        w = t.split()
        grams = set(w) | {" ".join(x) for x in zip(w, w[1:])}
        share = max(share, len(grams & have) / len(grams))
    return (p, -k, share, family) if p >= m.least and share >= c.CONFIRM else None


def brute(text):
    lines = (text or "").split("\n")
    alone = {i: x for i, line in enumerate(lines) if (x := brute_line(line))}
    pairs = {i: x for i in range(len(lines) - 1) if lines[i].strip(" ") and lines[i + 1].strip(" ") and (x := brute_line(lines[i] + " " + lines[i + 1]))}
    kept = list(alone.values()) + [x for i, x in pairs.items() if i not in alone and i + 1 not in alone and (i - 1 not in pairs or pairs[i - 1][1] != x[1])]
    top = max(kept, default=(None, None, None, None))
    return len(kept), ",".join(sorted({x[3] for x in kept})), top[3], top[0], top[2]


def test_statements():
    assert c.model().accuracy > 0.98
    for line, want in LINES.items():
        got = brute_line(line)
        assert (got and got[3]) == want, (line, got)
    for line in OTHER:
        assert brute_line(line) is None, (line, brute_line(line))


def test_gate_loses_nothing():
    """Without the gate's words, no template keeps the share of n-grams that confirms."""
    words = set(c.gate())
    for _, grams in c.templates():
        left = [g for g in grams if not words & set(g.split())]
        assert len(left) < c.CONFIRM * len(grams)


MIT_WRAPPED = "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software\nand associated documentation files"
TEXTS = [
    None, "", "\n\n", *LINES, *OTHER, "\n".join(LINES), "\n".join(OTHER), "word " * 50_000 + next(iter(LINES)) + " word" * 50_000, "plain text\nnothing here", "MIT License\n\nMIT License", MIT_WRAPPED, MIT_WRAPPED.replace("\n", "\n\n"),
    "licensed under the gnu\ngeneral public license version 3\nand more", "licensed under the apache\n \nlicense version 2.0", "licen", "cc", "a\n" * 3000 + "Distributed under GPLv3",
]


def test_query_is_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string, family string")
    got = c.scan(df)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {x.doc_id: x for x in got.collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate([*TEXTS, *TEXTS]):
        n, families, family, p, s = brute(t)
        x = rows[i]
        assert (x.n_paragraphs, x.families, x.family) == (n, families, family), t
        if family:
            assert x.probability == pytest.approx(p, abs=2e-6) and x.similarity == pytest.approx(s, abs=2e-6)
    assert brute(MIT_WRAPPED)[2] == "MIT"
    assert c.scan(df.limit(0)).count() == 0
    assert c.scan(df.filter("doc_id = 3").union(df.filter("doc_id = 3"))).count() == 2


def test_query_is_its_sql(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sorted(map(repr, map(tuple, c.scan(df).collect())))
    assert got == sorted(map(repr, con.execute(c.sql()).fetchall()))
