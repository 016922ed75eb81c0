import re

import numpy as np

from profilark.functions.cluster import table
from profilark.llm import licenses, secrets
from profilark.llm.queries import queries


def test_every_planted_secret_and_nothing_else(spark, small):
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    want = sorted((i, m[1]) for i, t in docs.items() for m in re.finditer(r'\b(AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40})', t))
    got = sorted((r.doc_id, r.value) for r in queries()["op3_secret_scan"](spark, small).collect())
    assert want and got == want


def test_candidates_equal_brute_force(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text", "source")
    want = sorted((r.doc_id, k, m[0], r.text[max(0, m.start() - 5) : m.start()][-1:]) for r in docs.collect() for k, m in enumerate(re.finditer(r"[A-Za-z0-9_+/=-]{16,}", r.text)))
    got = sorted((r.id, r.number, r.value, r.before[-1:]) for r in secrets.SecretScan().candidates(docs).collect())
    assert got == want


def test_forest_on_held_out_findings(spark):
    x, y = secrets.labelled_features(spark, secrets.findings(seed=7))
    forest = secrets.Forest(x, y)
    hx, hy = secrets.labelled_features(spark, secrets.findings(seed=99, each=15))
    vote = forest.predict(hx)
    assert np.mean((vote >= 0.5) == (hy == 1)) > 0.95
    rows = spark.createDataFrame([tuple(map(float, r)) for r in hx[:200]], ", ".join(f"{f} double" for f in secrets.FEATURES))
    sql = [r[0] for r in rows.selectExpr(forest.sql()).collect()]
    assert np.allclose(sql, vote[:200])


def test_secret_edges(spark):
    key = "a81bfe2f8f3a00f5bd33f56f0c74e0dca1f5b0aa"
    rows = [(None, f'token = "{key}"', None, "x"), (1, None, "a", "x"), (2, "", "a", "x"), (3, f'{key} token="{key}"\n' * 2, "src", "x"), (4, "word " * 200_000 + f"secret = '{key}'", "p", "x"), (5, "thonerthedingthingandthe", "p", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, value string")
    got = sorted(((r.doc_id, r.number) for r in secrets.SecretScan().run(df).collect()), key=repr)
    assert got == sorted([(None, 0), (3, 1), (3, 3), (4, 0)], key=repr)
    assert secrets.SecretScan().run(df.limit(0)).count() == 0


def test_license_edges(spark):
    rows = [(1, None), (2, ""), (3, "All  RIGHTS, reserved"), (3, "All  RIGHTS, reserved"), (None, "x\nThis work is licensed under the GNU General Public Licence, version 3.\ny"), (4, "all rights reserved here and there by many people of the world"), (5, "w " * 300_000), (6, "Released under\nthe MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS unit", "1 AS n", "2 AS number")
    got = sorted((tuple(r) for r in licenses.LicenseScan(percent=80).run(df).collect()), key=repr)
    want = [(3, "line", 0, "All-rights-reserved", 1.0, 2)] * 2 + [(None, "line", 1, "GPL-3.0", 18 / 22, 11), (6, "paragraph", 0, "MIT", 1.0, 4)]
    assert got == sorted(want, key=repr)
    assert licenses.LicenseScan().run(df.limit(0)).count() == 0


def test_bounds_never_drop_a_match():
    for m in range(1, 60):
        low, high = licenses.size_bounds(m, 80)
        for n in range(1, 120):
            if 200 * min(n, m) >= 80 * (n + m):
                assert low <= n <= high


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
CONDITIONS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{0}
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{0}
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE = """{0}
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_standard_licence_files(spark):
    head = "Copyright (c) 2020, Some One\n\n"
    spaced, tight = (lambda x: x.format("")), (lambda x: x.replace("{0}\n", ""))
    texts = ["MIT License\n\n" + head + GRANT, head + spaced(CONDITIONS + CLAUSE), head + tight(CONDITIONS + CLAUSE), head + spaced(CONDITIONS), head + tight(CONDITIONS)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scan = licenses.LicenseScan(percent=80)
    got = {}
    for r in scan.run(df).collect():
        if r.unit == "paragraph":
            got.setdefault(r.doc_id, []).append((r.number, r.license))
    got = {k: [x for _, x in sorted(v)] for k, v in got.items()}
    assert got == {0: ["MIT"] * 3, 1: ["BSD", "BSD", "BSD", "BSD-3-Clause"], 2: ["BSD-3-Clause"], 3: ["BSD"] * 3, 4: ["BSD-2-Clause"]}


def test_unquoted_and_short_secrets(spark):
    key, pat = "0f3a9b1c77e2d4a6850f3a9b1c77e2d4a685beef", "ghp_Zk3vQ9xT1bN7mR5wY2cL8dF6hJ4pS0aGuE1i"
    rows = [(1, f"run it\nAPI_KEY={pat}\nnext"), (2, f"GET /v1/items?access_token={key}&page=2"), (3, 'set password = "Tr0ub4dor&3x" now'), (4, f"\nMY_LONG_SERVICE_ACCESS_TOKEN={pat}\n")]
    df = spark.createDataFrame([(i, t, ".env") for i, t in rows], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.value) for r in secrets.SecretScan().run(df).collect())
    assert got == [(1, pat), (2, key), (3, "Tr0ub4dor&3x"), (4, pat)]
