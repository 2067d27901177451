import pytest

from tablework.llm import license_scan as L

DOCS = "doc_id long, text string, path string"


def test_notices_are_found_in_whole_texts(spark):
    rows = [(1, "word " * 50 + "\nLicensed under the Apache License, Version 2.0.\n" + "other text " * 40, "a/x"),
            (2, "Released under the MIT License.", "a/LICENSE"), (3, "the license of the house and the public", "a/b/y"),
            (4, None, "a/b/z"), (5, "", "c/z"), (6, "lorem " * 60_000 + " SPDX-License-Identifier: MIT", None),
            (7, "x licensed UNDER cc by-nc 4.0 y", "c/w"), (8, "plain words only here", "a/q"),
            (9, "this work is licensed under the gnu general public license version 3", "root")]
    df = spark.createDataFrame([(*r, "c") for r in rows], DOCS + ", cosine string")
    got = {r.doc_id: r for r in L.scan(df, ["doc_id", "path"]).collect()}
    assert {i: got[i].own_license for i in got} == {1: "Apache-2.0", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT",
                                                    7: "CC-BY-NC-4.0", 8: None, 9: "GPL-3.0"}
    assert got[2].share == 1.0 and got[1].share < 0.1


def brute(rows):
    """own licence, else the nearest ancestor directory with a licence file."""
    rules = {}
    for _, path, lic, cos, share in rows:
        if lic and share >= L.SHARE and path is not None:
            n = rules.setdefault(path.rpartition("/")[0], {}).setdefault(lic, [0, 0])
            n[0] += 1
            n[1] = max(n[1], cos)
    best = {d: min(c, key=lambda k: (-c[k][0], -c[k][1], k)) for d, c in rules.items()}
    out = {}
    for i, path, lic, _, _ in rows:
        if lic:
            out[i] = (lic, "file")
            continue
        out[i] = (None, None)
        d = None if path is None else path.rpartition("/")[0]
        while d is not None:
            if d in best:
                out[i] = (best[d], d)
                break
            d = None if d == "" else d.rpartition("/")[0]
    return out


def test_nearest_ancestor(spark):
    rows = [(1, "a/LICENSE", "MIT", 1.0, 1.0), (2, "a/b/c/f", None, None, 0.0), (3, "a/b/LICENSE", "ISC", 0.9, 0.8),
            (4, "a/b/LICENSE2", "MIT", 0.8, 0.9), (5, "a/x", None, None, 0.0), (6, "z/x", None, None, 0.0), (7, "top", None, None, 0.0),
            (8, None, None, None, 0.0), (9, "a/b/d/own", "GPL-3.0", 0.9, 0.1), (10, "a/b/d/e", None, None, 0.0), (5, "a/x", None, None, 0.0),
            (11, "ab/x", None, None, 0.0)]
    ddl = "doc_id long, path string, own_license string, cosine double, share double"
    for more in ([], [(12, "COPYING", "BSD-3-Clause", 1.0, 1.0)]):
        got = {r.doc_id: (r.license, r.license_from) for r in L.inherit(spark.createDataFrame(rows + more, ddl)).collect()}
        assert got == brute(rows + more)
    assert L.inherit(spark.createDataFrame([], ddl)).count() == 0


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_every_template_is_its_own_best_match(name):
    import pyarrow as pa

    from tablework.llm import words as W
    vocab = L.vocabulary(L.TEMPLATES)
    t = L.Templates.build(L.TEMPLATES, vocab, vocab.astype(float) * 0, 10)
    for text in L.TEMPLATES[name]:
        got = L.notices(t, L._gate(vocab), *W.text_bytes(pa.array(["", text])))
        assert [(d, t.names[k]) for d, k, _, _ in got] == [(1, name)] or len(L._hashes(text)) < L.LEAST
