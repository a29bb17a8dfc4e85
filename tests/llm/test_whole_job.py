"""Cases that an operator once left out: each would fail with the cut that it names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from riskmart.llm import common, decontamination, jaccard, langid, licenses


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def families(seed=11):
    """Texts with copies that differ in some words, so that similarities are from 0.5 to 1."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [" ".join(text(rng.randrange(1, 200))) for _ in range(60)]
    for size in (2, 5, 60):
        for _ in range(6 if size < 60 else 1):
            base = text(200)
            for _ in range(size):
                other = list(base)
                for at in rng.sample(range(200), rng.randrange(0, 6)):
                    other[at] = f"x{rng.randrange(10**6)}"
                out.append(" ".join(other))
    return [*out, out[0], out[0].upper(), None, "", "a b"]


def similar_components(texts):
    sets, parent = [shingles(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = Counter()
    for b in range(len(texts)):
        for a in range(b):
            i = len(sets[a] & sets[b])
            both = len(sets[a]) + len(sets[b])
            if 9 * i >= 4 * both:
                pairs[int(20 * i / (both - i)) if both else 20] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], pairs


@pytest.mark.parametrize("pairs", [4, jaccard.PAIRS])
def test_near_copies_from_a_similarity_of_eight_tenths(spark, pairs):
    texts = families()
    want, planted = similar_components(texts)
    assert all(planted[k] for k in (16, 17, 18, 19, 20))  # in steps of 0.05
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row: r.component for r in jaccard.near_duplicates(df, pairs=pairs).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for k, root in enumerate(want):
        groups[got[k]].add(k)
        wanted[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base, item = text(200).split(), f"{text(12)}. {text(6)}."
    near = [*base[:100], "another", *base[101:]]
    clean, twice = [text(80) for _ in range(4)], text(80)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, clean[0]), (3, clean[1]), (None, clean[2]), (None, clean[3]), (None, twice), (None, twice), (None, f"{text(60)} {item}"), (3, f"{text(60)} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({r for r in rows if r[0] != 2})
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows[:-2])


def test_decontamination_finds_short_answers(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(1, f"{text(10)}? Paris."), (2, f"{text(9)}? New York."), *[(n, f"{text(n)}.") for n in range(3, 13)]]
    rows = [(k, f"{text(50)} {item} {text(50)}") for k, item in items] + [(100 + k, text(100)) for k in range(20)] + [(200, f"{text(30)} Paris {text(30)} New York")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.question, r.answer) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(k, k): (1.0, 1.0) for k, _ in items}


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and"""


def test_licenses_wrapped_over_lines(spark):
    comment = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    texts = [f(x) for x in (MIT, GPL2, APACHE) for f in (str, lambda x: comment(x, "#"), lambda x: comment(x, " *"), lambda x: comment(x, ";;"), lambda x: x.replace("\n", "\r\n"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id // 5, r.rule, r.n_matches) for r in licenses.scan(docs).collect())
    assert got == {(0, "mit-text", 1): 5, (0, "mit-notice", 1): 5, (1, "gpl2-header", 1): 5, (2, "apache-header", 1): 5}
    cut = spark.createDataFrame([(1, "Licensed under the\n\nMIT License is not"), (2, "one\nMIT License\ntwo"), (3, "the MIT License here")], "doc_id long, text string")
    assert [(r.doc_id, r.rule) for r in licenses.scan(cut).collect()] == [(2, "mit-notice")]


def test_license_sql_reads_wrapped_texts_alike(spark):
    """The oracle on wrapped, commented and cut texts and on one sentence of each rule; nulls, a very long text, repeated rows and other columns by the names of results."""
    import duckdb

    from riskmart.llm import queries

    texts = [MIT, GPL2, APACHE, MIT.replace("\n", "\n# "), APACHE.replace("\n", "\r\n * "), GPL2.replace("\n", "\n\n"), None, "", ". ; :\n\n", "word " * 400_000 + "\n" + GPL2, MIT, GPL2 + "\n" + APACHE + "\n\n" + GPL2]
    texts += [";\n".join(licenses.SENTENCES[x][-1].replace(" ", "\n// ") for x in seq) for _, _, seq in licenses.RULES]
    rows = [(None if k == 10 else k, x, "mine", 7) for k, x in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, rule string, n_matches int")
    got = Counter((r.doc_id, r.rule, r.license, r.n_matches, ",".join(r.sentence_ids)) for r in licenses.scan(documents).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == Counter(con.execute(queries.ORACLES["op6_licenses"]).fetchall())
    assert {(None, "mit-text", "MIT", 1, "mit-notice,mit-grant,mit-condition,as-is-mit"), (9, "gpl2-header", "GPL-2.0-or-later", 1, "gpl-free,gpl2-grant,gpl-hope")} <= set(got)


def test_full_license_texts_are_one_licence_each(spark):
    """The texts as they are published, where the system has them."""
    expected = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}
    found = [(k, Path("/usr/share/common-licenses", k)) for k in expected]
    rows = [(i, path.read_text()) for i, (_, path) in enumerate(found) if path.exists()]
    if not rows:
        pytest.skip("no licence texts on this system")
    got = [(r.doc_id, r.license, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(i, expected[found[i][0]], 1) for i, _ in rows]


def test_each_license_rule_matches_its_own_sentences(spark):
    rows = [(k, ".\n\n".join(licenses.SENTENCES[x][0] for x in seq) + ".") for k, (_, _, seq) in enumerate(licenses.RULES)]
    rows.append((100, "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one"))
    got = {r.doc_id: r.rule for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: rule for k, (rule, _, _) in enumerate(licenses.RULES)} | {100: "mpl2-notice"}


def test_pipeline_keeps_documents_where_no_language_can_be_learned(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (None, "été", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {1, None}


def test_flags_of_decontamination(spark):
    rng = random.Random(15)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(k, f"{text(12)}. {text(6)}.") for k in range(30)]
    rows = [(k % 5, f"{text(50)} {items[k][1] if k % 2 else ''}", k, True) for k in range(30)] + [(None, None, 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_it int, is_contaminated boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (decontamination.SHARD_BYTES, 1000):
        got = decontamination.flag(docs, bench, shard_bytes=shard)
        assert {(r.is_it, r.is_contaminated) for r in got.collect()} == {(k, k % 2 == 1) for k in range(31)}
    assert {r.is_contaminated for r in decontamination.flag(docs, bench.where("false")).collect()} == {False}
    assert decontamination.flag(docs.where("false"), bench).count() == 0


def test_pipeline_of_clashing_names_and_of_nothing(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "some plain words", "en", 16, "a", 1.5, "x", True), (2, "some plain words", "en", 16, "b", 2.5, "y", False), (3, "other words than those", None, 22, "c", 3.5, None, None)]
    schema = "doc_id long, text string, lang string, n_chars long, language string, language_score double, row string, is_contaminated boolean"
    spark.createDataFrame([(1, "what is this? that.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for kept in (rows, []):
        docs = spark.createDataFrame(kept, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, str(tmp_path)), "test")
        assert docs.schema.names == schema.replace(" long", "").replace(" string", "").replace(" double", "").replace(" boolean", "").split(", ")
        assert {tuple(r) for r in docs.collect()} == set(kept[::2])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(kept[::2])


def test_licences_of_any_holder(spark):
    """A holder's name, wrapped or with a full stop in it, doesn't change the licence; without the sentence it is another one."""
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    source = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    binary = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software by us.\n"
    endorse = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    holders = ["Google Inc.", "the University", "the copyright holder", "Example, Inc. and\n * its friends", "X"]
    texts = [head + source + binary + "3. " + endorse.format(h) for h in holders] + [head + source + binary, head + source + binary + advert + "4. " + endorse.format("us"), head + source + binary + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert got == {k: "BSD-3-Clause" for k in (0, 1, 2, 3, 4, 7)} | {5: "BSD-2-Clause", 6: "BSD-4-Clause"}
    import duckdb

    from riskmart.llm import queries

    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM documents")
    assert Counter((r.doc_id, r.rule, r.license, r.n_matches, ",".join(r.sentence_ids)) for r in licenses.scan(docs).collect()) == Counter(con.execute(queries.ORACLES["op6_licenses"]).fetchall())


def test_rules_that_overlap_take_a_shorter_one_once(spark):
    sentences = {k: [f"sentence {k}"] for k in "abc"}
    rules = [("ab", "L1", ["a", "b"]), ("bc", "L2", ["b", "c"]), ("b", "L3", ["b"])]
    text = lambda ids: ".\n\n".join(f"sentence {k}" for k in ids)
    rows = [(0, text("abcbb")), (1, text("ab")), (2, text("b")), (3, text("babb"))]
    got = Counter((r.doc_id, r.rule, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), sentences, rules).collect())
    assert got == Counter([(0, "ab", 1), (0, "bc", 1), (0, "b", 2), (1, "ab", 1), (2, "b", 1), (3, "ab", 1), (3, "b", 2)])
