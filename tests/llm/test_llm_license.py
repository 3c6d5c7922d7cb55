import random
import re

import pytest
from llm_helpers import CLASHING, LOW, docs

from gauntlet.llm import license_scan as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text, phrases):
    words = WORD.findall((text or "").translate(LOW))
    found = [(i, p, label) for p, label in phrases.items() for i in range(len(words))
             if words[i:i + p.count(" ") + 1] == p.split()]
    return words, sorted(found)


def check(rows, got):
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        words, found = places(text, M.BASE_PHRASES)
        row = by_id[doc_id]
        at = [i for i, *_ in found]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (
            len(words), len(at), min(at, default=None), max(at, default=None)), doc_id
        assert row.base_labels == ",".join(sorted({label for *_, label in found}))
        if "spdx" not in (text or "").lower():
            more = {label for *_, label in places(text, M.MORE_PHRASES)[1]}
            assert row.labels == ",".join(sorted(more | {label for *_, label in found}))
        assert 0 <= row.score <= 1


def test_whole_table_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in table.collect()], M.scan_licenses(table).collect())


def test_random_texts_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "gnu general public license apache MIT Cc by nc version 2 0 domain é ü9 x".split()
    gaps = [" ", "\n", "-", ", ", "\t\t", "\x00", "\x7f", ":", "(", "--\r\n"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "mit license " * 50_000), (904, "gnu general public licenses")]
    check(rows, M.scan_licenses(docs(spark, rows)).collect())


def test_phrases_do_not_cross_rows(spark):
    got = {r.doc_id: r.n_base for r in M.scan_licenses(docs(spark, [(1, "mit"), (2, "license"), (3, "mit license")])).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def value(text):
    return M.evaluate(M.postfix(text.lower().encode())[0])


@pytest.mark.parametrize("text,names,freedom", [
    ("MIT", {"mit"}, 0.9),
    ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.9),
    ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.3),
    ("CC0-1.0 OR GPL-2.0 AND Apache-2.0", {"cc0-1.0", "gpl-2.0", "apache-2.0"}, 1.0),
    ("(CC0-1.0 OR GPL-2.0) AND GPL-3.0", {"cc0-1.0", "gpl-2.0", "gpl-3.0"}, 0.3),
    ("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT", {"gpl-2.0+ with classpath-exception-2.0", "mit"}, 0.65),
    ("((MIT))", {"mit"}, 0.9),
    ("something-new", {"something-new"}, M.UNKNOWN_FREEDOM),
])
def test_expressions(text, names, freedom):
    assert value(text) == M.Licence(frozenset(names), freedom)


@pytest.mark.parametrize("text", ["", "(", "MIT OR", "(MIT", "AND MIT", "()", "(MIT OR GPL-2.0) WITH X"])
def test_broken_expressions(text):
    with pytest.raises(ValueError):
        value(text)


def test_random_expressions_evaluate_like_python(spark):
    rng = random.Random(11)

    def build(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice(["mit", "gpl-2.0", "cc0-1.0", "lgpl-2.1", "cc-by-nc-4.0"])
            return name, M.identifier(name).freedom, 3
        operator = rng.choice(["and", "or"])
        binds = {"and": 2, "or": 1}[operator]
        parts = [build(depth - 1) for _ in range(2)]
        texts = [t if b >= binds and rng.random() < 0.7 else f"( {t})" for t, _, b in parts]
        return f"{texts[0]} {operator} {texts[1]}", (min if operator == "and" else max)(p[1] for p in parts), binds

    for _ in range(300):
        text, freedom, _ = build(4)
        assert value(text).freedom == freedom, text


def test_tags_in_texts(spark):
    rows = [(1, "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nint x;"), (2, "# spdx-license-identifier: BSD-3-Clause\r\nand MIT"),
            (3, "SPDX-License-Identifier:"), (4, "SPDX-License-Identifier: MIT OR\nGPL-2.0"), (5, "the spdx license identifier is MIT"),
            (6, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only\nMIT License")]
    got = {r.doc_id: r for r in M.scan_licenses(docs(spark, rows)).collect()}
    assert got[1].labels == "apache-2.0,mit" and got[1].score == 0.9
    assert got[2].labels == "bsd-3-clause"
    assert got[3].labels == got[4].labels == ""
    assert got[6].labels == "gpl-2.0-only,mit" and got[6].base_labels == "mit" and got[6].score == 0.3
    findings = {r.doc_id: r.findings for r in M.scan_texts(docs(spark, rows)).collect()}
    assert [(f.kind, f.phrase, f.word) for f in findings[6]] == [("tag", "mit", 0), ("tag", "gpl-2.0-only", 4), ("notice", "mit license", 11)]


def test_empty_table_repeats_and_clashing_names(spark):
    df = docs(spark, [(1, "MIT License")] * 3, CLASHING)
    assert [r.labels for r in M.scan_licenses(df).collect()] == ["mit"] * 3
    assert M.scan_licenses(df.where("false")).collect() == []


def test_many_tags_in_one_line(spark):
    text = "SPDX-License-Identifier: MIT; " * 20_000
    (row,) = M.scan_licenses(docs(spark, [(1, text)])).collect()
    assert row.labels == "mit" and row.n_words == 80_000
