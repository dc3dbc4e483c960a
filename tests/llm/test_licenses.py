import re

import duckdb
import pytest

from textlm.llm import licenses


def report(df):
    return {r.doc_id: r for r in licenses.license_report(df).collect()}


def test_base_phrases_and_suppression(make_docs):
    got = report(make_docs([
        (1, "Released under the MIT License. MIT license"),
        (2, "GNU Lesser General Public License v2.1"),
        (3, "SPDX-License-Identifier: Apache-2.0"),
        (4, "mit der license und emit license"),
        (5, ""), (6, None), (None, "apache\nLICENSE"), (7, "No words about it"),
        (10, "You should have received a copy of the GNU Lesser General Public License"),
        (8, "MIT License " * 3000), (9, "Éx mit-license")]))
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (7, 2, 3, 5)
    assert got[1].base_labels == "mit" and got[1].labels == "mit"
    assert got[2].base_labels == "gpl" and got[2].labels == "gpl,lgpl-2.1"  # the plain lgpl lies inside
    assert got[3].labels == "apache-2.0" and got[3].n_base == 0 and got[3].first_word is None
    assert got[10].labels == "gpl,lgpl"
    assert got[4].n_base == 0 and got[5].n_words == 0 and got[6].n_words == 0 and got[7].labels == ""
    assert got[None].base_labels == "apache"
    assert got[8].n_base == 3000 and got[8].last_word == 5998
    assert got[9].first_word == 1 and all(0 <= r.score <= 1 for r in got.values())


def test_every_keyword_holds_a_stem_and_rules_are_many():
    assert len(licenses.RULES) > 200
    assert all(any(s in r["keyword"] for s in licenses.STEMS) for r in licenses.RULES)


def longest_text(rule: str) -> str:
    """A text that the rule matches with every optional part there and every gap at its highest count."""
    text = rule.replace(r"\S+", "zz").replace(r"\d+", "7")
    text = re.sub(r"\[(\d)[^]]*\]", r"\1", text)
    while (m := re.search(r"\(\?:([^()]*)\)(\{\d+,(\d+)\})?\??", text)):
        part = max(m.group(1).split("|"), key=lambda x: (len(x.split()), len(x)))
        text = text[:m.start()] + part * int(m.group(3) or 1) + text[m.end():]
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(r"([a-z0-9 ])\?", r"\1", text))


def test_every_rule_is_found_at_its_longest_text(spark, make_docs):
    texts = [line.split("|", 2)[2].strip()
             for line in (licenses.BASE_RULES + licenses.MORE_RULES).splitlines() if "|" in line]
    texts = [longest_text(t) for t in texts]
    assert len(texts) == len(licenses.RULES)
    assert all(re.fullmatch(r"[a-z0-9 ]+", t) for t in texts)
    assert any(t.count("zz") == 40 for t in texts) and any(t.count("zz") == 30 for t in texts)
    docs = make_docs([(i, f"xx yy {t} xx yy") for i, t in enumerate(texts)])
    for r in licenses.scan_licenses(docs).collect():
        found = {(d.start, d.end) for d in r.detections}
        named = any(d.priority > licenses.MENTION for d in r.detections) and licenses.RULES[r.doc_id]["priority"] <= licenses.MENTION
        assert named or (2, 2 + len(texts[r.doc_id].split())) in found, (texts[r.doc_id], r.detections)


def test_long_names_inside_a_rule(make_docs):
    name = "the board of trustees of the leland stanford junior university"
    got = report(make_docs([
        (1, f"Neither the name of {name} nor the names of its contributors may be used to endorse"),
        (2, f"Copyright 2001, 2002 {name} and the regents of the university of california. All rights reserved.")]))
    assert got[1].labels == "bsd-3" and got[2].labels == "proprietary"


def test_optional_words_before_a_keyword(make_docs):
    got = report(make_docs([
        (1, "apache license 1 1"), (2, "the apache software license version 1 1"), (3, "two clause BSD"),
        (4, "see the license for details"), (5, "distributed under an entirely new kind license"),
        (6, "Unlicense"), (7, "this is the unlicense"), (8, "released under the zlib license")]))
    assert [got[i].labels for i in range(1, 9)] == [
        "apache,apache-1.1", "apache-1.1", "bsd-2", "reference", "reference", "unlicense", "unlicense", "zlib"]


def test_a_gap_without_a_bound_in_words_is_refused():
    for rule in ("x | 70 | {license} .{1,9}?z", "x | 70 | {license} (?:a )+z", "x | 70 | a(?:b )*{license}"):
        with pytest.raises(ValueError):
            licenses.parse_rules("", rule)


def test_empty_table_and_sql(spark, make_docs):
    assert licenses.license_report(make_docs([])).count() == 0
    rows = [(1, "under the Apache License, Version 2.0 or GPLv3 or later. All rights reserved"), (1, "see LICENSE file"),
            (2, "licensed under the MIT"), (3, None), (4, "Copyright 2020 x y all rights reserved gnu gpl v2"),
            (5, "Neither the name of " + "a long name " * 12 + "nor the names of its contributors may be used to endorse"),
            (6, "copyright " + "a b c " * 10 + "all rights reserved"), (7, "copyright " + "a b c " * 11 + "all rights reserved")]
    df = make_docs(rows, extra=False)
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  (read by DuckDB)
    sql = sorted(map(repr, con.execute(licenses.oracle()).fetchall()))
    assert sql == sorted(repr(tuple(r)) for r in licenses.license_report(df).collect())
