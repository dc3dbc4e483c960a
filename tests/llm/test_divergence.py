import random
import re
from collections import Counter, defaultdict

import pytest

from textlm.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n string, p string, g string, digest string, terms string"


def brute(rows, min_docs, top):
    """The contract over Python counters: (lang, source, part, item, value, rank)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = {s: c for (k, s), c in groups.items() if k == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in mine.items()}, shares(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(n=400, seed=1):
    r = random.Random(seed)
    words = ["Éa", "éa", "the", "THE", "of", "x1y", "ßß", "日本", "😀", *(f"w{c}" for c in "abcdefghijklmnop")]
    rows = [(" ".join(r.choice(words[: r.randrange(1, len(words))]) for _ in range(r.randrange(0, 30))),
             r.choice(["en", "en", "de", None, ""]), r.choice(["hot", "hot", "s1", "s2", None, ""])) for _ in range(n)]
    return [*rows, (None, "en", "s1"), ("", "fr", "alone"), ("only once", "xx", "s1"), (None, "xx", "s2"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, s, *["own"] * 5) for i, (t, k, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("bits", [64, 2])  # two bits: all terms collide
@pytest.mark.parametrize("min_docs", [1, 30])
def test_against_counters(spark, bits, min_docs):
    rows = made()
    got = divergence.source_divergence(frame(spark, rows), min_docs=min_docs, top=5, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_docs, 5)


def test_some_digests_collide(spark):
    """Four bits: kept digests with one term stand beside split ones."""
    rows = made(60, seed=2)
    got = divergence.source_divergence(frame(spark, rows), min_docs=8, top=50, bits=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 8, 50)


def test_ties_at_the_last_rank(spark):
    rows = [(" ".join(f"t{c}" for c in "zyxwvutsrqponm"), "en", "a"), ("other", "en", "b")]
    got = divergence.source_divergence(frame(spark, rows), min_docs=1, top=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 1, 3)


def test_counts_beyond_bigint_products(spark):
    """Shares stay exact where SCALE times a count leaves 64 bits."""
    df = spark.createDataFrame([(10**15, 10**15 + 7, 3)], "n bigint, total bigint, terms bigint")
    got = df.select(divergence._share(df.n, df.total, df.terms)).first()[0]
    assert got == 1 + 10**9 * (10**15 + 5) // (10**15 + 7 + 15)


def test_empty_tables(spark):
    empty = frame(spark, [(None, None, None)])
    assert divergence.source_divergence(empty).count() == 0  # one group, no other source, no terms
    assert divergence.source_divergence(empty.limit(0)).count() == 0
