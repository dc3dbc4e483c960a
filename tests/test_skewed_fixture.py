"""Flagship path against a plain-Python statement of the formulas, on a skewed fixture."""

import math
import random
import re
from collections import Counter

import pytest

from textlm.operators import ngram
from textlm.operators import perplexity as ppl
from textlm.sources.tables import lines_of, sentences

PAT = re.compile(r'[\w,."-:?)(–;!]+')


def _corpus(seed, n_docs, hot_doc_lines):
    rnd = random.Random(seed)
    words = ["the", "a", "cat", "dog", "ran", "fast", "x.", "y,", "zz"]
    docs = []
    for d in range(n_docs):
        n_lines = hot_doc_lines if d == 0 else rnd.randint(1, 4)
        lines = []
        for _ in range(n_lines):
            k = rnd.choice([0, 1, 2, 3, 5, 8])
            # "the" dominates: about a third of all tokens
            lines.append(" ".join("the" if rnd.random() < 0.35 else rnd.choice(words) for _ in range(k)))
        docs.append((d, "\n".join(lines)))
    return docs


def _file_lines(text):
    """Lines as file iteration yields them: a final empty piece is no line."""
    pieces = text.split("\n")
    return pieces[:-1] if pieces and pieces[-1] == "" else pieces


def _brute(train_docs, test_docs, policy):
    train = [PAT.findall(l.strip() + " endofline") for _, t in train_docs for l in _file_lines(t)]
    vocab, tri, size = Counter(), {}, 0
    for s in train:
        vocab.update(s)
        size += len(s)
        for i in range(2, len(s)):
            tri.setdefault((s[i - 2], s[i - 1]), Counter())[s[i]] += 1
    out = {}
    for d, text in test_docs:
        vals = []
        for line in _file_lines(text):
            s = PAT.findall(line.strip() + " endofline")
            ps = []
            for i in range(2, len(s)):
                ctx = tri.get((s[i - 2], s[i - 1]))
                if ctx and s[i] in ctx:
                    ps.append(ctx[s[i]] / sum(ctx.values()))
                elif s[i] in vocab:
                    ps.append(vocab[s[i]] / size)
                else:
                    ps.append(0.99 / size)
            if ps:
                vals.append((sum(1 / p for p in ps) / len(ps), 2 ** (sum(-math.log2(p) for p in ps) / len(ps)),
                             2 ** (sum(-p * math.log2(p) for p in ps) / len(ps))))
            else:
                vals.append(None)
        if policy == "propagate":
            out[d] = None if (not vals or None in vals) else tuple(sum(v[i] for v in vals) / len(vals) for i in range(3))
        else:
            kept = [v for v in vals if v is not None]
            out[d] = tuple(sum(v[i] for v in kept) / len(kept) for i in range(3)) if kept else None
    return out


@pytest.mark.parametrize("policy", ["propagate", "skip"])
def test_text_perplexity_skewed(spark, policy):
    train = _corpus(1, 30, 300)
    test = _corpus(2, 20, 200)
    tr = sentences(lines_of(spark.createDataFrame(train, "doc_id long, text string").repartition(4)))
    te_docs = spark.createDataFrame(test, "doc_id long, text string").repartition(4)
    te = sentences(lines_of(te_docs))
    model = ngram.fit_trigram(tr)
    scored = ngram.score_tokens(te, model, keep=("doc_id", "line"))
    docs = te_docs.selectExpr("doc_id", "'x' AS label")
    got = {r.doc_id: r for r in ppl.text_perplexity(docs, te, scored, policy).collect()}
    want = _brute(train, test, policy)
    assert set(got) == set(want)
    for d, w in want.items():
        if w is None:
            assert got[d].is_nan
        else:
            assert not got[d].is_nan
            assert (got[d].ppl0, got[d].ppl1, got[d].ppl2) == pytest.approx(w, rel=1e-9)
