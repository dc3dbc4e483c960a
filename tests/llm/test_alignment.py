import hashlib
import json
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from textlm.llm import alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ODD = [None, "", " ", "  ", "a", "plain words", "two  blanks", "a\n\n  b", "tail  ", "\tx", "one▁sign", "<|endoftext|> and </s><s>",
       "\x00 zero", "naïve café 一二三 😀", "ﬁ ÅÅ", "a b　c  d", "x" * 300, "\r\n a", "\x1c  b", "don't we'll 'tis"]


def brute(texts):
    """Per text the contract's columns, pair by pair over the tokens of the libraries."""
    with open(alignment.VOCABULARY_A, encoding="utf-8") as f:
        letters, vocabulary = alignment.byte_letters(), json.load(f)["model"]["vocab"]
    of_a = {i: bytes(letters[c] for c in w) for w, i in vocabulary.items() if w != "<|endoftext|>"}
    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    links, groups = [], []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(of_a[i] for i in ids_a) != whole or b"".join(map(of_b, ids_b)) != whole:
            ids_a = ids_b = []
        mine, parts, i, j, end_a, end_b, begin = [], [], 0, 0, 0, 0, (0, 0)
        for i in range(len(ids_a)):
            start_a, end_a = end_a, end_a + len(of_a[ids_a[i]])
            at = 0
            for j, token in enumerate(ids_b):
                start_b, at = at, at + len(of_b(token))
                if start_b < end_a and start_a < at:
                    mine.append((ids_a[i], token))
                if at == end_a:
                    parts.append(",".join(map(str, ids_a[begin[0]:i + 1])) + "|" + ",".join(map(str, ids_b[begin[1]:j + 1])))
                    begin = (i + 1, j + 1)
        links.append((len(ids_a), len(ids_b), mine))
        groups.append(parts)
    count = Counter(p for *_, mine in links for p in mine)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(parts), len(mine), sum(count[p] == top[p[1]] for p in mine), sum(count[p] for p in mine),
             hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
            for (n_a, n_b, mine), parts in zip(links, groups, strict=True)], count, top


def test_against_every_pair_of_tokens(spark, make_docs, monkeypatch):
    r = random.Random(5)
    signs = list("abé \n\t一😀'1.") + ["the ", "  ", " un", "ing", "<s>", "▁"]
    texts = ODD + ["".join(r.choice(signs[:-1 if i % 5 else None]) for _ in range(r.randrange(1, 60))) for i in range(120)]
    texts += texts[:40]  # repeated rows
    want, count, top = brute(texts)
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    for block_bytes in (alignment.BLOCK_BYTES, 300):  # one block, and many
        found, pairs = alignment.align(docs, block_bytes=block_bytes, digest=True)
        got = {x["doc_id"]: (*(x[c] for c in COLUMNS), x["groups"]) for x in found.collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert {(x["a"], x["b"]): (x["count"], x["best"]) for x in pairs.collect()} == \
        {p: (n, int(n == top[p[1]])) for p, n in count.items()}


def test_small_buffers_and_flushes_change_nothing(monkeypatch):
    with open(alignment.VOCABULARY_A, "rb") as a, open(alignment.MODEL_B, "rb") as b:
        coders = alignment.Coders(a.read(), b.read())
    texts = ["some words here", "some  more words\nhere", None, "here▁not"]
    assert coders.cut is not None
    cut = alignment.Aligned(coders, texts)
    coders.cut = None  # whole texts give the same groups
    assert alignment.Aligned(coders, texts).groups() == cut.groups()
    assert cut.whole.tolist() == [True, True, True, False]
    groups = cut.groups()
    assert groups[2] == groups[3] == "" and groups[0].count("|") == groups[0].count(";") + 1


def test_groups_are_given_as_text_too(spark, make_docs):
    found, _ = alignment.align(make_docs([(1, "one word"), (None, None)]))
    rows = {x["doc_id"]: x for x in found.collect()}
    assert "|" in rows[1]["groups"] and rows[None]["groups"] == "" and rows[None]["n_links"] == 0


def test_empty_table(spark, make_docs):
    assert alignment.alignment_report(make_docs([(1, "x")]).limit(0)).count() == 0
