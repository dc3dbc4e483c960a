import hashlib
import random
import struct

import pytest
import sentencepiece
from sentencepiece import sentencepiece_pb2

from textlm.llm import pieces

SIGNS = list("ab  \n\té▁一二😀\x00́ÅﬁA<0x00>ｶﾞ①") + ["</s>", "<s>", "the "]
FIXED = ["", " ", "  a  ", "▁", "ｶﾞｷﾞ", "é", "x" * 5000, "the " * 3000]


def texts(n=400):
    r = random.Random(3)
    return FIXED + ["".join(r.choice(SIGNS) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def library_spans(model, text):
    found = sentencepiece_pb2.SentencePieceText()
    found.ParseFromString(model.encode(text, out_type="serialized_proto"))
    return [(p.id, p.begin, p.end) for p in found.pieces]


def test_spans_are_the_library_s(model):
    with open(pieces.MODEL, "rb") as f:
        code = pieces.PieceEncoder(f.read())
    for t, (ids, begins, ends) in zip(texts(), code.encode(texts()), strict=True):
        assert list(zip(ids, begins, ends, strict=True))[1:-1] == library_spans(model, t)
        assert (ids[0], ids[-1], begins[-1], ends[-1]) == (1, 2, len(t.encode()), len(t.encode()))


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("flags", [{}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": True, "escape_whitespaces": True},
                                   {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}])
def test_compiled_maps(rule, flags):
    """Longest prefixes and their source places, under the library's own maps."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    mine = pieces.Normalizer(b"".join(v for k, v in pieces.fields(library.serialized_model_proto()) if k == 3))
    for t in texts(150):
        made, where = mine(t.encode())
        want, places = library.normalize(t, with_offsets=True)
        bytes_before = [len(t[:i].encode()) for i in range(len(t) + 1)]
        leads = [i for i, b in enumerate(made) if b & 0xC0 != 0x80] + [len(made)]
        assert made.decode() == want
        assert [int(where[i]) for i in leads] == [bytes_before[i] for i in places]


def test_report(spark, make_docs, model):
    rows = [(i, t) for i, t in enumerate(texts(100))] + [(7, None), (7, None), (None, "a null id")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(model.decode(ids).encode())))
    got = [tuple(r)[:4] for r in pieces.piece_report(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_encoded_table(spark, make_docs, model):
    t = "naïve  café 😀"
    (row,) = pieces.encode_pieces(make_docs([(1, t)])).collect()
    assert row["decoded"] == t and row["ids"] == model.encode(t, add_bos=True, add_eos=True)
    data = t.encode()
    assert b"".join(data[b:e] for b, e in zip(row["begins"], row["ends"], strict=True)) == data  # spans tile the text
    assert pieces.piece_report(make_docs([(1, "x")]).limit(0)).count() == 0
