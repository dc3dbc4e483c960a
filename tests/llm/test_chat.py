import hashlib

from textlm.llm import chat


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_fold_edits_and_regenerations(spark):
    log = spark.createDataFrame([
        (1, 0, 10, 0, "open", "user", "helo"), (1, 0, 10, 5, "edit", None, "hello"),
        (1, 1, 11, 1, "open", "assistant", ""), (1, 1, 11, 2, "delta", None, "wro"), (1, 1, 11, 3, "delta", None, "ng"),
        (1, 1, 11, 4, "regenerate", None, None), (1, 1, 11, 6, "delta", None, "fi"), (1, 1, 11, 7, "delta", None, "ne"),
        (None, None, 12, None, "delta", None, "lost")],
        "conv_id bigint, turn bigint, msg bigint, seq bigint, kind string, role string, text string")
    got = {r.msg: (r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(log.repartition(5)).collect()}
    assert got == {10: (1, 0, "user", "hello"), 11: (1, 1, "assistant", "fine"), 12: (None, None, "", "lost")}


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l \\\\ [user]<s>", "", None, "é漢😀" * 3000, "a\nb", "x" * 400, "x" * 401]
    rows = [(c, i, role, t) for c, role in ((1, "assistant"), (2, "user"), (3, "a]b<s>\\"), (None, None))
            for i, t in enumerate(texts)]
    rows.append((4, None, "assistant", "null turn first"))
    rows.append((4, 0, "assistant", "tie"))
    rows.append((4, 0, "assistant", "tie"))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS seq", "2 AS msg")
    segments = chat.format_chats(chat.turn_events(turns))
    for r in segments.select("segment").collect():
        inner = r.segment[3:-4]
        assert r.segment.startswith("<s>[") and r.segment.endswith("</s>") and "<" not in inner
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    plain = [t or "" for t in texts]
    for c, role in ((1, "assistant"), (2, "user"), (3, "a]b<s>\\"), (None, "")):
        assert got[c].turns_sha256 == digest("".join(f"{role}\n{t}\n" for t in plain)) and got[c].n_turns == len(texts)
    assert got[1].loss_chars == sum(map(len, plain)) and got[1].loss_sha256 == digest("".join(plain))
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == digest("")
    assert got[4].loss_sha256 == digest("null turn firsttietie")


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_chats(chat.turn_events(none))).count() == 0
