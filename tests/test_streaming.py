"""Streaming scorer: files arriving in a folder are scored like the batch path."""

import os
import tempfile

import pytest

from textlm.operators import ngram
from textlm.sources.tables import lines_of, sentences
from textlm.streaming.scoring import start_scoring


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="textlm-stream-", dir="/tmp")
    for label, name, text in [("good", "d1", "a b c\na b x\n"), ("good", "d2", "a b a\n"), ("bad", "d3", "a b c\na\n")]:
        os.makedirs(f"{root}/in/{label}", exist_ok=True)
        with open(f"{root}/in/{label}/{name}", "w") as f:
            f.write(text)
    train = sentences(lines_of(spark.createDataFrame([(0, "a b c\na b d\na b c")], "doc_id long, text string")))
    model = ngram.fit_trigram(train)
    q = start_scoring(spark, f"{root}/in", model, f"{root}/out", f"{root}/ckpt", available_now=True)
    q.awaitTermination(120)
    got = {r.files: r for r in spark.read.parquet(f"{root}/out").collect()}
    assert set(got) == {"d1", "d2", "d3"}
    assert got["d1"].ppl0 == pytest.approx(4.655303030) and got["d1"].label == "good"
    assert got["d3"].is_nan and got["d3"].label == "bad"
