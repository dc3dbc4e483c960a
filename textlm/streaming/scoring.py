"""Score documents as they land: file stream -> tokens -> trigram
scoring against the static model tables -> per-document perplexity rows.

Each new file is one document; its label is its folder (flat layout).  Every
micro-batch is scored with the batch operators inside ``foreachBatch`` (a
stream-static join on the model tables) and written to ``epoch=<batch id>``
under the output folder with overwrite, so a batch replayed after a failure
replaces its own output instead of duplicating it.  Progress lives in the
query's checkpoint location, which must be on shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlm.operators import ngram
from textlm.operators import perplexity as ppl
from textlm.sources.tables import lines_of, sentences


def document_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """``(doc_id, label, text)`` rows of files arriving under ``input_dir/<label>/``."""
    raw = (spark.readStream.format("text").option("wholetext", "true")
           .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(max_files_per_trigger))
           .schema("value string").load(input_dir))
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.element_at(parts, -1).alias("doc_id"), F.element_at(parts, -2).alias("label"),
                      F.col("value").alias("text"))


def score_batch(batch: DataFrame, model: ngram.TrigramModel, policy: str = ppl.PROPAGATE) -> DataFrame:
    """Per-document ``files, label, perpl (ppl2), ppl0, ppl1, is_nan`` of one batch of documents."""
    docs = batch.select("doc_id", "label")
    sents = sentences(lines_of(batch.select("doc_id", "text")))
    scored = ngram.score_tokens(sents, model, keep=("doc_id", "line"))
    texts = ppl.text_perplexity(docs, sents, scored, policy)
    return texts.select(F.col("doc_id").alias("files"), "label", F.col("ppl2").alias("perpl"), "ppl0", "ppl1",
                        "is_nan")


def start_scoring(spark: SparkSession, input_dir: str, model: ngram.TrigramModel, output_dir: str,
                  checkpoint_dir: str, available_now: bool = False) -> StreamingQuery:
    """Start the scoring stream; ``available_now`` processes what is there and stops."""

    def sink(batch: DataFrame, epoch: int) -> None:
        score_batch(batch, model).write.mode("overwrite").parquet(f"{output_dir.rstrip('/')}/epoch={epoch}")

    w = document_stream(spark, input_dir).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
