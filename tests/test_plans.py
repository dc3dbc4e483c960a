"""Scale properties of the plans: row-level queries never funnel
through one partition and never evaluate a Python UDF."""

import pytest

import __spark_entry__ as E

from data_dirs import SF001

ROW_LEVEL = ["text_perplexity", "text_perplexity_skip", "sentence_perplexity", "scored_tokens", "trigram_probs",
             "vocab_counts", "tokens", "encoded_sentences", "encoded_chars", "context_pairs", "ppmi",
             "bidirectional_perplexity", "pair_scores", "char_ngrams", "conll_rows", "training_sequences"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _funnels(plan: str) -> list[str]:
    """Single-partition exchanges that carry rows, not one partial aggregate per partition."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if "HashAggregate(keys=[]" not in child:  # a keyless aggregate: one row per partition
                bad.append(line.strip() + " <- " + child.strip())
    return bad


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_single_partition_no_python(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert not _funnels(plan), _funnels(plan)
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, f"{name}: {node}"


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(E.queries()["labelled_docs"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in plan or "quality" in plan
    plan = _plan(E.queries()["vocab_counts"](spark, SF001))
    assert "n_chars" not in plan and "source" not in plan  # unused columns are pruned


def test_entry_schema_is_stable(spark):
    a = E.entry(spark).schema
    b = E.entry(spark).schema
    assert a == b and [f.name for f in a][:2] == ["doc_id", "label"]


def test_sized_broadcast_both_ways(spark):
    from textlm.sources.tables import sized_broadcast

    small = spark.range(10).withColumnRenamed("id", "doc_id")
    big = spark.range(1000).withColumnRenamed("id", "doc_id")
    left = spark.range(1000).withColumnRenamed("id", "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    hinted = _plan(left.join(sized_broadcast(small, max_rows=100), "doc_id"))
    plain = _plan(left.join(sized_broadcast(big, max_rows=100), "doc_id"))
    assert "BroadcastHashJoin" in hinted
    assert "BroadcastHashJoin" not in plain
