"""Divergence of sources within each language, by smoothed term shares; strings come late.

1. *Counts by digest.*  Each task counts the terms of its documents and writes
   them, once, as a table that is not shuffled.  What is read of it for the
   counts are digests (64 bits): fixed-width rows alone are shuffled.
2. *Kept digests.*  A term in at least ``MIN_DOCS`` documents of its language
   has a digest that is in as many, so a digest under that bound is dropped
   unseen.
3. *Collisions.*  The smallest and the largest string of each kept digest are
   looked up; where they differ, the digest stands for several terms and is
   counted anew by its strings (``split`` carries the string, null elsewhere).
4. *Shares and audit.*  All numbers are whole: shares are floors of billionths.
   Terms are spread over tasks with one entry per source, and the distances of
   a language's sources are summed per task before they are shuffled.
5. *Text.*  Values are ranked without text, ties of the last rank included;
   only those rows are joined with their strings and ranked again.

Sources are a catalogue: the groups (lang, source) are few and go to each task
behind a check of their number (beyond it Spark joins them by key).

Defined cases: null text, lang and source are empty strings; a document without
terms still makes its group; a language without kept terms has distances of 0
and no term rows; repeated rows count each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlm.llm.common import each, stored, tabled

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# the same over UTF-8 bytes: A-Z lower-cased, every byte that no term has a blank
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
MAX_GROUPS = 100_000  # groups (lang, source) that are sent to each task
MAX_DIGESTS = 1_000_000  # kept digests that are sent to each task to look up their strings
HELD = 1_000_000  # terms that a task counts before it writes them
_WIDE = "decimal(38,0)"


def _digest(term: Column, bits: int) -> Column:
    return F.xxhash64(term) if bits == 64 else F.shiftrightunsigned(F.xxhash64(term), 64 - bits)


def group_rows(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)``: nulls read as empty strings."""
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def task_counts(rows: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of terms, in one or a few rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 65_536):
                    part = terms[at:at + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                         pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size = sum(len(n) for n, _ in held.values())
            for i, text in enumerate(each(batch.column(2))):
                terms = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()
                if terms:
                    n, docs = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                    size -= len(n)
                    n.update(terms)
                    docs.update(set(terms))
                    size += len(n)
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    return rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def digest_counts(terms: DataFrame, bits: int = 64) -> DataFrame:
    """``(lang, source, digest, n, docs)``: occurrences and documents of each digest in each group."""
    return terms.select("lang", "source", _digest(F.col("term"), bits).alias("digest"), "n", "docs") \
        .groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def digest_strings(terms: DataFrame, kept: DataFrame, bits: int = 64) -> DataFrame:
    """``(digest, low, high)``: the smallest and largest string of each digest in ``kept``."""
    t = terms.select("term", _digest(F.col("term"), bits).alias("digest"))
    if kept.count() <= MAX_DIGESTS:
        kept = F.broadcast(kept)
    else:  # the join shuffles: each string once a task
        t = t.distinct()
    return t.join(kept, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))


def split_counts(terms: DataFrame, collided: DataFrame, bits: int = 64) -> DataFrame:
    """``(lang, source, digest, split, n, docs)`` of the terms whose digest collides, by their strings."""
    t = terms.withColumn("digest", _digest(F.col("term"), bits)).join(collided, "digest", "left_semi")
    return t.groupBy("lang", "source", "digest", F.col("term").alias("split")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(terms: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Occurrences of kept terms ``(lang, source, digest, split, n, total)`` and the strings ``(digest, low)``.

    ``total``: the occurrences in the whole language.
    """
    counts = stored(digest_counts(terms, bits))

    def kept(c: DataFrame, key: list[str]) -> DataFrame:
        t = c.groupBy("lang", *key).agg(F.sum("n").alias("total"), F.sum("docs").alias("all_docs"))
        return t.where(F.col("all_docs") >= min_docs).drop("all_docs")

    held = stored(kept(counts, ["digest"]))
    strings = stored(digest_strings(terms, stored(held.select("digest").distinct()), bits))
    collided = strings.where("low <> high").select("digest")
    whole = counts.join(held, ["lang", "digest"]).withColumn("split", F.lit(None).cast("string"))
    names = ["lang", "source", "digest", "split", "n", "total"]
    if not collided.isEmpty():
        parts = stored(split_counts(terms, collided, bits))
        held_parts = kept(parts, ["digest", "split"])
        whole = whole.join(collided, "digest", "left_anti").select(*names).union(
            parts.join(held_parts, ["lang", "digest", "split"]).select(*names))
    return stored(whole.select(*names)), strings.select("digest", "low")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms))``, exactly: beyond 64 bits in decimals."""
    n, total, terms = (c.cast("bigint") for c in (n, total, terms))
    narrow = total + PRIOR * terms < F.lit(9 * SCALE)  # n is at most total
    above = F.lit(SCALE).cast(_WIDE) * (n.cast("decimal(28,0)") + PRIOR)
    below = total.cast("decimal(28,0)") + PRIOR * terms.cast("decimal(18,0)")
    wide = F.call_function("div", above.cast(_WIDE), below.cast(_WIDE))
    return F.when(narrow, F.call_function("div", SCALE * (n + PRIOR), total + PRIOR * terms)).otherwise(wide) + 1


def _groups(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (lang, source): ``g`` (its number in the language), ``terms`` kept, words, and the share of an absent term."""
    langs = counts.select("lang", "digest", "split", "total").distinct().groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("total").alias("lang_words"))
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    g = rows.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(langs, "lang", "left") \
        .fillna(0, ["words", "terms", "lang_words"])
    some = F.col("terms") > 0
    return g.withColumn("absent", F.when(some, _share(F.lit(0), F.col("words"), F.col("terms")))) \
        .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances to the other sources, and the terms above the language's share.

    ``bits``: the width of a digest (fewer make collisions likelier, never other results).
    """
    rows = group_rows(docs)
    counts, strings = kept_counts(tabled(task_counts(rows)), min_docs, bits)
    groups = stored(_groups(rows, counts))
    few = groups.count() <= MAX_GROUPS
    small = F.broadcast if few else (lambda d: d)
    by_group = groups.select("lang", "source", "g", "terms", "words", "lang_words")
    c = counts.join(small(by_group), ["lang", "source"])
    c = c.withColumn("p", _share(F.col("n"), F.col("words"), F.col("terms")))

    # terms over the language's share
    q = _share(F.col("total"), F.col("lang_words"), F.col("terms"))
    over = c.withColumn("value", F.col("p") - q).where("value > 0").select("lang", "source", "digest", "split", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = over.withColumn("r", F.rank().over(best)).where(F.col("r") <= top)
    named = first.join(strings, "digest").select("lang", "source", F.coalesce("split", "low").alias("item"), "value")
    by_text = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = named.withColumn("rank", F.row_number().over(by_text)).where(F.col("rank") <= top) \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # distances between the sources of a language: per term the shares of all its sources, in the order of their numbers
    absent = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "absent"))),
                                                    lambda s: s["absent"]).alias("absent"))
    have = c.groupBy("lang", "digest", "split").agg(F.map_from_entries(F.collect_list(F.struct("g", "p"))).alias("have"))
    shares = have.join(small(absent), "lang").select("lang", F.transform(
        "absent", lambda a, i: F.coalesce(F.element_at("have", i), a)).alias("p"))
    pairs = shares.select("lang", F.posexplode("p").alias("i", "pi"), "p") \
        .select("lang", "i", F.posexplode(F.transform(F.slice("p", 1, F.col("i")), lambda x: F.abs(x - F.col("pi")))).alias("j", "f")) \
        .groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = pairs.union(pairs.select("lang", "j", "i", "value"))
    mine, other = groups.select("lang", "source", F.col("g").alias("i")), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("j"))
    every = mine.join(other, "lang").where("i <> j").join(both, ["lang", "i", "j"], "left").fillna(0, ["value"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return every.withColumn("rank", F.row_number().over(ranked)) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(terms)


ORACLE = f"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '{TERM}') as terms
  from documents),
words as (select lang, source, row, unnest(terms) as term from docs),
kept as (select lang, term, count(*) as total from words group by lang, term having count(distinct row) >= {MIN_DOCS}),
sizes as (select lang, count(*) as v, sum(total) as n from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term
           group by all),
all_counts as (
  select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) as n
  from groups g join kept k on g.lang = k.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (
  select a.lang, a.source, a.term, a.n,
    1 + ({SCALE}::hugeint * (a.n + {PRIOR})) // ((sum(a.n) over (partition by a.lang, a.source)) + {PRIOR} * s.v)::hugeint as p,
    1 + ({SCALE}::hugeint * (a.total + {PRIOR})) // (s.n + {PRIOR} * s.v)::hugeint as q
  from all_counts a join sizes s on a.lang = s.lang),
pair_values as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair_rows as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pair_values v on v.lang = a.lang and v.source = a.source and v.item = b.source),
term_rows as (
  select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank
  from (select * from pair_rows union all select * from term_rows))
select * from ranked where part = 'pair' or rank <= {TOP}
"""
