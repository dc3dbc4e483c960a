"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a written and of a learned lexicon, second
person near such words, capitals, punctuation and obfuscation.  The learned
lexicon holds words and word beginnings that toxic training texts have and
others do not; it is cross-fitted: the features of a training text come from
the lexicon of the other folds, those of all other texts from the whole one.
Trees are fitted on three of the folds, the isotonic curve on the last.

Learned from a sample of about ``TRAIN_ROWS`` labelled rows, taken by a hash of
doc_id; labels, lang, source and doc_id are never inputs of a score.  Scoring
happens where the documents lie: no shuffle, no key.

Defined cases: null and empty texts have all features 0 and a score; a null
doc_id is not held out; null labels are none; of repeated labels the largest
holds; equal texts get equal scores.  Without both kinds of labels every score
is the share of toxic ones (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import WORD_TABLE, each, fresh, stored

TRAIN_ROWS = 20_000
LEXICON_SIZE = 500  # learned entries
FOLDS = 4
TREES, DEPTH = 30, 4
NEAR = 5  # words between a second person and a lexicon word

# Insults, and forms of the second person.
INSULTS = """
idiot idiots moron morons stupid dumb scum loser losers pathetic worthless disgusting trash clown clowns garbage
imbecile cretin fool fools jerk bastard bitch shit fuck fucking asshole dickhead retard retarded ugly filthy vermin
idiota estupido imbecil basura asqueroso idiote imbecile stupide ordure connard salaud dummkopf trottel arschloch
abschaum widerlich wertlos
""".split()
SECOND = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te ton ta tes vous votre usted ustedes vosotros".split()
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
# begins only where a run of letters begins and never backs up: linear in the text
_OBSCURED = re.compile(rb"(?<![a-z])[a-z]++[0-9@$*!.\-]++[a-z]++[a-z0-9@$*!.\-]*+")
_REPEATED = re.compile(r"[!?]{2,}")
_LETTERS3 = re.compile(r"([^\W\d_])\1\1")
N_FEATURES = 16


def entries(word: bytes) -> list[bytes]:
    """What the learned lexicon may hold of a word: the word, and its beginnings of 3 to 6 characters."""
    out, chars = [word + b"$"], 0
    for i, b in enumerate(word):
        if b & 0xC0 != 0x80:
            if 3 <= chars <= 6:
                out.append(word[:i])
            chars += 1
    if 3 <= chars <= 6:
        out.append(word)
    return out


def _lower_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class _Weights(dict):
    """Lexicon weight of a word (0: none), kept for the words met; thrown away when it grows large."""

    def __init__(self, learned: dict[bytes, float]):
        super().__init__()
        self.learned = learned

    def __missing__(self, word: bytes) -> float:
        if len(self) > 150_000:
            self.clear()
        w = self[word] = max((self.learned.get(e, 0.0) for e in entries(word)), default=0.0)
        return w


def text_features(text: str | None, weights: _Weights, insults: frozenset, second: frozenset) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = _lower_words(text)
    n, chars = max(len(words), 1), len(text)
    bad = [i for i, w in enumerate(words) if w in insults]
    ws = [weights[w] for w in words]
    learned = [i for i, w in enumerate(ws) if w]
    total = sum(ws)
    you = np.fromiter((i for i, w in enumerate(words) if w in second), np.int64)
    either = sorted({*bad, *learned})
    near = 0
    if len(you) and either:
        e = np.asarray(either)
        at = np.searchsorted(you, e)
        right = np.abs(you[np.minimum(at, len(you) - 1)] - e)
        left = np.abs(e - you[np.maximum(at - 1, 0)])
        near = int((np.minimum(left, right) <= NEAR).sum())
    low = text.lower().encode("utf-8", "surrogatepass")
    obscured = _OBSCURED.findall(low)
    plain = sum(m.translate(_LEET, b"*!.-") in insults for m in obscured)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = text.count("!") + text.count("?")
    return [float(len(bad)), 100.0 * len(bad) / n, float(len(learned)), 100.0 * len(learned) / n, total,
            100.0 * total / n, max(ws, default=0.0), float(len({words[i] for i in learned})),
            float(near), 100.0 * near / n, upper / chars, marks / n, len(_REPEATED.findall(text)) / n,
            (len(obscured) + len(_LETTERS3.findall(text))) / n, float(plain), math.log1p(len(words))]


def with_features(docs: DataFrame, text: str, out: str, lexicons: list[dict[bytes, float]], fold: str | None = None,
                  keep_text: bool = True) -> DataFrame:
    """``docs`` with an array column ``out``; ``fold`` names the lexicon of each row (the last one without it)."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [_Weights(x) for x in sent.value]
        insults, second = frozenset(w.encode() for w in INSULTS), frozenset(w.encode() for w in SECOND)
        for batch in batches:
            which = batch.column(fold).to_pylist() if fold else [-1] * len(batch)
            rows = [text_features(t, weights[k], insults, second)
                    for t, k in zip(each(batch.column(text)), which, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, pa.list_(pa.float64()))],
                                             names=[*kept, out])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{out}` array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """``(text, label, fold)`` of a bounded sample of the labelled rows that are not held out."""
    marked = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL") \
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label"))
    n = marked.count()
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    marked = marked.where(draw < int(min(1.0, train_rows / max(n, 1)) * (1 << 30)))
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # train_rows rows, about
    # equal texts count once; a row's fold hangs on its text
    found = found.groupBy(F.xxhash64("text").alias("key")).agg(
        F.first("text").alias("text"), F.max("label").alias("label"))
    return found.withColumn("fold", F.pmod(F.xxhash64(F.lit(13), "key"), F.lit(FOLDS)).cast("int"))


def learn_lexicons(train: DataFrame, size: int = LEXICON_SIZE) -> list[dict[bytes, float]]:
    """Log-odds of entries in toxic texts: a lexicon without each fold, then one of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32()),
                 pa.array([k[2] for k in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())],
                names=["entry", "fold", "label", "n"])

        for batch in batches:
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                seen.update((e, fold, label) for e in {e for w in set(_lower_words(text or "")) for e in entries(w)})
                if len(seen) > 300_000:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    counted = train.select("text", "label", "fold").mapInArrow(run, "entry binary, fold int, label double, n bigint")
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{y}_{f}")
            for f in range(FOLDS) for y in (0, 1)]
    table = stored(counted.groupBy("entry").agg(*sums).where(
        " + ".join(f"n1_{f}" for f in range(FOLDS)) + " >= 3"))
    sizes = {(r["fold"], int(r["label"])): r["count"] for r in train.groupBy("fold", "label").count().collect()}
    out = []
    for without in [*range(FOLDS), None]:
        used = [f for f in range(FOLDS) if f != without]
        n1, n0 = (sum(sizes.get((f, y), 0) for f in used) for y in (1, 0))
        a, b = (sum((F.col(f"n{y}_{f}") for f in used), F.lit(0)) for y in (1, 0))
        odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
        best = table.select("entry", a.alias("a"), odds.alias("w")).where("a >= 3 AND w >= 2.5") \
            .orderBy(F.desc(F.col("a") * F.col("w")), "entry").limit(size).collect()
        out.append({bytes(r["entry"]): round(r["w"], 6) for r in best})
    return out


class ToxicityModel:
    """Lexicons, trees and calibration; ``score`` adds a column to any frame with texts."""

    def __init__(self, lexicons, trees, curve, prior):
        self.lexicons, self.trees, self.curve, self.prior = lexicons, trees, curve, prior

    def score(self, docs: DataFrame, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
        if self.trees is None:
            d = docs.withColumn(out, F.lit(self.prior))
            return d if keep_text else d.drop(text)
        (array,) = fresh(docs, "features")
        d = with_features(docs, text, array, self.lexicons, keep_text=keep_text)
        names = fresh(d, "vector", "raw", "odds", "said", "curve")
        d = d.withColumn(names[0], array_to_vector(array))
        raw, odds, said = names[1:4]
        model = self.trees.copy({self.trees.featuresCol: names[0], self.trees.rawPredictionCol: raw,
                                 self.trees.probabilityCol: odds, self.trees.predictionCol: said})
        d = model.transform(d).withColumn(odds, vector_to_array(odds)[1])
        p = F.col(odds)
        if self.curve is not None:
            curve = self.curve.copy({self.curve.featuresCol: odds, self.curve.predictionCol: names[4]})
            # the trees' own order is kept among the texts that the curve makes equal
            d, p = curve.transform(d), 0.99 * F.col(names[4]) + 0.01 * F.col(odds)
        return d.withColumn(out, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).drop(array, *names)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7) -> ToxicityModel:
    train = stored(training_rows(docs, labels, train_rows))
    kinds: Counter = Counter()
    for r in train.groupBy("fold", "label").count().collect():
        kinds[r["fold"] == FOLDS - 1, int(r["label"])] += r["count"]
    n = {y: kinds[True, y] + kinds[False, y] for y in (0, 1)}
    if not n[0] or not n[1]:
        return ToxicityModel([], None, None, float(n[1]) / max(n[0] + n[1], 1))
    lexicons = learn_lexicons(train)
    rows = stored(with_features(train, "text", "f", lexicons, fold="fold", keep_text=False)
                  .select(array_to_vector("f").alias("features"), "label", "fold").coalesce(8))
    both = all(kinds[last, y] for last in (True, False) for y in (0, 1))
    fit = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed)
    trees = fit.fit(rows.where(F.col("fold") < FOLDS - 1) if both else rows)
    curve = None
    if both:
        rest = trees.transform(rows.where(F.col("fold") == FOLDS - 1)).select(
            vector_to_array("probability")[1].alias("p"), "label")
        curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(rest)
    return ToxicityModel(lexicons, trees, curve, None)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    model = fit_toxicity(docs, labels)
    scored = model.score(docs.select("doc_id", "text"), keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
