"""Reading level of each document by smoothed unigram language models per level.

One model per level is trained on the labelled documents (about MAX_LABELLED of them at most, taken
by a hash of the key, a documented bound; a document with several labels counts in parts for each).
Where a level has no labelled document, texts are seeded by a readability formula (long sentences
of long words). Every word of the training texts is in the model, which that bound keeps small
enough to be sent to the workers. A document is scored whole, sentence by sentence (a sentence of
more than PIECE words in even parts; fragments of fewer than LEAST words belong to the sentence
after them): each piece has a posterior over the levels under the models, and the document gets the
level with the highest mean, so that one harder or easier sentence does not change it.

Scale: training is one aggregation over the labelled texts; scoring is one pass without a shuffle,
in which the words of a batch are looked up and summed as arrays.

Defined cases: null, blank and wordless texts have no level (null) and no words; texts of one
word are scored as they are; repeated texts and keys each get a row; ties go to the lower level;
labels of unknown documents and null labels are ignored; with neither labels nor texts there is
no model and every level is null; other columns of the input are kept out of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufragio.llm.unigram import Unigram, sampled, softmax, words_of

LEVELS = (1, 2, 3, 4)
MAX_LABELLED, PIECE, LEAST = 50_000, 40, 3
SENTENCE = re.compile("(?<=[.!?;:])\\s+|[\\r\\n]+")
#: Mean words per sentence + 6 x mean letters per word, at which a seeded text is of level 2, 3, 4.
SEED_CUTS = (36.0, 46.0, 60.0)


def labelled(documents: DataFrame, labels: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """Training texts with the weight of each level."""
    weight = labels.filter(F.col(level).isin(*LEVELS)).groupBy(F.col(key).alias("__key")).agg(*[F.count_if(F.col(level) == g).alias(f"l{g}") for g in LEVELS])
    weight = sampled(weight, "__key", MAX_LABELLED)
    total = sum((F.col(f"l{g}") for g in LEVELS), F.lit(0))
    # the labelled keys are bounded; only texts that have one are moved
    texts = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).dropna().join(F.broadcast(weight), "__key").dropDuplicates(["__key"])
    return texts.select("__text", *[(F.col(f"l{g}") / total).alias(f"w{g}") for g in LEVELS])


def seeded(documents: DataFrame, text: str) -> DataFrame:
    """Texts with a level by formula."""
    w = words_of(F.col(text))
    n = F.greatest(F.size(w), F.lit(1))
    sentences = F.greatest(F.regexp_count(F.col(text), F.lit("[.!?;]+|[\\r\\n]+")), F.lit(1))
    score = n / sentences + 6 * F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n
    x = sampled(documents.filter(F.col(text).isNotNull()), text, MAX_LABELLED).select(F.col(text).alias("__text"), score.alias("s"))
    g = F.lit(1) + sum(((F.col("s") >= c).cast("int") for c in SEED_CUTS), F.lit(0))
    return x.select("__text", *[(g == k).cast("double").alias(f"w{k}") for k in LEVELS])


def train(texts: DataFrame) -> Unigram:
    sums = [F.sum(f"w{g}").alias(f"c{g}") for g in LEVELS]
    counts = texts.select(F.explode(words_of(F.col("__text"))).alias("word"), *[f"w{g}" for g in LEVELS]).groupBy("word").agg(*sums)
    return Unigram(counts, [f"c{g}" for g in LEVELS])


def posteriors(texts: list[str | None], model: Unigram) -> np.ndarray:
    """Mean over each text's pieces of the posterior of each level; NaN without words."""
    scores, owner, _ = model.scores(texts, lambda t: SENTENCE.sub(" | ", t), PIECE, LEAST)
    total = np.zeros((len(texts), len(LEVELS)))
    np.add.at(total, owner, softmax(scores) if len(scores) else scores)
    n = np.bincount(owner, minlength=len(texts))[:, None]
    return np.divide(total, n, out=np.full_like(total, np.nan), where=n > 0)


def assess(documents: DataFrame, labels: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """key, nivel (null without words), esperado (mean level), palavras (words by white space)."""
    texts = labelled(documents, labels, key, text, level)
    have = texts.agg(*[F.coalesce(F.sum(f"w{g}"), F.lit(0.0)).alias(f"w{g}") for g in LEVELS]).first()
    if min(have) <= 0:
        texts = texts.unionByName(seeded(documents, text))
    model = train(texts)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["t"].tolist()
            p = posteriors(texts, model) if model else np.full((len(texts), len(LEVELS)), np.nan)
            best = np.where(np.isnan(p[:, 0]), np.nan, np.argmax(np.nan_to_num(p), axis=1) + 1)
            out = pd.DataFrame({"k": pdf["k"], "nivel": best, "esperado": p @ np.array(LEVELS, dtype=float), "palavras": [len(t.split()) if t else 0 for t in texts]})
            yield out.astype({"nivel": "Int32"})

    scored = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, nivel int, esperado double, palavras int")
    return scored.withColumnRenamed("k", key)
