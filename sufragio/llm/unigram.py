"""Smoothed unigram models of several classes, and their fast scoring of batches of texts."""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufragio.functions.text import ACCENTED, PLAIN

SMOOTHING = 0.1
#: Words scored at once.
CHUNK = 400_000
#: Folding of Latin-1 as bytes, many times faster than of text; any other character is no letter.
FOLD = bytes.maketrans((ACCENTED + "#|").encode("latin-1"), (PLAIN + "  ").encode("latin-1"))
codecs.register_error("no letter", lambda e: ("\x7f" * (e.end - e.start), e.end))
DIGITS = re.compile("[0-9]+")
TOKEN = re.compile("[a-z]+|[#|]")


def folded(text: str) -> str:
    """Small letters without accents; any number is '#'."""
    return DIGITS.sub("#", text.lower().encode("latin-1", "no letter").translate(FOLD).decode("latin-1"))


def words(text: str) -> list[str]:
    return TOKEN.findall(folded(text))


def words_of(text: Column) -> Column:
    """words() as a column."""
    found = F.regexp_extract_all(F.lower(F.translate(text, ACCENTED, PLAIN)), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    return F.transform(found, lambda w: F.when(w < "a", "#").otherwise(w))


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows of df by a hash of the key, all of them if they are fewer: a filter in
    place, so that no task gathers the sample."""
    share = bound / max(1, df.count())
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000_007)) < int(share * 1_000_000_007))


class Unigram:
    """Log-probabilities of words by class; the last row is that of a word never seen."""

    def __init__(self, counts: DataFrame, columns: Sequence[str]):
        """counts: word and its count in each class: as many rows as a bounded sample has words."""
        table = counts.select("word", *columns).toArrow()
        of = np.column_stack([table[c].to_numpy().astype(float) for c in columns]) if table.num_rows else np.zeros((0, len(columns)))
        self.index = {w: i for i, w in enumerate(table["word"].to_pylist())}
        self.seen = of.sum(axis=0) > 0
        total = of.sum(axis=0) + SMOOTHING * (len(of) + 1)
        self.table = np.log((np.vstack([of, np.zeros(len(columns))]) + SMOOTHING) / total)

    def __bool__(self) -> bool:
        return bool(self.index)

    def scores(self, texts: Sequence[str | None], cut: Callable[[str], str] = lambda t: t, piece: int = 0, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log-probabilities of each piece, the text it belongs to, and its words. cut puts
        '|' between sentences; one of more than `piece` words is divided evenly, one of fewer than
        `least` words is joined to the next (at the end, to the one before)."""
        get, unseen = (self.index | {"|": -1}).get, len(self.index)
        found, owner, size, chunk, starts, held = [], [], [], [], [], 0

        def flush() -> None:
            nonlocal chunk, starts, held
            if starts:
                found.append(np.add.reduceat(self.table[np.concatenate(chunk)], starts, axis=0))
            chunk, starts, held = [], [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            at = np.array([get(w, unseen) for w in TOKEN.findall(cut(folded(text)))], dtype=np.int64)
            breaks = np.flatnonzero(at < 0)
            lengths = (np.diff(np.r_[-1, breaks, len(at)]) - 1).tolist()
            at = at[at >= 0]
            if not len(at):
                continue
            joined, waiting = [], 0
            for n in lengths:
                waiting += n
                if waiting >= least:
                    joined.append(waiting)
                    waiting = 0
            if waiting:
                joined = [*joined[:-1], joined[-1] + waiting] if joined else [waiting]
            for n in joined:
                parts = max(1, math.ceil(n / piece)) if piece else 1
                for i in range(parts):
                    starts.append(held)
                    m = (i + 1) * n // parts - i * n // parts
                    held += m
                    owner.append(k)
                    size.append(m)
            chunk.append(at)
            if held > CHUNK:
                flush()
        flush()
        empty = np.zeros((0, self.table.shape[1]))
        return (np.concatenate(found) if found else empty), np.array(owner, dtype=np.int64), np.array(size, dtype=np.int64)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
