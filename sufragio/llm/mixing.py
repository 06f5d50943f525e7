"""Mix sources to target weights of the total size.

One pass over the texts gives every document its tokens and its soft membership of the listed
sources: unigram models per source, trained on the documents that name theirs (about MAX_LABELLED
at most, by hash), score its words; a temperature, fitted on other such documents, makes the scores
a calibrated posterior; a named source counts as evidence of reliability TRUST. Documents then get
nonnegative rates of at most their source's number of repetitions by projected-gradient least
squares: the expected tokens per source, the sum of rate x tokens x membership, are brought to the
targets. The gradient lies in the space of one multiplier per source, so it is gathered there,
scaled by the curvature of the documents not at a bound, and projected anew for each document,
rate = clip(membership . multipliers, 0, cap): every step is one job whose only result is a handful
of sums, and no rate is ever stored. As shares are reported by the named source, the targets are
then corrected by what the named totals still lack, and fitted again. Rates become whole repetitions by systematic rounding: within
a source the fractions are summed up over the documents ordered by size, and each unit that is
reached takes one document, so that a source misses its tokens by no more than its largest size.
That rest is repaired by a few single documents, at most one taken and one given of each size class.

The budget is, unless given, the most at which every present source can have its whole share
within its repetitions; the scarcest source sets it, and the report names it. With a larger budget
such sources are used up, and what they lack is shared out among the others by weight.

Defined cases: a listed source without documents reports share 0 and its weight is shared out
among the others; documents of sources that are not listed, and those without tokens, are left
out; null, blank and repeated texts keep their own row; ties of size are ordered by a hash of the
key; with no listed source present, or an empty table, nothing is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufragio.functions.text import fold
from sufragio.llm.tokens import counted, counter, tokenizer_path
from sufragio.llm.unigram import Unigram, sampled, softmax, words_of
from sufragio.session import materialize, measured

MAX_LABELLED, MAX_HELD_OUT, TRUST = 50_000, 5_000, 0.999
TOLERANCE, STEPS, SLICES = 1e-4, 100, 64
#: Times that the targets are corrected for what memberships and named sources differ by, at most, and the difference left alone.
CORRECTIONS, CLOSE = 4, 0.005
TEMPERATURES = tuple(2.0**k for k in range(9))


def source_name(c: Column) -> Column:
    """Lower case, without accents and outer blanks, '_' between words; blank as null."""
    return F.nullif(F.regexp_replace(F.lower(fold(c)), "[\\s\\-]+", "_"), F.lit(""))


def _train(named: DataFrame, key: str, text: str, sources: list[str]) -> tuple[Unigram, float]:
    """Model of the words of each source, and the temperature at which its scores predict the
    sources of documents that it was not trained on best."""
    known = named.filter(F.col("__source").isin(*sources) & F.col(text).isNotNull()).select(key, text, "__source")
    part = F.pmod(F.xxhash64(F.lit("held out"), key), F.lit(5)) == 0
    word = sampled(known.filter(~part), key, MAX_LABELLED).select("__source", F.explode(words_of(F.col(text))).alias("word"))
    counts = [F.count_if(F.col("__source") == s).alias(f"c{i}") for i, s in enumerate(sources)]
    model = Unigram(word.groupBy("word").agg(*counts), [f"c{i}" for i in range(len(sources))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss = np.zeros(len(TEMPERATURES))
        for pdf in batches:
            scores, owner, size = model.scores(pdf["t"].tolist())
            if len(owner):
                of = np.array([sources.index(s) for s in pdf["s"]])[owner]
                for i, t in enumerate(TEMPERATURES):
                    loss[i] -= np.log(softmax(_seen(scores, model) / t)[np.arange(len(of)), of] + 1e-12).sum()
        yield pd.DataFrame({"i": range(len(loss)), "loss": loss})

    held = sampled(known.filter(part), key, MAX_HELD_OUT).select(F.col(text).alias("t"), F.col("__source").alias("s"))
    losses = {r["i"]: r["l"] for r in held.mapInPandas(run, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("l")).collect()}
    return model, TEMPERATURES[min(losses, key=lambda i: (losses[i], i))] if losses else 1.0


def _seen(scores: np.ndarray, model: Unigram) -> np.ndarray:
    """Nothing is like a source that was never seen."""
    return np.where(model.seen, scores, -1e9) if model.seen.any() else scores


def membership(documents: DataFrame, key: str, text: str, source: str, sources: list[str], tokenizer: str | None = None) -> DataFrame:
    """key, fonte (named, else the likeliest), tokens, p: posterior over sources, for the documents
    with tokens that are of a listed source or of none."""
    named = documents.withColumn("__source", source_name(F.col(source)))
    model, temperature = _train(named, key, text, sources)
    path, kind, n = tokenizer or tokenizer_path(), documents.schema[key].dataType.simpleString(), len(sources)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in batches:
            scores, owner, _ = model.scores(pdf["t"].tolist())
            log = np.zeros((len(pdf), n))
            log[owner] = scores
            p = softmax(_seen(log, model) / temperature)
            at = pdf["s"].map({s: i for i, s in enumerate(sources)})
            told = at.notna().to_numpy()
            said = np.full((int(told.sum()), n), (1 - TRUST) / max(1, n - 1))
            said[np.arange(len(said)), at[told].astype(int)] = TRUST if n > 1 else 1.0
            p[told] = p[told] * said + 1e-12 * said
            p /= p.sum(axis=1, keepdims=True)
            best = at.where(told, pd.Series(p.argmax(axis=1), index=pdf.index)).astype(int)
            yield pd.DataFrame({"k": pdf["k"], "fonte": best.map(dict(enumerate(sources))), "tokens": counted(pdf["t"], count), "p": list(p)})

    wanted = named.filter(F.col("__source").isNull() | F.col("__source").isin(*sources)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("__source").alias("s"))
    return wanted.mapInPandas(run, f"k {kind}, fonte string, tokens bigint, p array<double>").filter("tokens > 0").withColumnRenamed("k", key)


def shared_out(have: list[float], weights: list[float], budget: float | None) -> list[float]:
    """Target tokens of each source: weight x budget, at most what it has; what it lacks goes to the
    others by weight. Without a budget the largest at which nothing is lacking."""
    present = [i for i, h in enumerate(have) if h > 0 and weights[i] > 0]
    whole = sum(weights[i] for i in present)
    if not present:
        return [0.0] * len(have)
    if budget is None:
        budget = min(have[i] * whole / weights[i] for i in present)
    out, left, open_ = [0.0] * len(have), min(budget, sum(have[i] for i in present)), present
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * each >= have[i]]
        for i in full or open_:
            out[i] = have[i] if full else weights[i] * each
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def multipliers(base: DataFrame, cap: Column, targets: list[float], start: list[float] | None = None) -> tuple[list[float], int, float]:
    """Multipliers of the fitted rates, the steps taken, and the largest miss as a share of the whole."""
    k, total = len(targets), sum(targets)
    lam, best = np.array(start or [0.0] * k), (math.inf, np.zeros(k), 0)
    most = 10.0 * max(1.0, base.agg(F.max(cap)).first()[0] or 1.0)
    damp = 1.0
    for step in range(1, STEPS + 1):
        raw = _rate(lam)
        free = ((raw >= 0) & (raw < cap)).cast("double") * F.col("tokens")
        x = base.select("tokens", "p", F.least(cap, F.greatest(F.lit(0.0), raw)).alias("r"), free.alias("f"))
        sums = [F.sum(F.col("tokens") * F.col("r") * F.col("p")[i]).alias(f"t{i}") for i in range(k)]
        sums += [F.sum(F.col("f") * F.col("p")[i] * F.col("p")[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        got = x.agg(*sums).first()
        miss = np.array([t - (got[f"t{i}"] or 0.0) for i, t in enumerate(targets)])
        worst = np.abs(miss).max() / total
        if worst < best[0]:
            best = (worst, lam, step)
        else:
            damp = max(0.1, damp / 2)
        if worst <= TOLERANCE or step - best[2] >= 3:
            break
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        lam = np.clip(lam + damp * np.linalg.solve(h + np.eye(k) * max(1e-9, 1e-6 * np.trace(h)), miss), -most, most)
    return best[1].tolist(), step, float(best[0])


def _rate(lam) -> Column:
    return reduce(add, [F.col("p")[i] * F.lit(float(x)) for i, x in enumerate(lam)])


def _size_class(size: Column) -> Column:
    """One class per size below 64, eight per octave beyond: a few hundred for any size."""
    return F.when(size < 64, size).otherwise(64 + F.floor(8 * F.log2(size / 64))).cast("int")


def rounded(rates: DataFrame, key: str, group: str = "fonte", size: str = "tokens", rate: str = "rate") -> DataFrame:
    """rates with repeticoes: whole numbers whose size-weighted sum per group keeps that of the
    rates to within the largest size. Groups are cut by size (at most a few hundred slices) and
    hash, the slices' sums are summed up first, so no task holds a group."""
    x = rates.withColumn("__part", _size_class(F.col(size))).withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")).withColumn("__f", F.col(rate) - F.floor(rate))
    cut = [group, "__part", "__slice"]
    sums = x.groupBy(*cut).agg(F.sum("__f").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(group).orderBy("__part", "__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums, _ = measured(materialize(sums.select(*cut, before.alias("__before")), "slices"))
    upto = F.sum("__f").over(Window.partitionBy(*cut).orderBy(size, F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__upto", upto).join(sums, cut).withColumn("__end", F.col("__before") + F.col("__upto") + 0.5)
    one = (F.floor("__end") > F.floor(F.col("__end") - F.col("__f"))).cast("bigint")
    return x.withColumn("repeticoes", (F.floor(rate) + one).cast("int")).drop("__part", "__slice", "__f", "__upto", "__before", "__end")


def repairs(miss: float, given: list[tuple], spare: list[tuple]) -> list[tuple]:
    """(key, +1 or -1) of the documents to take (out of spare) and to give back (out of given) that
    bring the missing tokens nearest to zero, by the best single move or exchange again and again.
    given, spare: (tokens, key)."""
    out = []
    while True:
        moves = [(abs(miss), None, None)]
        moves += [(abs(miss - t), (t, k), None) for t, k in spare] + [(abs(miss + t), None, (t, k)) for t, k in given]
        if spare and given:
            a, b = np.array([float(t) for t, _ in spare]), np.array([float(t) for t, _ in given])
            i, j = np.unravel_index(np.abs(miss - a[:, None] + b[None, :]).argmin(), (len(a), len(b)))
            moves.append((abs(miss - a[i] + b[j]), spare[i], given[j]))
        _, more, less = min(moves, key=lambda m: m[0])
        if more is None and less is None:
            return out
        for x, sign, table in ((more, 1, spare), (less, -1, given)):
            if x is not None:
                miss -= sign * x[0]
                out.append((x[1], sign))
                table.remove(x)
        given, spare = [g for g in given if more is None or g[1] != more[1]], [x for x in spare if less is None or x[1] != less[1]]


def repaired(whole: DataFrame, key: str, goal: dict[str, float]) -> DataFrame:
    """whole (key, fonte, tokens, repeticoes, cap) with the repetitions of a few documents changed
    by one. What reaches the driver is two documents per source and size class."""
    own = {r["fonte"]: r["t"] for r in whole.groupBy("fonte").agg(F.sum(F.col("tokens") * F.col("repeticoes")).alias("t")).collect()}
    one = F.struct(F.xxhash64(key).alias("h"), "tokens", F.col(key).alias("k"))
    classes = whole.groupBy("fonte", _size_class(F.col("tokens")).alias("c")).agg(F.min(F.when(F.col("repeticoes") > 0, one)).alias("given"), F.min(F.when(F.col("repeticoes") < F.col("cap"), one)).alias("spare")).collect()
    changes = []
    for s, g in goal.items():
        given = [(r["given"]["tokens"], r["given"]["k"]) for r in classes if r["fonte"] == s and r["given"]]
        spare = [(r["spare"]["tokens"], r["spare"]["k"]) for r in classes if r["fonte"] == s and r["spare"]]
        changes += repairs(g - float(own.get(s, 0)), given, spare)
    kind = whole.schema[key].dataType.simpleString()
    few = whole.sparkSession.createDataFrame(changes, f"{key} {kind}, __change int").groupBy(key).agg(F.sum("__change").cast("int").alias("__change"))
    return whole.join(F.broadcast(few), key, "left").withColumn("repeticoes", F.col("repeticoes") + F.coalesce("__change", F.lit(0))).drop("__change")


def mix(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, target_source: str = "source", weight: str = "peso", repeats: str = "max_repeticoes", budget: float | str | None = None, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen: key, fonte, tokens, repeticoes; report: fonte, alvo, meta (share asked of it within
    the budget), parte (share it has), tokens, documentos, disponivel (tokens within its
    repetitions), limitante (sets the budget or is used up), passos and erro (of the fit)). A budget
    of "all" is as many tokens as the documents have once.
    targets has one row per source and is small by nature."""
    wanted = targets.select(source_name(F.col(target_source)).alias("s"), F.col(weight).alias("w"), F.col(repeats).alias("r")).dropna().orderBy("s").collect()
    names, weights, caps = [r["s"] for r in wanted], [float(r["w"]) for r in wanted], [float(r["r"]) for r in wanted]
    base = materialize(membership(documents, key, text, source, names, tokenizer), "members")
    cap = F.coalesce(*[F.when(F.col("fonte") == s, F.lit(c)) for s, c in zip(names, caps)], F.lit(0.0))
    own = {r["fonte"]: r["t"] for r in base.groupBy("fonte").agg(F.sum(F.col("tokens") * cap).alias("t")).collect()}
    have = [float(own.get(s, 0.0)) for s in names]
    if budget == "all":
        budget = float(base.agg(F.sum("tokens")).first()[0] or 0) or None
    goal = shared_out(have, weights, budget)
    lam, steps, miss = multipliers(base, cap, goal) if sum(goal) > 0 else ([0.0] * len(names), 0, 0.0)
    asked = goal
    for _ in range(CORRECTIONS if sum(goal) > 0 else 0):
        rate = F.least(cap, F.greatest(F.lit(0.0), _rate(lam)))
        now = {r["fonte"]: r["t"] for r in base.groupBy("fonte").agg(F.sum(F.col("tokens") * rate).alias("t")).collect()}
        off = [g - float(now.get(s) or 0.0) for s, g in zip(names, goal)]
        if max(map(abs, off)) <= CLOSE * sum(goal):
            break
        asked = [max(0.0, a + x) for a, x in zip(asked, off)]
        lam, more, miss = multipliers(base, cap, asked, lam)
        steps += more
    rated = base.withColumn("cap", cap.cast("int")).withColumn("rate", F.least(cap, F.greatest(F.lit(0.0), _rate(lam)))).drop("p")
    whole = materialize(rounded(rated, key).drop("rate"), "rounded")
    chosen = repaired(whole, key, dict(zip(names, goal))).filter("repeticoes > 0")
    chosen = materialize(chosen.select(key, "fonte", "tokens", "repeticoes"), "mixture")
    sums = chosen.groupBy("fonte").agg(F.sum(F.col("tokens") * F.col("repeticoes")).alias("tokens"), F.count(F.lit(1)).alias("documentos"))
    total, planned = sum(goal) or 1.0, max((g / h for g, h in zip(goal, have) if h > 0), default=0.0)
    rows = [(s, w, g / total, h, bool(h > 0 and g / h >= planned - 1e-9)) for s, w, g, h in zip(names, weights, goal, have)]
    listed = targets.sparkSession.createDataFrame(rows, "fonte string, alvo double, meta double, disponivel double, limitante boolean")
    report = listed.join(sums, "fonte", "left").fillna(0, ["tokens", "documentos"])
    everything = chosen.agg(F.sum(F.col("tokens") * F.col("repeticoes")).alias("t")).first()["t"] or 0
    share = F.round(F.col("tokens") / F.lit(float(everything)), 6) if everything else F.lit(0.0)
    return chosen, report.select("fonte", "alvo", F.round("meta", 6).alias("meta"), share.alias("parte"), "tokens", "documentos", "disponivel", "limitante", F.lit(steps).alias("passos"), F.lit(miss).alias("erro"))
