"""Find text that was decoded with the wrong character encoding and restore it.

A value's latent state is the encoding chain it went through (none for clean text). Evidence is
gathered per distinct word: each word with a character outside ASCII (or a question mark) is
taken back through every chain, and both forms are scored by a model of clean words, which mixes
word frequencies over all rows with character trigrams. A value's words are pooled, and
expectation-maximization estimates how often each chain occurs per source and field, so that
weak evidence in one value is weighed by what its source does; it runs until no rate moves by more
than STILL. Every chain that changes a word stays a hypothesis. The posterior then decides each
value, and its words are replaced where the chain's form is the likelier one.

Scale: only distinct values and distinct words are scored; the trigram model has at most
|ALPHABET|^3 entries, a fixed bound, and is the only thing sent to Python; word frequencies are
joined. The dictionary of damaged values goes back to the rows by broadcast only if its measured
size allows, else by a salted join.

Defined cases: null, blank and ASCII-only values without a question mark are clean; characters
lost for good (U+FFFD, or a question mark that no clean word has there) make a value damaged and
are refilled only by a known word or the likeliest letters; repeated rows are each reported;
empty tables give empty results; very long words are scored whole, in logarithms.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufragio.session import materialize, measured

LETTERS = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜ"
ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'’\"()/-_&?ªº#^$" + LETTERS)
REFILL = "ÃÇÍÉÁÕÚÊÔÓÂÜÏÑ’"
LOST = "�"
WORD_BREAK = "[ \\t\\r\\n]+"
MIX, APPLIED, SALTS = 0.7, 0.9, 16
PRIOR, STRENGTH = 0.002, 50.0
#: The rates have converged when no expected share of a chain moves by more.
STILL = 1e-4


def _tables() -> dict[str, dict[str, list[int]]]:
    """For each group of code pages: character -> bytes that it may have been read from. A
    character whose small letter is another character of the page (text put in capitals after
    the damage) has that byte too."""
    groups = {"win": ("cp1252", "latin-1"), "dos": ("cp850", "cp437"), "mac": ("mac_roman",)}
    out: dict[str, dict[str, list[int]]] = {}
    for name, pages in groups.items():
        own: dict[str, list[int]] = {}
        for page in pages:
            for b in range(128, 256):
                try:
                    own.setdefault(bytes([b]).decode(page), []).append(b)
                except UnicodeDecodeError:
                    pass
        lifted: dict[str, list[int]] = {}
        for ch, bs in own.items():
            if len(ch.upper()) == 1 and ch.upper() != ch:
                lifted.setdefault(ch.upper(), []).extend(bs)
        for ch, bs in lifted.items():
            own[ch] = list(dict.fromkeys([*own.get(ch, []), *bs]))
        out[name] = {ch: list(dict.fromkeys(bs)) for ch, bs in own.items()}
    return out


TABLES = _tables()
#: Single-byte chains: the page the text was read with, and the page it was written in.
SINGLE = {"win>dos": ("cp850", "cp1252"), "win>dos437": ("cp437", "cp1252"), "win>mac": ("mac_roman", "cp1252"), "dos>win": ("cp1252", "cp850"), "mac>win": ("cp1252", "mac_roman"), "mac>dos": ("cp850", "mac_roman"), "dos>mac": ("mac_roman", "cp850")}
CHAINS = ("utf8>win", "utf8>dos", "utf8>mac", *SINGLE, "lost")


#: Characters that some page holds: a byte sequence of any other character is no restoration.
REPERTOIRE = frozenset(ch for t in TABLES.values() for ch in t)


def _sequence(word: str, i: int, table: dict[str, list[int]]) -> tuple[str, int] | None:
    """The character whose UTF-8 bytes word shows from i on, and their number; a printable one
    goes before a control character, which only text damaged twice has."""
    control = None
    for b in (b for b in table.get(word[i], ()) if 0xC2 <= b <= 0xF4):
        n = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        rest = [[x for x in table.get(ch, ()) if 0x80 <= x <= 0xBF] for ch in word[i + 1 : i + n]]
        if len(rest) < n - 1 or not all(rest):
            continue
        for tail in itertools.product(*rest):
            try:
                found = bytes([b, *tail]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if found in REPERTOIRE:
                if found.isprintable() or found == "\u00a0":
                    return found, n
                control = control or (found, n)
    return control


def _utf8(word: str, table: dict[str, list[int]]) -> str:
    out, i = [], 0
    while i < len(word):
        found = _sequence(word, i, table) if ord(word[i]) > 127 else None
        out.append(found[0] if found else word[i])
        i += found[1] if found else 1
    return "".join(out)


def _single(word: str, read: str, written: str) -> str:
    out = []
    for ch in word:
        if ord(ch) > 127:
            for c in (ch, ch.lower()):
                try:
                    ch = c.encode(read).decode(written)
                    break
                except (UnicodeDecodeError, UnicodeEncodeError):
                    continue
        out.append(ch)
    return "".join(out)


def restored(word: str) -> dict[str, str]:
    """Chain -> the word taken back through it, in capitals, for the chains that change it.
    Text that went through a chain several times is taken back until it stays the same."""
    out: dict[str, str] = {}
    for group, table in TABLES.items():
        now = word
        while (back := _utf8(now, table)) != now:  # ends: every change shortens the word
            now = back
        if now != word:
            out[f"utf8>{group}"] = now.upper()
    for name, (read, written) in SINGLE.items():
        back = _single(word, read, written)
        if back != word and all(ch.isprintable() for ch in back):
            out[name] = back.upper()
    return out


class WordModel:
    """Interpolated trigrams over ALPHABET; any other character is one class."""

    def __init__(self, counts: dict[str, float]):
        self.tri, self.bi, self.uni, self.ctx1, self.ctx2 = counts, {}, {}, {}, {}
        for g, n in counts.items():
            self.bi[g[1:]] = self.bi.get(g[1:], 0.0) + n
            self.uni[g[2]] = self.uni.get(g[2], 0.0) + n
            self.ctx2[g[:2]] = self.ctx2.get(g[:2], 0.0) + n
            self.ctx1[g[1]] = self.ctx1.get(g[1], 0.0) + n
        self.total = sum(counts.values()) or 1.0

    def step(self, a: str, b: str, c: str) -> float:
        p = 0.62 * self.tri.get(a + b + c, 0.0) / self.ctx2.get(a + b, 1.0) + 0.3 * self.bi.get(b + c, 0.0) / self.ctx1.get(b, 1.0)
        return math.log(p + 0.07 * self.uni.get(c, 0.0) / self.total + 1e-7)

    def score(self, word: str) -> float:
        s = "^^" + "".join(ch if ch in ALPHABET else "¤" for ch in word.upper()) + "$"
        return sum(self.step(s[i - 2], s[i - 1], s[i]) for i in range(2, len(s)))

    def refill(self, word: str) -> tuple[str, float]:
        """The likeliest letters in place of the lost ones; one mark or two a letter. Exact: for each
        last two letters, which are all that counts further on, the best way there is kept."""
        best = (word, -math.inf)
        for form in dict.fromkeys((word, word.replace("??", "?"))):
            ways: dict[str, float] = {"^^": 0.0}
            steps: list[dict[str, tuple[str, str]]] = []
            for ch in form + "$":
                reached: dict[str, float] = {}
                back: dict[str, tuple[str, str]] = {}
                for c in REFILL if ch == "?" else ch:
                    shown = c if c in ALPHABET else "¤"
                    for last, p in ways.items():
                        q, to = p + self.step(last[0], last[1], shown), last[1] + shown
                        if q > reached.get(to, -math.inf):
                            reached[to], back[to] = q, (last, c)
                ways = reached
                steps.append(back)
            at = max(ways, key=lambda w: ways[w])
            if ways[at] > best[1]:
                score, letters = ways[at], []
                for back in reversed(steps):
                    at, c = back[at]
                    letters.append(c)
                best = ("".join(reversed(letters))[:-1], score)
        return best


def hypotheses(words: DataFrame, trigrams: dict[str, float]) -> DataFrame:
    """word -> word, lm (its own score), chain, fixed, fixed_lm: a row per chain that changes it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = WordModel(trigrams)
        for pdf in batches:
            rows = []
            for word in pdf["word"]:
                own = model.score(word)
                for chain, fixed in restored(word).items():
                    rows.append((word, own, chain, fixed, model.score(fixed)))
                if "?" in word or LOST in word:
                    fixed, lm = model.refill(word.upper().replace(LOST, "?"))
                    rows.append((word, own, "lost", fixed, lm))
            yield pd.DataFrame(rows, columns=["word", "lm", "chain", "fixed", "fixed_lm"])

    return words.select("word").mapInPandas(run, "word string, lm double, chain string, fixed string, fixed_lm double")


def _skeleton(c):
    return F.regexp_replace(c, "[^\\x00-\\x7F]", "?")


def damaged_values(values: DataFrame) -> DataFrame:
    """values: source, field, value, n (distinct). Gives source, field, value, chain, confidence
    and restored for the values judged damaged."""
    odd = lambda c: F.col(c).rlike("[^\\x00-\\x7F]|\\?")
    texts = values.groupBy("value").agg(F.sum("n").alias("n"))
    words = texts.select(F.explode(F.split("value", WORD_BREAK)).alias("word"), "n").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    lexicon = words.groupBy(F.upper("word").alias("fixed")).agg(F.sum("n").cast("double").alias("count"))
    total = words.agg(F.sum("n").alias("t")).first()["t"] or 1

    plain = "".join(sorted(ALPHABET - set("^$")))
    escaped = plain.replace("\\", "\\\\").replace("]", "\\]").replace("-", "\\-").replace("[", "\\[").replace("&", "\\&")
    # words with any other character are left out of the model: most are damaged
    marked = F.concat(F.lit("^^"), F.col("fixed"), F.lit("$"))
    thirds = lexicon.filter(~F.col("fixed").rlike(f"[^{escaped}]")).select(marked.alias("s"), "count").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring("s", i, F.lit(3)))).alias("g"), "count")
    # at most |ALPHABET|^3 rows, whatever the data
    trigrams = {r["g"]: r["c"] for r in thirds.groupBy("g").agg(F.sum("count").alias("c")).collect()}

    suspects = words.filter(odd("word"))
    hyp = materialize(hypotheses(suspects.repartition(max(2, values.sparkSession.sparkContext.defaultParallelism)), trigrams), "restorations")
    # a lost letter is refilled by the most frequent known word of that shape, if there is one
    shapes = lexicon.filter(F.col("fixed").rlike("[^\\x00-\\x7F]") & ~F.contains("fixed", F.lit(LOST))).groupBy(_skeleton(F.col("fixed")).alias("shape")).agg(F.max(F.struct("count", "fixed")).alias("known"))
    lost = hyp.filter("chain = 'lost'").withColumn("shape", F.translate(F.upper("word"), LOST, "?"))
    lost = lost.withColumn("shape", F.explode(F.array_distinct(F.array("shape", F.replace("shape", F.lit("??"), F.lit("?"))))))
    lost = lost.join(shapes, "shape", "left").groupBy("word", "chain").agg(F.first("lm").alias("lm"), F.max("known").alias("known"), F.first("fixed").alias("f"), F.first("fixed_lm").alias("fixed_lm"))
    lost = lost.select("word", "lm", "chain", F.coalesce("known.fixed", "f").alias("fixed"), "fixed_lm")
    hyp = hyp.filter("chain <> 'lost'").unionByName(lost)

    own = suspects.select("word", F.upper("word").alias("upper")).join(lexicon.withColumnRenamed("fixed", "upper").withColumnRenamed("count", "own"), "upper").select("word", "own")
    hyp = hyp.join(lexicon, "fixed", "left").join(own, "word")
    rival = F.max(F.coalesce("count", F.lit(0.0)))
    best = hyp.groupBy("word").agg(rival.alias("rival"))
    hyp = hyp.join(best, "word")
    # a word that a chain turns into a far more frequent one is no evidence for itself
    clean = F.when((F.col("rival") >= 5 * F.col("own")) | (F.contains("word", F.lit(LOST))), 0.0).otherwise(F.col("own"))
    log_of = lambda count, lm: F.greatest(F.when(count > 0, F.log(MIX * count / total)).otherwise(F.lit(-1e9)), math.log(1 - MIX) + lm)
    more = log_of(F.coalesce("count", F.lit(0.0)), F.col("fixed_lm")) - log_of(clean, F.col("lm"))
    # no clean word has a replacement character
    more = F.when(F.contains("word", F.lit(LOST)) & (F.col("chain") == "lost"), F.lit(20.0)).otherwise(more)
    gain = hyp.select("word", "chain", "fixed", F.log((1 - APPLIED) + APPLIED * F.exp(F.least(more, F.lit(500.0)))).alias("gain"), (more > 0).alias("use"))
    gain = materialize(gain, "word-gains")

    odd_values = values.filter(odd("value")).withColumn("id", F.xxhash64("source", "field", "value"))
    parts = odd_values.select("source", "field", "value", "n", F.explode(F.split("value", WORD_BREAK)).alias("word"))
    scored = parts.join(gain, "word").groupBy("source", "field", "value", "n", "chain").agg(F.sum("gain").alias("gain"))
    scored = scored.groupBy("source", "field", "value", "n").agg(F.collect_list(F.struct("chain", "gain")).alias("h"))  # at most one entry per chain
    scored = materialize(scored, "value-gains")

    rows = values.groupBy("source", "field").agg(F.sum("n").alias("all"))
    start = F.map_from_arrays(F.array(*[F.lit(c) for c in CHAINS]), F.array(*[F.lit(PRIOR)] * len(CHAINS)))
    rates, small = measured(materialize(rows.withColumn("rate", start), "rates"))
    # values of the same evidence count together: the rounds see each kind of evidence once
    kinds = materialize(scored.groupBy("source", "field", "h").agg(F.sum("n").alias("n")), "kinds-of-evidence")
    every = materialize(rows.withColumn("chain", F.explode(F.array(*[F.lit(c) for c in CHAINS]))), "chains")
    while True:  # the likelihood rises with every round and is bounded
        expected = _posterior(kinds, rates).select("source", "field", "n", F.explode("post").alias("p")).groupBy("source", "field", "p.chain").agg(F.sum(F.col("n") * F.col("p.p")).alias("e"))
        share = (F.coalesce("e", F.lit(0.0)) + STRENGTH * PRIOR) / (F.col("all") + STRENGTH)
        new = every.join(expected, ["source", "field", "chain"], "left").withColumn("share", share)
        new = new.groupBy("source", "field", "all").agg(F.map_from_entries(F.collect_list(F.struct("chain", "share"))).alias("rate"))
        new = new.join(rates.select("source", "field", F.col("rate").alias("old")), ["source", "field"])
        moved = F.array_max(F.transform(F.array(*[F.lit(c) for c in CHAINS]), lambda c: F.abs(F.element_at("rate", c) - F.element_at("old", c))))
        now = materialize(new.withColumn("moved", moved).drop("old"), "rates")
        still = (now.agg(F.max("moved")).first()[0] or 0.0) <= STILL
        rates = F.broadcast(now.drop("moved")) if small else now.drop("moved")
        if still:
            break
    top = F.array_max(F.transform("post", lambda p: F.struct(p["p"].alias("p"), p["chain"].alias("chain"))))
    whole = F.aggregate("post", F.lit(0.0), lambda a, p: a + p["p"])
    judged = _posterior(scored, rates).withColumn("confidence", whole).filter("confidence > 0.5").select("source", "field", "value", "confidence", top["chain"].alias("chain"))
    judged = materialize(judged, "damaged")
    return _repaired(judged, gain)


def _posterior(scored: DataFrame, rates: DataFrame) -> DataFrame:
    """post: chain and posterior of each hypothesis beside the clean one, which has gain 0."""
    x = scored.join(rates, ["source", "field"])
    odds = F.transform("h", lambda h: F.struct(h["chain"].alias("chain"), (F.element_at("rate", h["chain"]) * F.exp(F.least(h["gain"], F.lit(600.0)))).alias("o")))
    x = x.withColumn("o", odds).withColumn("z", 1 + F.aggregate("o", F.lit(0.0), lambda a, o: a + o["o"]))
    return x.withColumn("post", F.transform("o", lambda o: F.struct(o["chain"].alias("chain"), (o["o"] / F.col("z")).alias("p"))))


def _repaired(judged: DataFrame, gain: DataFrame) -> DataFrame:
    """The values with each word replaced where its chain's form is the likelier one."""
    words = judged.select("source", "field", "value", "chain", "confidence", F.posexplode(F.split("value", WORD_BREAK)).alias("at", "word"))
    use = gain.filter("use").select("word", "chain", "fixed")
    return (
        words.join(use, ["word", "chain"], "left")
        .groupBy("source", "field", "value", "chain", "confidence")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "word").alias("w")))), lambda x: x["w"]), " ").alias("restored"))
    )


def find(rows: DataFrame, source: str, fields: Sequence[str], key: str) -> DataFrame:
    """key, field, value, restored, chain, confidence for each damaged value of each row."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    long = rows.select(key, F.coalesce(F.upper(F.trim(source)), F.lit("")).alias("source"), each.alias("x")).select(key, "source", "x.*").filter(F.col("value").isNotNull())
    values = materialize(long.groupBy("source", "field", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    bad, small = measured(materialize(damaged_values(values), "damaged-values"))
    odd = long.filter(F.col("value").rlike("[^\\x00-\\x7F]|\\?"))
    if small:
        return odd.join(bad, ["source", "field", "value"])
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return odd.withColumn("salt", F.pmod(F.hash(key), F.lit(SALTS))).join(bad, ["source", "field", "value", "salt"]).drop("salt")
