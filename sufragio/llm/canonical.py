"""Map freely typed values to the entries of a canonical list.

Values are normalised (case, accents, blanks, office prefixes, a trailing state, abbreviations,
particles) and spelt by sound, then taken once per distinct key and scope. Keys and entries are
vectors of their character n-grams (single letters, bigrams, trigrams, and both of the latter with
their letters in order, which a transposition leaves alone; a gram's second occurrence is a gram of
its own), weighted by the root of the inverse document frequency in the list. An inverted index of
the scope's entries yields the candidates of every key, also of those that are spelt as an entry
is: only the rarest grams of either side are indexed, as many as it takes for the rest to have a
norm below THRESHOLD - MARGIN. Two vectors whose rarest common gram lies in that rest cannot have a
cosine of THRESHOLD - MARGIN, so no pair that matters is missed. The best cosine must reach
THRESHOLD. If others lie within MARGIN of it, the one of strictly the smallest edit distance is
meant, else none; and at least EDIT of its letters must stand.

Scale: rows shrink to distinct keys before anything is exploded; postings are the list's; only
candidates are scored, from sorted arrays of numbered grams. The dictionary of results goes back to
the rows by broadcast only if its measured size allows, else by a join salted over SALTS, as one
key may stand in a third of all rows.

Defined cases: null and blank texts mean nothing; a row whose texts mean nothing, whose scope is
unknown or whose best entries are too close gets no entry (null from match(), '0' in p5_found);
if two texts of a row mean different entries the better score counts, then the smaller entry;
repeated rows each get a row; entries of the list with one key in one scope cannot be told apart
and match neither; an empty list matches nothing; very long texts are compared whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufragio.functions.text import ACCENTED, PLAIN
from sufragio.session import materialize, measured

THRESHOLD, MARGIN, EDIT, SALTS = 0.5, 0.03, 0.55, 16
#: Weight of a gram that no entry has, as a share of that of one which a single entry has.
UNSEEN = 0.8
#: A gram's number holds its squared weight, in millionths, above this many bits.
BITS, MILLION = 36, 1_000_000
# Abbreviations in Brazilian place names and what they stand for.
ABBREVIATIONS = {
    "S": "SAO", "STA": "SANTA", "STO": "SANTO", "PRES": "PRESIDENTE", "PTE": "PRESIDENTE", "SEN": "SENADOR", "MAL": "MARECHAL", "CEL": "CORONEL",
    "GEN": "GENERAL", "GOV": "GOVERNADOR", "DR": "DOUTOR", "JD": "JARDIM", "PTO": "PORTO", "LAG": "LAGOA", "RIB": "RIBEIRAO", "CACH": "CACHOEIRA",
    "CORR": "CORREGO", "N": "NOVA", "VL": "VILA", "3": "TRES", "2": "DOIS",
}
PARTICLES = ("DE", "DO", "DA", "DOS", "DAS", "D", "E")
#: Spellings of one sound, replaced in this order.
SOUNDS = (("TH", "T"), ("PH", "F"), ("CH", "X"), ("SS", "C"), ("K", "C"), ("Y", "I"), ("W", "V"), ("Z", "S"), ("J", "G"), ("H", ""))
OFFICE = "^(?:PREF\\.? ?MUN\\.?|PREFEITURA MUNICIPAL|PREFEITURA|MUNICIPIO|MUN\\.|CIDADE)(?: (?:DE|DO|DA))?(?=[ .]) *"


def _plain(text: Column) -> Column:
    x = F.translate(text, "’´`_", "''' ")
    x = F.upper(F.regexp_replace(F.translate(x, ACCENTED, PLAIN), "[^\\x00-\\x7F]", ""))
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def _suffix(states: list[str]) -> str:
    return "(?<=.)(?:[-/,] ?|\\()(" + "|".join(states or ["\\b\\B"]) + ")\\)?\\z"


def named_state(text: Column, states: list[str]) -> Column:
    """The state that a text names at its end, as in 'X - SP', 'X/SP', 'X, SP' or 'X (SP)'."""
    return F.nullif(F.regexp_extract(_plain(text), _suffix(states), 1), F.lit(""))


def sound_key(text: Column, states: list[str]) -> Column:
    """Key of a typed or listed name; null if nothing is left of it."""
    x = F.trim(F.regexp_replace(_plain(text), _suffix(states), ""))
    x = F.regexp_replace(x, OFFICE, "")
    x = F.trim(F.regexp_replace(F.replace(x, F.lit("D'"), F.lit("D ")), "[^A-Z0-9]+", " "))
    x = F.regexp_replace(x, "^D (?=.)", "DOM ")
    full = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    words = F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(full, w), w))
    x = F.array_join(F.filter(words, lambda w: ~w.isin(*PARTICLES)), "")
    for a, b in SOUNDS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.nullif(F.regexp_replace(x, "(.)\\1+", "$1"), F.lit(""))


def grams(key: Column) -> Column:
    s = F.concat(F.lit("^"), key, F.lit("$"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    same = lambda n: F.transform(run(n), lambda g: F.concat(F.lit(f"{n}:"), F.array_join(F.array_sort(F.split(g, "")), "")))
    return F.concat(run(1), run(2), run(3), same(2), same(3))


def _counted(keys: DataFrame, by: list[str]) -> DataFrame:
    """by, gram: a row per gram of each key; the n-th occurrence of a gram has its number."""
    each = keys.select(*by, F.explode(grams(F.col("key"))).alias("gram")).groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"))
    return each.select(*by, F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), "n"), lambda i: F.when(i == 1, F.col("gram")).otherwise(F.concat("gram", F.lit("#"), i.cast("string"))))).alias("gram"))


def _numbers(listed: DataFrame, total: int) -> DataFrame:
    """gram and id of the list's grams. Ids are ordered by weight, so the rarest gram has the
    largest; grams of one weight are numbered, a window over grams of the list only."""
    weight = F.round(F.log(1 + F.lit(float(total)) / (1 + F.col("n"))) * MILLION).cast("bigint")
    of = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).select("gram", weight.alias("w"))
    return of.select("gram", (F.shiftleft("w", BITS) + F.row_number().over(Window.partitionBy("w").orderBy("gram"))).alias("id"))


def _weight(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftright(x, BITS))


def _prefix(ids: Column, norm: Column, bound: float) -> Column:
    """The ids, rarest first, without as many of the last ones as have a norm below the bound."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["sum"] + F.shiftright(x, BITS)).alias("sum"), (a["n"] + F.when(a["sum"] + F.shiftright(x, BITS) < bound * bound * norm, 1).otherwise(0)).alias("n"))
    rest = F.aggregate(F.array_sort(ids), start, step)["n"]
    return F.slice(F.sort_array(ids, False), F.lit(1), F.size(ids) - rest)


def match_keys(keys: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, edit: float = EDIT) -> DataFrame:
    """keys: distinct (scope, key); entries: (scope, key, entry). Gives scope, key, entry, score
    (the cosine) for the keys that mean an entry."""
    total, bound = entries.count(), max(threshold - margin, 0.0)
    listed = _counted(entries, ["scope", "key", "entry"])
    numbers, _ = measured(materialize(_numbers(listed, total), "gram-numbers"))
    listed = listed.join(numbers, "gram").groupBy("scope", "entry", F.col("key").alias("entry_key")).agg(F.collect_list("id").alias("e"))
    listed = materialize(listed.withColumn("en", _weight(F.col("e"))), "entry-vectors")
    inside = keys.join(F.broadcast(entries.select("scope").distinct()), "scope", "left_semi")  # at most the parts of the list
    unseen = int(UNSEEN * UNSEEN * math.log(1 + total) * MILLION)
    typed = _counted(inside, ["scope", "key"]).join(numbers, "gram", "left").groupBy("scope", "key").agg(F.collect_list("id").alias("q"), F.count_if(F.col("id").isNull()).alias("new"))
    typed = materialize(typed.withColumn("qn", _weight(F.col("q")) + F.col("new") * unseen).filter("size(q) > 0"), "key-vectors")

    index = listed.select("scope", "entry", F.explode(_prefix(F.col("e"), F.col("en"), bound)).alias("id"))
    asked = typed.select("scope", "key", F.explode(_prefix(F.col("q"), F.col("qn"), bound)).alias("id"))
    pairs = asked.join(index, ["scope", "id"]).select("scope", "key", "entry").distinct()
    cosine = _weight(F.array_intersect("q", "e")) / F.sqrt(F.col("qn").cast("double") * F.col("en"))
    scored = pairs.join(typed, ["scope", "key"]).join(listed, ["scope", "entry"]).select("scope", "key", "entry", "entry_key", cosine.alias("score")).filter(F.col("score") >= bound)
    whole = Window.partitionBy("scope", "key")
    near = scored.withColumn("best", F.max("score").over(whole)).filter((F.col("best") >= threshold) & (F.col("score") > F.col("best") - margin))
    near = near.withColumn("away", F.levenshtein("key", "entry_key"))
    least = near.withColumn("least", F.min("away").over(whole)).filter("away = least").withColumn("n", F.count(F.lit(1)).over(whole))
    stand = 1 - F.col("away") / F.greatest(F.length("key"), F.length("entry_key"))
    return least.filter((F.col("n") == 1) & (stand >= edit)).select("scope", "key", "entry", "score")


def _with_keys(rows: DataFrame, scope: Column, texts: list[str], states: list[str]) -> DataFrame:
    for i, t in enumerate(texts):
        rows = rows.withColumn(f"__key{i}", sound_key(F.col(t), states)).withColumn(f"__scope{i}", F.coalesce(scope, named_state(F.col(t), states)))
    return rows


def match(rows: DataFrame, scope: str, texts: list[str], reference: DataFrame, entry: str, entry_scope: str, entry_name: str, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """rows with __entry (null: no entry) and __score. scope names the part of the list (the
    state) in which the texts are looked up; where it is null the text's end names it."""
    states = sorted(r[0] for r in reference.select(F.upper(F.trim(entry_scope))).distinct().collect() if r[0])
    entries = reference.select(F.upper(F.trim(entry_scope)).alias("scope"), sound_key(F.col(entry_name), states).alias("key"), F.col(entry).alias("entry")).dropna()
    own = F.nullif(F.upper(F.trim(F.regexp_replace(F.col(scope), "\\s+", " "))), F.lit(""))
    keyed = _with_keys(rows, own, texts, states)
    pairs = F.explode(F.array(*[F.struct(F.col(f"__scope{i}").alias("scope"), F.col(f"__key{i}").alias("key")) for i in range(len(texts))]))
    keys = keyed.select(pairs.alias("p")).select("p.*").dropna().distinct()
    found, small = measured(materialize(match_keys(materialize(keys, "typed-keys"), entries, threshold, margin), "typed-values"))
    if not small:
        found = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("__salt", (F.rand(7) * SALTS).cast("int"))
    best = []
    for i in range(len(texts)):
        f = found.select(F.col("scope").alias(f"__scope{i}"), F.col("key").alias(f"__key{i}"), F.struct((-F.col("score")).alias("s"), F.col("entry").alias("e")).alias(f"__m{i}"), *(["__salt"] if not small else []))
        keyed = keyed.join(F.broadcast(f) if small else f, [f"__scope{i}", f"__key{i}", *(["__salt"] if not small else [])], "left")
        best.append(F.col(f"__m{i}"))
    keyed = keyed.withColumn("__m", F.least(*best) if len(best) > 1 else best[0])
    return keyed.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__m.e").alias("__entry"), (-F.col("__m.s")).alias("__score"))
