"""Match records of the same person across two sources that share no key.

Each attribute is turned into a fixed bit vector of its q-grams: the eleven digits of the person
number by position, the six digits of the birth date by position, and the bigrams of the first
name and of each family name, spelt by sound. Their joined vector has four blocks for the number,
three for the date (year, month, day) and one for each name word. Close pairs are found exactly by
multi-index hashing: every record is indexed under the combinations of blocks in _keys, so that a
pair meets in some bucket if
  - two of the four number blocks are undamaged, as after any change of up to two digits (4 bits), or
  - the date is undamaged, but for day and month turned round, and so is one name word; with w words
    in common, any w - 1 changed bits of the names, and more where they fall into the same words, or
  - one date block is damaged and two name words are undamaged (any w - 2 changed bits), or
  - the last four digits of a number known in part and one name word are undamaged.
No other pair is compared; one that shares neither number nor date is never a match.

Dice scores of a pair's vectors give each field a level of agreement. The weight of each field's
level is learned by expectation-maximization over the counts of all compared pairs by levels: among
matches the fields are independent; among other pairs the date and the names are counted together,
over pairs whose complete numbers differ, so that relatives and namesakes are seen as what they
are. Prior and weights make a posterior, the confidence; pairs above CUT are matches.

Scale: both sides shrink to distinct identities before indexing, so copies of a record cost
nothing; buckets need the equality of six digits, or of a date and a word; candidate pairs are
made distinct by a shuffle on the pair, a hot bucket is split by adaptive execution, and
everything stays in the JVM. What reaches the driver is one row per combination of levels.

Defined cases: a missing or unusable attribute gives no evidence and no block; a record without
a usable name is matched by nothing; all copies of a record and all candidacies of one person
(same folded name and birth date) give their pairs, once each; empty tables give no pairs; very
long names are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufragio.functions.text import ACCENTED, PLAIN
from sufragio.session import materialize, measured

# Portuguese short names and the names they stand for.
NICKNAMES = {
    "ZE": "JOSE", "TIAO": "SEBASTIAO", "MUNDICO": "RAIMUNDO", "CHICO": "FRANCISCO", "CHICA": "FRANCISCA", "TONHO": "ANTONIO", "TONHA": "ANTONIA",
    "QUINCAS": "JOAQUIM", "CACA": "CARLOS", "TETE": "TEREZINHA", "BETO": "ROBERTO", "NECO": "MANOEL", "NANDO": "FERNANDO", "LULA": "LUIZ", "DUDU": "EDUARDO", "DITO": "BENEDITO",
}
PARTICLES = ("DE", "DO", "DA", "DOS", "DAS", "E")
TITLES = ("DR", "DRA", "PROF", "PROFA", "SR", "SRA", "PASTOR", "PASTORA", "PE", "PADRE", "CABO", "SGT", "CEL")
SUFFIXES = ("JUNIOR", "NETO", "FILHO", "SOBRINHO", "JR")
SOUNDS = (("TH", "T"), ("PH", "F"), ("CH", "X"), ("K", "C"), ("Y", "I"), ("W", "V"), ("Z", "S"), ("J", "G"), ("H", ""))
MONTHS = {m: i for i, m in enumerate(("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"), 1)}
#: Posterior from which a pair is a match, and how often a first name must stand on the other side to be known there.
CUT, KNOWN = 0.5, 2


def folded(name: Column) -> Column:
    """Capitals without accents; 'SURNAME, GIVEN' turned round; letters and single blanks only."""
    x = F.upper(F.translate(F.translate(F.coalesce(name, F.lit("")), "’´`", "'''"), ACCENTED, PLAIN))
    x = F.regexp_replace(x, "'", "")
    x = F.regexp_replace(x, "^\\s*([^,]+),\\s*(.+)$", "$2 $1")
    return F.trim(F.regexp_replace(x, "[^A-Z]+", " "))


def sounds(word: str) -> str:
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return re.sub("(.)\\1+", "\\1", word)


def tokens(name: Column) -> Column:
    """Name words by sound, without particles and titles, short names spelt out."""
    full = F.create_map(*[F.lit(sounds(v)) for kv in NICKNAMES.items() for v in kv])
    words = F.filter(F.split(folded(name), " "), lambda w: (w != "") & ~w.isin(*PARTICLES, *TITLES))

    def sound(w: Column) -> Column:
        for a, b in SOUNDS:
            w = F.replace(w, F.lit(a), F.lit(b))
        w = F.regexp_replace(w, "(.)\\1+", "$1")
        return F.coalesce(F.try_element_at(full, w), w)

    return F.transform(words, sound)


def _bits(grams: Column) -> Column:
    """64-bit vector of hashed grams."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(grams, F.lit(0).cast("bigint"), lambda a, g: a.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))


def _bigrams(words: Column) -> Column:
    def of(w: Column) -> Column:
        s = F.concat(F.lit("^"), w, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))

    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 1), of))


def _positions(digits: Column, first: int, last: int) -> Column:
    """One bit per position and digit; unknown positions ('*') have none."""
    out = F.lit(0).cast("bigint")
    for k, p in enumerate(range(first, last + 1)):
        d = F.substring(digits, p, 1).try_cast("int")
        out = out.bitwiseOR(F.coalesce(F.call_function("shiftleft", F.lit(1).cast("bigint"), d + 10 * k), F.lit(0).cast("bigint")))
    return out


def person_number(c: Column) -> Column:
    """Eleven digits or '*' per position; null if unusable."""
    x = F.regexp_replace(c, "[\\s.\\-]", "")
    whole = F.when(x.rlike("^[0-9]{8,11}\\z"), F.lpad(x, 11, "0"))
    masked = F.when(x.rlike("^[0-9*]{11}\\z") & x.rlike("[0-9]{2}"), x)
    return F.when(~F.regexp_replace(x, "\\*", "").rlike("^([0-9])\\1*\\z"), F.coalesce(whole, masked))


def birth_date(c: Column) -> Column:
    """yyMMdd of the usual ways to write a date; null for placeholders and other text."""
    x = F.trim(c)
    month = F.create_map(*[F.lit(v) for m, i in MONTHS.items() for v in (m, f"{i:02d}")])
    named = F.regexp_extract(x, "^(\\d\\d)-([a-z]{3})-(\\d{4})\\z", 2)
    ymd = (
        F.when(x.rlike("^\\d\\d/\\d\\d/\\d{4}\\z"), F.concat(x.substr(7, 4), x.substr(4, 2), x.substr(1, 2)))
        .when(x.rlike("^\\d{8}\\z"), F.concat(x.substr(5, 4), x.substr(3, 2), x.substr(1, 2)))
        .when(x.rlike("^\\d{4}-\\d\\d-\\d\\d"), F.concat(x.substr(1, 4), x.substr(6, 2), x.substr(9, 2)))
        .when(x.rlike("^\\d\\d/\\d\\d/\\d\\d\\z"), F.concat(F.lit("19"), x.substr(7, 2), x.substr(4, 2), x.substr(1, 2)))
        .when(named != "", F.concat(x.substr(8, 4), F.try_element_at(month, named), x.substr(1, 2)))
    )
    usable = ~ymd.isin("19000101", "00000000") & (ymd.substr(5, 2) != "00") & (ymd.substr(7, 2) != "00")
    return F.when(usable, ymd.substr(3, 6))


def normalised(df: DataFrame, name: str, date: str, number: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, folded(F.col(name)).alias("name"), birth_date(F.col(date)).alias("date"), person_number(F.col(number)).alias("cpf"))


def encode(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the normalised attributes (name, date, cpf) and their bit vectors."""
    x = df.select(*keep, "name", tokens(F.col("name")).alias("words"), "date", "cpf")
    rest = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    family = F.filter(rest, lambda w: ~w.isin(*SUFFIXES, "GUNIOR") & (F.length(w) > 1))
    md = F.concat(F.least(F.col("date").substr(3, 2), F.col("date").substr(5, 2)), F.greatest(F.col("date").substr(3, 2), F.col("date").substr(5, 2)))
    x = x.withColumn("family", F.array_distinct(family)).withColumn("first", F.get("words", F.lit(0)))
    return x.select(
        *keep, "name", "cpf", "date", "first", F.substring("first", 1, 1).alias("initial"), (F.length("first") == 1).alias("short"),
        _bits(_bigrams(F.array("first"))).alias("bf"), F.array_sort(F.array_distinct(F.transform("family", lambda w: _bits(_bigrams(F.array(w)))))).alias("bw"),
        _positions(F.col("cpf"), 1, 6).alias("bc0"), _positions(F.col("cpf"), 7, 11).alias("bc1"),
        _positions(F.col("date"), 1, 6).alias("bd"), F.when(md.isNotNull(), md).alias("md"),
    )


def _keys() -> Column:
    """The hashes under which a record is indexed: each of a combination and its blocks."""
    cut = lambda c, low, n: F.call_function("shiftright", F.col(c), F.lit(10 * low)).bitwiseAND((1 << (10 * n)) - 1)
    full = lambda b, n: F.when(F.bit_count(b) == n, b)
    c = [full(cut("bc0", 0, 3), 3), full(cut("bc0", 3, 3), 3), full(cut("bc1", 0, 3), 3), full(cut("bc1", 3, 2), 2)]
    tail = full(cut("bc1", 1, 4), 4)
    y, m, d, md = F.col("date").substr(1, 2), F.col("date").substr(3, 2), F.col("date").substr(5, 2), F.col("md")
    names = F.filter(F.array_distinct(F.concat(F.array("bf"), "bw")), lambda w: w != 0)
    twos = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    none = F.array().cast("array<bigint>")
    fixed = [(c[i], c[j]) for i in range(4) for j in range(i + 1, 4)]
    made = [F.array(*[F.when(p.isNotNull() & q.isNotNull(), F.xxhash64(F.lit(k), p, q)) for k, (p, q) in enumerate(fixed)])]
    one = [(F.lit(10), tail), (F.lit(11), F.concat(y, md))]
    with_one = lambda k, b: F.transform(names, lambda w: F.xxhash64(k, b, w))
    with_two = lambda k, b: F.transform(twos, lambda t: F.xxhash64(k, b, t["a"], t["b"]))
    made += [F.when(b.isNotNull(), with_one(k, b)).otherwise(none) for k, b in one]
    two = [(F.lit(12), F.concat(y, m)), (F.lit(13), F.concat(y, d)), (F.lit(14), md)]
    made += [F.when(b.isNotNull(), with_two(k, b)).otherwise(none) for k, b in two]
    return F.array_distinct(F.filter(F.concat(*made), lambda k: k.isNotNull()))


def _dice(a: Column, b: Column) -> Column:
    whole = F.bit_count(a) + F.bit_count(b)
    return F.when(whole > 0, 2 * F.bit_count(a.bitwiseAND(b)) / whole)


#: Levels of agreement of each field, told by Dice scores of its vectors; the first is 'cannot be compared'.
NUMBER = ("none", "equal", "near", "differs", "part", "short part", "part differs", "differs in two blocks")
DATE = ("none", "equal", "turned or beside", "one digit", "two digits", "differs")
FIRST = ("none", "equal", "near", "far", "differs", "initial", "initial differs", "far and misspelt")
FAMILY = ("none", "equal", "near", "part", "some", "far", "differs", "near, no word equal", "part, no word equal", "some, no word equal")
SIZES = (len(NUMBER), len(DATE), len(FIRST), len(FAMILY))


def _level(*cases: tuple[Column, int], otherwise: int) -> Column:
    out = None
    for when, level in cases:
        out = F.when(when, level) if out is None else out.when(when, level)
    return out.otherwise(otherwise)


def compared(pairs: DataFrame) -> DataFrame:
    """pairs of l_* and r_* encodings as l_id, r_id and cell, the levels of the four fields in one number."""
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))  # noqa: E741
    # the number: Dice of the positions that both sides know
    known = lambda s: F.regexp_count(F.coalesce(s("cpf"), F.lit("")), F.lit("[0-9]"))
    few = F.least(known(l), known(r))
    same = F.bit_count(l("bc0").bitwiseAND(r("bc0"))) + F.bit_count(l("bc1").bitwiseAND(r("bc1")))
    digits = F.filter(F.zip_with(F.split(l("cpf"), ""), F.split(r("cpf"), ""), lambda a, b: (a != "*") & (b != "*") & (a != "") & (b != "")), lambda x: x)
    shared = F.when(few == 11, 11).otherwise(F.size(digits))
    apart = lambda c, low, n: (l(c).bitwiseXOR(r(c)).bitwiseAND(((1 << (10 * n)) - 1) << (10 * low)) == 0).cast("int")
    blocks = apart("bc0", 0, 3) + apart("bc0", 3, 3) + apart("bc1", 0, 3) + apart("bc1", 3, 2)
    number = _level((few == 0, 0), (shared < 4, 0), ((few == 11) & (same == 11), 1), ((few == 11) & (same >= 9), 2), ((few == 11) & (blocks >= 2), 7), (few == 11, 3), ((same == shared) & (shared > 4), 4), (same == shared, 5), otherwise=6)
    day = lambda s: s("date").substr(5, 2).cast("int")
    turned = (l("md") == r("md")) & (l("date").substr(1, 2) == r("date").substr(1, 2))
    beside = (l("date").substr(1, 4) == r("date").substr(1, 4)) & (F.abs(day(l) - day(r)) == 1)
    agree = F.bit_count(l("bd").bitwiseAND(r("bd")))
    date = _level((l("date").isNull() | r("date").isNull(), 0), (agree == 6, 1), (turned | beside, 2), (agree == 5, 3), (agree == 4, 4), otherwise=5)
    fd = _dice(l("bf"), r("bf"))
    first = _level((l("short") | r("short"), F.when(l("initial") == r("initial"), 5).otherwise(6)), (fd.isNull(), 0), (fd >= 0.95, 1), (fd >= 0.7, 2), (fd < 0.45, 4), (l("known") & r("known"), 3), otherwise=7)
    # the family: Dice of each word with the other side's words
    partner = lambda a, b: F.size(F.filter(a, lambda w: F.exists(b, lambda v: _dice(w, v) >= 0.6)))
    nl, nr = F.size(l("bw")), F.size(r("bw"))
    both = F.when(nl <= nr, partner(l("bw"), r("bw"))).otherwise(partner(r("bw"), l("bw")))
    less = F.least(nl, nr)
    bits = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, w: x.bitwiseOR(w))
    exact = F.size(F.array_intersect(l("bw"), r("bw"))) > 0
    level = lambda yes, no: F.when(exact, yes).otherwise(no)
    family = _level(
        (less == 0, 0), (l("bw") == r("bw"), 1), ((both == less) & (nl == nr), level(2, 7)), (both == less, level(3, 8)), (both > 0, level(4, 9)),
        (_dice(bits(l("bw")), bits(r("bw"))) >= 0.5, 5), otherwise=6,
    )
    cell = ((number * SIZES[1] + date) * SIZES[2] + first) * SIZES[3] + family
    return pairs.select("l_id", "r_id", cell.cast("int").alias("cell"))


#: Shares of the levels among matches and among other pairs from which learning starts, and how
#: many pairs they count for: small inputs keep them, in large ones the data decide.
MATCHES = (
    (0.3, 0.4, 0.15, 0.001, 0.08, 0.05, 0.001, 0.001), (0.1, 0.75, 0.08, 0.05, 0.01, 0.01), (0.01, 0.9, 0.03, 0.01, 0.003, 0.02, 0.002, 0.02),
    (0.01, 0.5, 0.1, 0.25, 0.07, 0.005, 0.02, 0.02, 0.01, 0.005),
)
OTHERS = (
    (0.3, 1e-6, 5e-6, 0.4, 1e-6, 1e-4, 0.3, 1e-4), (0.1, 5e-5, 3e-4, 2e-3, 0.02, 0.88), (0.01, 0.03, 0.01, 0.03, 0.88, 0.005, 0.03, 0.005),
    (0.01, 1e-4, 5e-4, 1e-3, 0.02, 0.01, 0.94, 0.002, 0.004, 0.01),
)
AS_MATCHES, AS_OTHERS = 30.0, 1e5


def confidences(cells: dict[int, float], sizes: dict[str, float]) -> dict[int, float]:
    """Posterior of a match for each cell. cells: number of compared pairs by cell; sizes: identities
    of either side (l, r), with a number (ln, rn), and with a complete one (lc, rc)."""
    if not cells:
        return {}
    of = np.array(sorted(cells))
    n = np.array([float(cells[c]) for c in of])
    at = np.stack(np.unravel_index(of, SIZES))
    number, rest = at[0], np.ravel_multi_index(at[1:], SIZES[1:])
    every, complete, some = sizes["l"] * sizes["r"], sizes["lc"] * sizes["rc"], sizes["ln"] * sizes["rn"]
    mixed = lambda counted, whole, start, weight: (counted + weight * start) / (whole + weight)
    count = lambda w: np.bincount(rest, w, minlength=int(np.prod(SIZES[1:])))
    # among other pairs: how often date and names agree, over all pairs whose complete numbers
    # differ where those all meet, else over those that met by their number alone
    start = np.einsum("i,j,k->ijk", *map(np.array, OTHERS[1:])).ravel()
    start /= start.sum()
    apart, random = count(n * np.isin(number, (3, 7))), count(n * (number == 7))
    other = np.maximum(mixed(apart, complete, start, AS_OTHERS), mixed(random, random.sum(), start, AS_OTHERS / 100))
    matched = np.where(number == 1, np.any(at[1:] == 1, axis=0), np.where(np.isin(number, (3, 7)), 0.0, 0.3)).astype(float)
    for _ in range(1000):
        share = [mixed(np.bincount(a, n * matched, minlength=k), (n * matched).sum(), np.array(m), AS_MATCHES) for a, k, m in zip(at, SIZES, MATCHES)]
        counted = np.bincount(number, n * (1 - matched), minlength=SIZES[0])
        counted[[0, 3, 6]] = every - some, complete, max(0.0, some - complete)  # nearly all pairs, most of which are never compared
        by_number = mixed(counted, every, np.array(OTHERS[0]), AS_OTHERS)
        odds = sum(np.log(p[a]) for p, a in zip(share, at)) - np.log(by_number[number] * other[rest]) + np.log(((n * matched).sum() + 0.5) / every)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, matched = np.abs(new - matched).max() < 1e-6, new
        if done:
            break
    return dict(zip(of.tolist(), matched.tolist()))


def link(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, date: str, number: str, cut: float = CUT) -> DataFrame:
    """left_id, right_id, confidence for the pairs of records of the same person."""
    # candidacies with one folded name and date are one person, whatever they say of the number
    l_id = F.xxhash64(*[F.coalesce(c, F.lit("-")) for c in ("name", "date", "cpf")])
    r_id = F.when(F.col("date").isNotNull(), F.xxhash64("name", "date")).otherwise(F.xxhash64("name", F.coalesce("cpf", F.lit("-"))))
    l_all = normalised(left, name, date, number, [left_id]).filter("name <> ''").withColumn("id", l_id)
    r_all = normalised(right, name, date, number, [right_id]).filter("name <> ''").withColumn("id", r_id)
    # identities first, vectors once each; a person's number is its most frequent one
    lefts = l_all.groupBy("id", "name", "date", "cpf").agg(F.count(F.lit(1)).alias("n"))
    rights = r_all.groupBy("id", "name", "date", "cpf").agg(F.count(F.lit(1)).alias("n"))
    usual = F.max(F.struct(F.col("cpf").isNotNull(), "n", "cpf"))["cpf"].alias("cpf")
    rights = rights.groupBy("id", "name", "date").agg(usual)
    lefts = materialize(encode(lefts, ["id"]).drop("name"), "left-identities")
    rights = materialize(encode(rights, ["id"]).drop("name"), "right-identities")
    index = lambda x, s: x.select(F.col("id").alias(f"{s}_id"), F.explode(_keys()).alias("key"))
    met = index(lefts, "l").join(index(rights, "r"), "key").select("l_id", "r_id").distinct()

    def side(x: DataFrame, other: DataFrame, s: str) -> DataFrame:
        names, _ = measured(materialize(other.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= KNOWN).select("first", F.lit(True).alias("known")), "known-names"))
        x = x.join(names, "first", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("first")
        return x.select(*[F.col(c).alias(f"{s}_{c}") for c in x.columns])

    pairs = materialize(compared(met.join(side(lefts, rights, "l"), "l_id").join(side(rights, lefts, "r"), "r_id")), "pairs")
    cells = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the product of SIZES
    count = [F.count(F.lit(1)).alias(""), F.count("cpf").alias("n"), F.count_if(F.col("cpf").rlike("^[0-9]{11}\\z")).alias("c")]
    sizes = {s + c: float(v) for s, x in (("l", lefts), ("r", rights)) for c, v in zip(("", "n", "c"), x.agg(*count).first())}
    judged = [(c, p) for c, p in confidences(cells, sizes).items() if p >= cut]
    judged = left.sparkSession.createDataFrame(judged, "cell int, confidence double")
    good = pairs.join(F.broadcast(judged), "cell")  # bounded as the cells are
    out = good.join(l_all.select(F.col("id").alias("l_id"), left_id), "l_id").join(r_all.select(F.col("id").alias("r_id"), right_id).distinct(), "r_id")
    return out.select(left_id, right_id, "confidence")
