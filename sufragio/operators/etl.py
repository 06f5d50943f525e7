"""From raw multi-year vote and register files to one fact table, with a quality report.

Partial and final aggregation, union by name and null-safe grouping are Spark's own. The register
is reduced to one row per join key before the join, so no vote is ever counted twice, and the join
is left to adaptive execution, which splits a hot key and broadcasts a register that is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufragio.functions import labels, text
from sufragio.operators.fact import ROLES, STORED, day, round_number
from sufragio.operators.relational import best_row
from sufragio.sources.files import year_of_name

# The columns of the fact table, in order.
CANONICAL = (
    "ANO_ELEICAO", "NR_TURNO", "SG_UF", "NM_UE", "CD_MUNICIPIO", "NR_ZONA", "NR_SECAO", "CD_CARGO", "DS_CARGO", "SQ_CANDIDATO", "NR_CANDIDATO", "NR_CPF_CANDIDATO",
    "NM_CANDIDATO", "NM_URNA_CANDIDATO", "SG_PARTIDO", "NM_PARTIDO", "TP_AGREMIACAO", "DS_GENERO", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL", "DS_COR_RACA", "DS_OCUPACAO",
    "DT_NASCIMENTO", "DT_ELEICAO", "DS_SIT_TOT_TURNO", "QT_VOTOS_NOMINAIS_VALIDOS", "LATITUDE", "LONGITUDE", "IDADE", "FAIXA_ETARIA",
)
VOTES = "QT_VOTOS_NOMINAIS_VALIDOS"
PROFILE = ("NR_CPF_CANDIDATO", "NM_CANDIDATO", "NM_URNA_CANDIDATO", "DT_NASCIMENTO", "DS_GENERO", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL", "DS_COR_RACA", "DS_OCUPACAO")
# The keys of the register join.
EXACT_KEY, WIDE_KEY = ("ANO_ELEICAO", "SQ_CANDIDATO"), ("ANO_ELEICAO", "NR_CANDIDATO", "SG_UF", "DS_CARGO")
# What makes two rows the same record.
IDENTITY = ("ANO_ELEICAO", "NR_TURNO", "SG_UF", "NM_UE", "NR_ZONA", "NR_SECAO", "DS_CARGO", "SQ_CANDIDATO")


def _pick(df: DataFrame, names: Sequence[str]) -> Column:
    there = {c.upper(): c for c in df.columns}
    return next((F.col(f"`{there[n]}`") for n in names if n in there), F.lit(None).cast("string"))


def _any(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that has a value in the row: files united by name may each carry
    a field under another of its names."""
    there = {c.upper(): c for c in df.columns}
    return F.coalesce(*[text.nullable(F.col(f"`{there[n]}`")) for n in names if n in there], F.lit(None).cast("string"))


def age_at(birth: Column, held: Column, year: Column) -> Column:
    """Whole years at the election, from the year if its day is unknown; null outside 15 to 120."""
    sane = F.when(F.year(birth).between(1900, 2100), birth)
    days = F.bround(F.datediff(F.when(F.year(held).between(1900, 2100), held), sane) / 365.25, 0).cast("int")
    age = F.coalesce(days, year - F.year(sane))
    return F.when(age.between(15, 120), age)


def prepare_register(raw: DataFrame) -> DataFrame:
    """Register rows under canonical names, each once."""
    names = list(dict.fromkeys([*EXACT_KEY, *WIDE_KEY, *PROFILE]))
    out = raw.select(*[_pick(raw, [n]).cast("string").alias(n) for n in names], *(["dt_carga"] if "dt_carga" in raw.columns else []))
    return out.withColumn("ANO_ELEICAO", text.whole(F.col("ANO_ELEICAO")).try_cast("int")).withColumns({n: text.nullable(n) for n in names if n != "ANO_ELEICAO"})


def _one_per(register: DataFrame, key: Sequence[str]) -> DataFrame:
    """The latest row per key, ties by content; rows with a null in the key cannot be joined."""
    newest = [F.desc_nulls_last("dt_carga")] if "dt_carga" in register.columns else []
    return best_row(register.dropna(subset=list(key)), list(key), [*newest, *[F.asc_nulls_last(c) for c in PROFILE], *[F.asc_nulls_last(c) for c in (*EXACT_KEY, *WIDE_KEY)]])


def enrich(votes: DataFrame, register: DataFrame) -> DataFrame:
    """Profile columns from the register where the vote row has none: by year and source id, else
    by year, number, state and office. Rows with a null in a key cannot match and stay out of its
    join, so that they are no hot key; the second join sees only what the first left without."""
    cols = votes.columns
    out, done = votes.withColumns({c: text.nullable(c) for c in PROFILE}), []
    for key in (EXACT_KEY, WIDE_KEY):
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(c).isNotNull()
        own = _one_per(register, key).select(*key, *[F.col(c).alias(f"__{c}") for c in PROFILE], F.lit(True).alias("__hit"))
        joined = out.filter(whole).join(own, list(key), "left")
        found = joined.withColumns({c: F.coalesce(c, f"__{c}") for c in PROFILE})
        if key == EXACT_KEY:
            # a row that was found and still lacks something may have it from the second key
            lacking = F.col("__hit").isNull()
            for c in PROFILE:
                lacking = lacking | F.col(c).isNull()
            done.append(found.filter(~lacking).select(*cols))
            out = found.filter(lacking).select(*cols).unionByName(out.filter(~whole).select(*cols))
        else:
            done += [found.select(*cols), out.filter(~whole).select(*cols)]
    return done[0].unionByName(done[1]).unionByName(done[2])


def with_keys(df: DataFrame) -> DataFrame:
    """The fact table with its normalised keys as columns: filters on them reach the files."""
    made = {"state": F.upper(text.nullable("SG_UF")), "office_key": F.upper(text.nullable("DS_CARGO")), "place_key": labels.place_key(F.col("NM_UE"))}
    return df.withColumns({STORED[k]: c for k, c in made.items()})


def canonical(raw: DataFrame) -> DataFrame:
    """Raw vote rows as the columns of the fact table; what a file lacks is null. The year comes
    from the file's name where there is no column for it."""
    year = text.whole(_any(raw, ROLES["year"])).try_cast("int")
    year = F.coalesce(year, year_of_name(F.col("__file"))) if "__file" in raw.columns else year
    out = {c: text.nullable(_pick(raw, [c]).cast("string")) for c in CANONICAL}
    out |= {
        "ANO_ELEICAO": year,
        "NR_TURNO": F.nullif(round_number(_any(raw, ROLES["round"])), F.lit(0)),
        "DS_CARGO": _any(raw, ROLES["office"]),
        "NM_UE": _any(raw, ROLES["place"]),
        VOTES: F.coalesce(text.whole(_any(raw, ROLES["votes"])).try_cast("bigint"), F.lit(0).cast("bigint")),
        "LATITUDE": text.number(_pick(raw, ["LATITUDE"])),
        "LONGITUDE": text.number(_pick(raw, ["LONGITUDE"])),
    }
    return raw.select(*[out[c].alias(c) for c in CANONICAL])


def with_ages(df: DataFrame) -> DataFrame:
    age = age_at(day(F.col("DT_NASCIMENTO")), day(F.col("DT_ELEICAO")), F.col("ANO_ELEICAO"))
    return df.withColumn("IDADE", age).withColumn("FAIXA_ETARIA", labels.age_band(F.col("IDADE")))


def rollup(df: DataFrame, value: str = VOTES) -> DataFrame:
    """Rows equal in everything but the votes as one, null being equal to null."""
    keys = [c for c in df.columns if c != value]
    return df.groupBy(*keys).agg(F.sum(value).alias(value)).select(*df.columns)


def build(raw: DataFrame, register: DataFrame | None, rolled: bool = True, keys: bool = False) -> DataFrame:
    """The fact table; exact duplicates are dropped before votes are summed. keys: with_keys()."""
    df = canonical(raw)
    df = enrich(df, prepare_register(register)) if register is not None else df
    df = with_ages(df).distinct()
    df = rollup(df) if rolled else df
    return with_keys(df) if keys else df


def quality(df: DataFrame) -> DataFrame:
    """One row: rows, negative votes, records that stand more than once, and nulls per column."""
    cols = [c for c in CANONICAL if c in df.columns]
    key = [c for c in IDENTITY if c in df.columns]
    base = df.agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col(VOTES) < 0).alias("votos_negativos"), *[F.count_if(F.col(c).isNull()).alias(f"nulos_{c}") for c in cols])
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("linhas_repetidas")).select("linhas_repetidas").scalar()
    return base.withColumn("linhas_repetidas", twice)


def quality_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("ANO_ELEICAO").alias("ano")).agg(
        F.count(F.lit(1)).alias("linhas"), F.count_distinct(F.upper(F.trim("SG_UF"))).alias("ufs"), F.count_distinct(F.upper(F.trim("DS_CARGO"))).alias("cargos"),
        F.count_distinct("SQ_CANDIDATO").alias("candidatos"), F.coalesce(F.sum(VOTES), F.lit(0)).alias("votos"),
    )


def report(df: DataFrame) -> dict:
    """The quality report as a plain dict: one row and one per year reach the driver."""
    q = quality(df).first().asDict()
    n = q["linhas"] or 1
    missing = [c for c in CANONICAL if c not in df.columns]
    return {
        "rows": q["linhas"], "missing_columns": missing, "negative_votes": q["votos_negativos"], "duplicate_rows": q["linhas_repetidas"],
        "null_rates": {k[6:]: round(v / n, 6) for k, v in q.items() if k.startswith("nulos_")}, "years": [r.asDict() for r in quality_by_year(df).orderBy("ano").collect()],
    }


def gate(found: dict, max_duplicates: int = 0, max_negative: int = 0, max_null_rate: float = 0.5, required: Sequence[str] = ("ANO_ELEICAO", "SG_UF", "DS_CARGO")) -> list[str]:
    """Reasons against publishing; none is a pass."""
    out = [f"missing column {c}" for c in found["missing_columns"]]
    out += [f"{found['duplicate_rows']} duplicate rows"] if found["duplicate_rows"] > max_duplicates else []
    out += [f"{found['negative_votes']} negative votes"] if found["negative_votes"] > max_negative else []
    return out + [f"{c}: null rate {found['null_rates'][c]}" for c in required if found["null_rates"].get(c, 1.0) > max_null_rate]


def ready(found: dict, manifest: dict, years: Sequence[int]) -> list[str]:
    """Reasons against going live: years without rows, or artefacts without content."""
    there = {r["ano"] for r in found["years"] if r["linhas"]}
    return [f"year {y} has no rows" for y in sorted(set(years) - there)] + [f"{f['path']} is empty" for f in manifest.get("files", []) if not f["bytes"]]


def municipalities(df: DataFrame) -> DataFrame:
    """codigo, uf, municipio: the most frequent name of each code (ties by name), and the places
    without a code under their own names."""
    rows = df.select(text.nullable(text.digits("CD_MUNICIPIO")).alias("codigo"), F.upper(text.nullable("SG_UF")).alias("uf"), text.nullable("NM_UE").alias("municipio")).filter(F.col("uf").isNotNull() & F.col("municipio").isNotNull())
    counts = rows.groupBy("codigo", "uf", "municipio").agg(F.count(F.lit(1)).alias("n"))
    coded = counts.filter(F.col("codigo").isNotNull())
    w = Window.partitionBy("codigo").orderBy(F.desc("n"), "municipio", "uf")
    best = coded.withColumn("r", F.row_number().over(w)).filter("r = 1").select("codigo", "uf", "municipio")
    bare = counts.filter(F.col("codigo").isNull()).select("codigo", "uf", "municipio")
    return best.unionByName(bare).dropDuplicates(["codigo", "uf", "municipio"])


def locate(places: DataFrame, coords: DataFrame) -> DataFrame:
    """places with latitude, longitude and how they were found: by code, by state and name, by a
    name that only one state has, or by the mean of the state's known places; else null.
    coords: codigo, uf, municipio, latitude, longitude; invalid coordinates are ignored."""
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    c = coords.filter(ok).withColumn("key", labels.place_key(F.col("municipio")))
    mean = [F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng")]
    steps = {
        "codigo": (c.filter(F.col("codigo").isNotNull()).groupBy("codigo").agg(*mean), ["codigo"]),
        "uf_nome": (c.groupBy("uf", "key").agg(*mean), ["uf", "key"]),
        "nome": (c.groupBy("key").agg(*mean, F.count_distinct("uf").alias("n")).filter("n = 1").drop("n"), ["key"]),
        "uf": (c.groupBy("uf").agg(*mean), ["uf"]),
    }
    out = places.withColumn("key", labels.place_key(F.col("municipio")))
    for name, (side, on) in steps.items():
        out = out.join(side.withColumnsRenamed({"lat": f"lat_{name}", "lng": f"lng_{name}"}), on, "left")
    how = F.coalesce(*[F.when(F.col(f"lat_{s}").isNotNull(), s) for s in steps])
    return out.select(*places.columns, F.coalesce(*[F.col(f"lat_{s}") for s in steps]).alias("latitude"), F.coalesce(*[F.col(f"lng_{s}") for s in steps]).alias("longitude"), how.alias("achado_por"))


def locate_zones(zones: DataFrame, shapes: DataFrame) -> DataFrame:
    """zones (uf, municipio, zona) with the centre of their shape: by state, place and zone, else
    state and zone, else zone, else the middle of the place's shapes. shapes: uf, municipio, zona, latitude, longitude."""
    digits = lambda x: F.regexp_replace(text.digits(x), "^0+", "")
    s = shapes.select(F.upper(F.trim("uf")).alias("uf"), labels.place_key(F.col("municipio")).alias("key"), digits("zona").alias("z"), "latitude", "longitude")
    mean = [F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng")]
    out = zones.withColumn("key", labels.place_key(F.col("municipio"))).withColumn("z", digits("zona"))
    keys = (["uf", "key", "z"], ["uf", "z"], ["z"], ["uf", "key"])
    for i, on in enumerate(keys):
        out = out.join(s.groupBy(*on).agg(*mean).withColumnsRenamed({"lat": f"lat{i}", "lng": f"lng{i}"}), on, "left")
    return out.select(*zones.columns, F.coalesce(*[f"lat{i}" for i in range(len(keys))]).alias("latitude"), F.coalesce(*[f"lng{i}" for i in range(len(keys))]).alias("longitude"))
