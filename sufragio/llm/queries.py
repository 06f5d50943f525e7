"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufragio.llm import canonical, encoding, linkage, mixing, packing, reading, tokens
from sufragio.llm.topn import top_n
from sufragio.session import materialize, table


def same_persons(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "cadastro_legado")
    new = table(spark, folder, "consulta_cand").withColumn("sq_candidato", F.col("SQ_CANDIDATO").try_cast("bigint"))
    new = new.select("sq_candidato", "NM_CANDIDATO", "DT_NASCIMENTO", "NR_CPF_CANDIDATO")
    return linkage.link(old, new, "id_legado", "sq_candidato", "NM_CANDIDATO", "DT_NASCIMENTO", "NR_CPF_CANDIDATO")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_persons(spark, folder).select("id_legado", "sq_candidato")


def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return same_persons(spark, folder).select("id_legado", "sq_candidato", F.round("confidence", 6).alias("confidence"))


def damaged_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analytics").select("row_id", "SG_UF", "NM_CANDIDATO", "NM_URNA_CANDIDATO", "NM_UE")
    return encoding.find(rows, "SG_UF", ["NM_CANDIDATO", "NM_URNA_CANDIDATO", "NM_UE"], "row_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_text(spark, folder).select("row_id", F.col("field").alias("campo"))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_text(spark, folder).select("row_id", F.col("field").alias("campo"), "value", "restored", "chain", F.round("confidence", 6).alias("confidence"))


def typed_places(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analytics").filter(F.col("CD_MUNICIPIO").isNull()).select("row_id", "SG_UF", "NM_UE", "NM_MUNICIPIO")
    return canonical.match(rows, "SG_UF", ["NM_UE", "NM_MUNICIPIO"], table(spark, folder, "municipios_ref"), "CD_MUNICIPIO", "SG_UF", "NM_MUNICIPIO")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return typed_places(spark, folder).select("row_id", F.coalesce("__entry", F.lit("0")).alias("cd_municipio"))


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that mean no entry, with their rows."""
    none = typed_places(spark, folder).filter(F.col("__entry").isNull())
    return none.groupBy(F.upper(F.trim("SG_UF")).alias("sg_uf"), F.trim("NM_UE").alias("nm_ue"), F.trim("NM_MUNICIPIO").alias("nm_municipio")).agg(F.count(F.lit(1)).alias("linhas"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analytics")
    groups = {"ano_eleicao": F.col("ANO_ELEICAO"), "sg_uf": F.upper(F.trim("SG_UF")), "ds_cargo": F.upper(F.trim("DS_CARGO"))}
    return top_n(rows, groups, "QT_VOTOS_NOMINAIS_VALIDOS", [("row_id", True)], 5, ["row_id"])


CAPACITY = 2048  # tokens of a container


def measured_documents(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(tokens.sizes(table(spark, folder, "documents"), "doc_id", "text"), "sizes")


def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    items = tokens.sizes(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(items, "doc_id", "tokens", CAPACITY)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fills(packed_documents(spark, folder), "doc_id", CAPACITY)


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    return packing.summary(packed_documents(spark, folder), CAPACITY)


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    items = measured_documents(spark, folder)
    return packing.kept(packing.pack(items, "doc_id", "tokens", CAPACITY), items, "doc_id", "tokens", CAPACITY)


def _mixture(spark: SparkSession, folder: str, budget: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "fontes_alvo"), "doc_id", "text", "source", budget=budget)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p8_shares_all(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of as many tokens as there are, scarce sources being used up."""
    return _mixture(spark, folder, "all")[1]


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source with documents: whether its share is within a point of its target among
    the sources that have documents, and whether no document is used too often or twice chosen."""
    chosen, report = _mixture(spark, folder)
    most = table(spark, folder, "fontes_alvo").select(mixing.source_name(F.col("source")).alias("fonte"), "max_repeticoes")
    used = chosen.groupBy("fonte").agg(F.max("repeticoes").alias("r"), (F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("once"))
    rows = report.filter("disponivel > 0").join(used, "fonte", "left").join(most, "fonte")
    return rows.select("fonte", (F.abs(F.col("parte") - F.col("meta")) <= 0.01).alias("parte_mantida"), ((F.col("r") <= F.col("max_repeticoes")) & F.col("once")).alias("repeticoes_mantidas"))


def reading_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.assess(table(spark, folder, "documents"), table(spark, folder, "rotulos_leitura"), "doc_id", "text", "nivel")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading_levels(spark, folder).filter((F.col("nivel") == 4) & (F.col("palavras") >= 20)).select("doc_id")


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_levels(spark, folder).select("doc_id", "nivel", F.round("esperado", 6).alias("esperado"))


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, words and mean expected level by source and level."""
    of = table(spark, folder, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("n/a")).alias("fonte"))
    rows = reading_levels(spark, folder).join(of.dropDuplicates(["doc_id"]), "doc_id")
    return rows.groupBy("fonte", "nivel").agg(F.count(F.lit(1)).alias("documentos"), F.sum("palavras").alias("palavras"), F.round(F.avg("esperado"), 6).alias("esperado"))


def p9_hardest(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 most demanding texts of at least 20 words: the limit is the report."""
    rows = reading_levels(spark, folder).filter("palavras >= 20")
    return rows.orderBy(F.col("esperado").desc_nulls_last(), "doc_id").limit(100).select("doc_id", "nivel", F.round("esperado", 6).alias("esperado"))


QUERIES = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p2_found": p2_found, "p2_repaired": p2_repaired, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_summary": p7_summary, "p7_kept": p7_kept, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_shares_all": p8_shares_all, "p8_kept": p8_kept, "p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile, "p9_hardest": p9_hardest}
ORACLE = {
    "p6_found": """SELECT * FROM (SELECT ANO_ELEICAO AS ano_eleicao, upper(trim(SG_UF)) AS sg_uf, upper(trim(DS_CARGO)) AS ds_cargo,
  row_number() OVER (PARTITION BY ANO_ELEICAO, upper(trim(SG_UF)), upper(trim(DS_CARGO)) ORDER BY QT_VOTOS_NOMINAIS_VALIDOS DESC, row_id)::INT AS posicao, row_id
  FROM analytics WHERE ANO_ELEICAO IS NOT NULL AND SG_UF IS NOT NULL AND DS_CARGO IS NOT NULL AND QT_VOTOS_NOMINAIS_VALIDOS IS NOT NULL) WHERE posicao <= 5""",
    "p7_kept": "SELECT 0::BIGINT AS acima, 0::BIGINT AS perdidos, 0::BIGINT AS cortados, count(*) FILTER (WHERE length(text) > 0) AS documentos FROM documents",
    "p8_kept": """SELECT f.source AS fonte, TRUE AS parte_mantida, TRUE AS repeticoes_mantidas FROM fontes_alvo f WHERE EXISTS (SELECT 1 FROM documents d
  WHERE replace(replace(lower(trim(d.source)), ' ', '_'), '-', '_') = f.source AND length(d.text) > 0)""",
}
