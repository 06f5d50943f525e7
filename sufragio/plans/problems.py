"""Queries of the general problems over the election tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufragio.operators import drift, malformed
from sufragio.session import materialize, table

#: Fields of a raw vote line, in order.
RAW_FIELDS = (
    "ANO_ELEICAO", "NR_TURNO", "SG_UF", "NM_UE", "CD_MUNICIPIO", "NR_ZONA", "NR_SECAO", "CD_CARGO", "DS_CARGO", "SQ_CANDIDATO", "NR_CANDIDATO",
    "NM_CANDIDATO", "NM_URNA_CANDIDATO", "SG_PARTIDO", "NM_PARTIDO", "TP_AGREMIACAO", "DT_ELEICAO", "DS_SIT_TOT_TURNO", "QT_VOTOS_NOMINAIS_VALIDOS",
)
RAW_TYPES = {"ANO_ELEICAO": "int", "NR_TURNO": "int", "SQ_CANDIDATO": "bigint", "QT_VOTOS_NOMINAIS_VALIDOS": "bigint"}
RAW_CHECKS = {"SQ_CANDIDATO": "[0-9]{1,18}", "QT_VOTOS_NOMINAIS_VALIDOS": "[0-9]{1,18}"}


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.separate(table(spark, folder, "votacao_bruta"), "linha", RAW_FIELDS, RAW_CHECKS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.failing(raw_lines(spark, folder)).select("line_id", "motivo")


def p3_valid(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.typed(raw_lines(spark, folder), RAW_FIELDS, RAW_TYPES, ["line_id"])


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_lines(spark, folder)
    return rows.groupBy("arquivo").agg(
        F.count(F.lit(1)).alias("linhas"),
        *[F.count_if(F.col("motivo") == m).alias(m) for m in ("quoting", "column_count", "invalid_value")],
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.report(
        table(spark, folder, "remessas"), table(spark, folder, "remessa_linhas"), "remessa_id", "serie", "dt_geracao", "cabecalho", "remessa_id", "conteudo"
    )


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent(table(spark, folder, "remessas"), table(spark, folder, "remessa_linhas"), "remessa_id", "cabecalho", "linha_id", "remessa_id", "conteudo")


def p4_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return drift.rejects(p4_table(spark, folder))


def p4_types(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of files in which a field of a series has one type."""
    cat = drift.catalogue(table(spark, folder, "remessas"), table(spark, folder, "remessa_linhas"), "remessa_id", "serie", "dt_geracao", "cabecalho", "remessa_id", "conteudo")
    return drift.islands(materialize(cat, "field-lifespans"))


QUERIES = {"p3_found": p3_found, "p3_valid": p3_valid, "p3_report": p3_report, "p4_found": p4_found, "p4_table": p4_table, "p4_rejected": p4_rejected, "p4_types": p4_types}

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^";]*)'
_PARSED = f"""WITH l AS (SELECT line_id, arquivo, regexp_replace(linha, '\\r\\z', '') AS t FROM votacao_bruta),
j AS (SELECT *, regexp_matches(t, '^{_FIELD}(?:;{_FIELD})*\\z') AS well FROM l),
f AS (SELECT *, CASE WHEN well THEN list_transform(regexp_extract_all(';' || t, ';({_FIELD})', 1),
  lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END)) END AS v FROM j),
r AS (SELECT line_id, arquivo, v, CASE WHEN NOT well THEN 'quoting' WHEN coalesce(len(v), 0) <> 19 THEN 'column_count'
  WHEN NOT regexp_full_match(v[10], '[0-9]{{1,18}}') OR NOT regexp_full_match(v[19], '[0-9]{{1,18}}') THEN 'invalid_value' END AS motivo FROM f)
"""
_KNOWN = ", ".join(f"('{n}', '{k}')" for n, k in drift.meanings(drift.ALIASES).items())
_TYPE_CASES = " ".join(f"WHEN regexp_full_match(v, '{p}') THEN '{t}'" for t, p in drift.TYPES.items())
_WIDE = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate([*drift.TYPES, "text"]))

_HEADS = """heads AS (SELECT remessa_id, name, min(p) AS p FROM (
  SELECT remessa_id, upper(trim(replace(unnest(string_split(cabecalho, ';')), chr(65279), ''))) AS name, generate_subscripts(string_split(cabecalho, ';'), 1) AS p FROM remessas)
  WHERE name <> '' GROUP BY ALL)"""
_VALUES = """vals AS (SELECT remessa_id, linha_id, unnest(string_split(conteudo, ';')) AS v, generate_subscripts(string_split(conteudo, ';'), 1) AS p FROM remessa_linhas)"""

ORACLE = {
    "p3_found": _PARSED + "SELECT line_id, motivo FROM r WHERE motivo IS NOT NULL",
    "p3_valid": _PARSED
    + "SELECT line_id, "
    + ", ".join(f"try_cast(v[{i}] AS {RAW_TYPES[f]}) AS {f}" if f in RAW_TYPES else f"v[{i}] AS {f}" for i, f in enumerate(RAW_FIELDS, 1))
    + " FROM r WHERE motivo IS NULL",
    "p3_report": _PARSED
    + "SELECT arquivo, count(*) AS linhas, "
    + ", ".join(f"count(*) FILTER (WHERE motivo = '{m}') AS {m}" for m in ("quoting", "column_count", "invalid_value"))
    + " FROM r GROUP BY arquivo",
    "p4_found": f"""WITH known(name, field) AS (VALUES {_KNOWN}), {_HEADS}, {_VALUES},
tally AS (SELECT remessa_id, p, t, count(*) AS n FROM (SELECT remessa_id, p, CASE {_TYPE_CASES} ELSE 'text' END AS t FROM vals WHERE trim(v) NOT IN ('', '#NULO#')) GROUP BY ALL),
best AS (SELECT remessa_id, p, t FROM tally QUALIFY row_number() OVER (PARTITION BY remessa_id, p ORDER BY n DESC, CASE t {_WIDE} END DESC) = 1),
nums AS (SELECT remessa_id, serie, row_number() OVER (PARTITION BY serie ORDER BY dt_geracao, remessa_id) AS s FROM remessas),
cat AS (SELECT serie, s, h.remessa_id, h.name, t, coalesce(field, h.name) AS field FROM heads h JOIN nums USING (remessa_id) LEFT JOIN best USING (remessa_id, p) LEFT JOIN known k ON k.name = h.name),
born AS (SELECT a.* FROM cat a LEFT JOIN cat b ON a.serie = b.serie AND a.name = b.name AND b.s = a.s - 1 WHERE b.name IS NULL AND a.s > 1),
gone AS (SELECT a.serie, a.s + 1 AS s, n.remessa_id, a.name, a.t, a.field FROM cat a JOIN nums n ON n.serie = a.serie AND n.s = a.s + 1
  LEFT JOIN cat b ON a.serie = b.serie AND a.name = b.name AND b.s = a.s + 1 WHERE b.name IS NULL),
b2 AS (SELECT *, row_number() OVER (PARTITION BY remessa_id, field ORDER BY name) AS k FROM born),
g2 AS (SELECT *, row_number() OVER (PARTITION BY remessa_id, field ORDER BY name) AS k FROM gone),
both_ AS (SELECT coalesce(b2.remessa_id, g2.remessa_id) AS remessa_id, b2.name AS new, g2.name AS old, b2.t AS nt, g2.t AS ot
  FROM b2 FULL JOIN g2 ON b2.remessa_id = g2.remessa_id AND b2.field = g2.field AND b2.k = g2.k)
SELECT remessa_id, coalesce(new, old) AS campo, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'renamed' END AS mudanca FROM both_
UNION ALL SELECT remessa_id, new, 'type_changed' FROM both_ WHERE nt <> ot
UNION ALL SELECT a.remessa_id, a.name, 'type_changed' FROM cat a JOIN cat b ON a.serie = b.serie AND a.name = b.name AND b.s = a.s - 1 WHERE a.t <> b.t""",
}


def _consistent_sql() -> str:
    """Written from the rule: what fits a whole number, a code or a date, and where the rest goes."""
    cases = []
    for field, (kind, _) in drift.ALIASES.items():
        v = f"r_{field}"
        words = f"regexp_full_match({v}, '([^0-9.,+-]*[^0-9 .,+-]-)?[^0-9.,+-]*[0-9]+[^0-9.,+-]*') THEN regexp_extract({v}, '[0-9]+')"
        if kind == "int":
            cast = f"try_cast(CASE WHEN regexp_full_match({v}, '[+-]?[0-9]+') THEN {v} WHEN regexp_full_match({v}, '[+-]?[0-9]+[.,]0+') THEN split_part(replace({v}, ',', '.'), '.', 1) WHEN {words} END AS BIGINT)"
        elif kind == "digits":
            cast = f"CASE WHEN regexp_full_match({v}, '[0-9]+') THEN {v} WHEN regexp_full_match({v}, '[0-9]+[.,]0+') THEN split_part(replace({v}, ',', '.'), '.', 1) WHEN {words} END"
        elif kind == "date":
            cast = f"""CASE WHEN regexp_full_match({v}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime({v}, '%d/%m/%Y')::DATE
  WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9:]{{8}})?') THEN try_strptime(substr({v}, 1, 10), '%Y-%m-%d')::DATE END"""
        else:
            cast = v
        cases.append(f"{cast} AS {field}")
    raw = ", ".join(f"max(v) FILTER (WHERE field = '{f}' AND k = 1) AS r_{f}" for f in drift.ALIASES)
    rejected = ", ".join(f"CASE WHEN r_{f} IS NOT NULL AND {f} IS NULL THEN '{f}=' || r_{f} END" for f in drift.ALIASES)
    return f"""WITH known(name, field) AS (VALUES {_KNOWN}), {_HEADS}, {_VALUES},
named AS (SELECT l.remessa_id, l.linha_id, l.p, coalesce(h.name, '#' || l.p) AS name, k.field, CASE WHEN trim(v) NOT IN ('', '#NULO#') THEN trim(v) END AS v
  FROM vals l LEFT JOIN heads h USING (remessa_id, p) LEFT JOIN known k ON k.name = h.name),
ranked AS (SELECT *, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY linha_id, field, v IS NULL ORDER BY p) END AS k FROM named),
wide AS (SELECT remessa_id, linha_id, {raw}, string_agg(name || '=' || v, ';' ORDER BY p) FILTER (WHERE v IS NOT NULL AND (field IS NULL OR k > 1)) AS outros FROM ranked GROUP BY remessa_id, linha_id),
made AS (SELECT *, {', '.join(cases)} FROM wide)
SELECT remessa_id, linha_id, {', '.join(drift.ALIASES)}, outros, nullif(concat_ws(';', {rejected}), '') AS rejeitados FROM made"""


ORACLE["p4_table"] = _consistent_sql()
ORACLE["p4_rejected"] = f"SELECT split_part(r, '=', 1) AS campo, count(*) AS valores FROM (SELECT unnest(string_split(rejeitados, ';')) AS r FROM ({ORACLE['p4_table']}) WHERE rejeitados IS NOT NULL) GROUP BY 1"
ORACLE["p4_types"] = f"""WITH {_HEADS}, {_VALUES},
tally AS (SELECT remessa_id, p, t, count(*) AS n FROM (SELECT remessa_id, p, CASE {_TYPE_CASES} ELSE 'text' END AS t FROM vals WHERE trim(v) NOT IN ('', '#NULO#')) GROUP BY ALL),
best AS (SELECT remessa_id, p, t FROM tally QUALIFY row_number() OVER (PARTITION BY remessa_id, p ORDER BY n DESC, CASE t {_WIDE} END DESC) = 1),
nums AS (SELECT remessa_id, serie, row_number() OVER (PARTITION BY serie ORDER BY dt_geracao, remessa_id) AS s FROM remessas),
cat AS (SELECT serie, s, name, t FROM heads h JOIN nums USING (remessa_id) LEFT JOIN best USING (remessa_id, p)),
runs AS (SELECT *, s - row_number() OVER (PARTITION BY serie, name, t ORDER BY s) AS island FROM cat)
SELECT serie, name AS campo, t AS tipo, min(s) AS primeiro, max(s) AS ultimo FROM runs GROUP BY serie, name, t, island"""
