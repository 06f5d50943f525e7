import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sufragio.operators import malformed

FIELDS, CHECKS = ("A", "B", "C"), {"B": "[0-9]{1,18}"}
SCHEMA = "id bigint, linha string, motivo_antigo string"


def brute(line: str | None) -> str | None:
    """Field by field, character by character."""
    if line is None:
        return "column_count"
    line = line[:-1] if line.endswith("\r") else line
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return "quoting"
                if j + 1 < n and line[j + 1] == '"':
                    j += 2
                    continue
                break
            fields.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < n and line[i] != ";":
                return "quoting"
        else:
            j = line.find(";", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= n:
            break
        i += 1
    if len(fields) != 3:
        return "column_count"
    return None if re.fullmatch("[0-9]{1,18}", fields[1].strip(" ")) else "invalid_value"


def judged(spark, lines):
    df = spark.createDataFrame([(i, x, "x") for i, x in enumerate(lines)], SCHEMA)
    return {r["id"]: r["motivo"] for r in malformed.separate(df, "linha", FIELDS, CHECKS).collect()}


CASES = ["a;1;c", 'a;"1";c\r', '"a;b";2;c', '"a""b";2;"c\nd"', 'a"b;1;c', '"a;1;c', '"a"x;1;c', "a;1", "a;1;c;", "", None, ";;", "a; 12 ;c", "a;1,5;c", "a;1234567890123456789;c", "a;-1;c", "a;١;c", 'a;"";c', "a;1;c\r\r", '"";1;""', "a;1;c", "x" * 200_000 + ";1;" + "y;" * 3, '"' + 'q""' * 50_000 + '";1;c']


def test_cases_equal_brute_force(spark):
    assert judged(spark, CASES) == {i: brute(x) for i, x in enumerate(CASES)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='a1;" \r\n', max_size=14), min_size=30, max_size=60))
def test_random_lines_equal_brute_force(spark, lines):
    assert judged(spark, lines) == {i: brute(x) for i, x in enumerate(lines)}


def test_salted_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(malformed, "measured", lambda df: (df, False))
    assert judged(spark, CASES[:19]) == {i: brute(x) for i, x in enumerate(CASES[:19])}


def test_empty_table_and_typed_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = malformed.separate(df, "linha", FIELDS, CHECKS)
    assert malformed.failing(out).count() == 0
    full = spark.createDataFrame([(1, 'x; 7 ;"c""d"', "k"), (2, "bad", "k")], SCHEMA)
    parsed = malformed.separate(full, "linha", FIELDS, CHECKS)
    rows = malformed.typed(parsed, FIELDS, {"B": "bigint", "A": "int"}, ["id"]).collect()
    assert [tuple(r) for r in rows] == [(1, None, 7, 'c"d')]
    assert malformed.failing(parsed).columns == ["id", "linha", "motivo_antigo", "motivo"]


def test_no_checks_is_structure_only(spark):
    df = spark.createDataFrame([(1, "a;b;c", ""), (2, "a", "")], SCHEMA)
    assert [r["motivo"] for r in malformed.separate(df, "linha", FIELDS, {}).orderBy("id").collect()] == [None, "column_count"]


@pytest.mark.parametrize("delimiter,quote", [("|", "'"), (",", '"')])
def test_other_delimiters(spark, delimiter, quote):
    line = f"{quote}a{delimiter}b{quote}{delimiter}1{delimiter}c"
    df = spark.createDataFrame([(1, line, "")], SCHEMA)
    assert malformed.separate(df, "linha", FIELDS, CHECKS, delimiter=delimiter, quote=quote).first()["motivo"] is None
