import pytest

from conftest import SMALL
from parity import database, rows
from sufragio.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert rows(got) == rows(database(SMALL).execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name,columns", [("p1_found", ["id_legado", "sq_candidato"]), ("p2_found", ["row_id", "campo"]), ("p5_found", ["row_id", "cd_municipio"]), ("p9_found", ["doc_id"])])
def test_shape_of_found(spark, name, columns):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.columns == columns and df.count() > 0 and df.distinct().count() == df.count()


def test_entry_adds_these(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
