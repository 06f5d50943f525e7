"""Rows of a query in Spark and of its SQL in DuckDB, in a form that can be compared."""

from pathlib import Path

import duckdb
import pandas as pd


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 6))
    return str(v).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.astype(object).itertuples(index=False))


def database(folder: str):
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db
