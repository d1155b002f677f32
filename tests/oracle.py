"""Holds a Spark query against its SQL in DuckDB."""

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(str(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in frame.itertuples(index=False, name=None))


def same(frame: pd.DataFrame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    other = con.execute(sql).df()
    assert sorted(frame.columns) == sorted(other.columns)
    assert rows(frame) == rows(other)
