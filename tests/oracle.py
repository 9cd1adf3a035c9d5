"""Comparing a query with its SQL form."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(frame: pd.DataFrame) -> list[str]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x)).lower()
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x):.9g}"
        return str(x)

    columns = sorted(frame.columns)
    return sorted("|".join(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def by_sql(sql: str, folder: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).df()


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows, {hashlib.md5(str(a).encode()).hexdigest()[:6]}; only here {only[0]}; only in SQL {only[1]}"
