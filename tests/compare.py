"""Runs registered queries next to their SQL twins and compares all values."""

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT else v)
        df[c] = df[c].map(lambda v: "∅" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _kinds(df):
    return {c: ("i" if str(t).lower().startswith(("int", "uint")) else str(t)) for c, t in df.dtypes.items()}


def compare(con, got_df, sql):
    """Empty text when equal, else what differs."""
    types = dict(got_df.dtypes)
    got = _norm(got_df.toPandas())
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    want = _norm(rel.df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    bad = {c: (types[c], want_types[c]) for c in types if names.get(types[c]) != want_types[c]}
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        a, b = (set(map(tuple, x.values)) for x in (got, want))
        return f"rows {len(got)} != {len(want)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    diff = (got != want).any(axis=1)
    if diff.any():
        i = diff.idxmax()
        return f"{diff.sum()} rows differ: {got.loc[i].to_dict()} != {want.loc[i].to_dict()}"[:1500]
    return "" if len(got) else "EMPTY"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as E
    from placelens.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    queries, oracles = E.queries(), E.oracle_sql()
    for name, fn in queries.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(con, fn(spark, sf_dir), oracles[name]) or "ok"
            else:
                result = f"rows {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__} {str(e)[:900]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {result}", flush=True)
