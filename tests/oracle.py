"""Run a registered query in Spark and its SQL in DuckDB, and compare rows, types and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
          "BOOLEAN": "boolean"}


def _clean(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    return repr(v)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when both sides agree."""
    rel = con.sql(sql)
    want_types = {c: _KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    have_types = dict(df.dtypes)
    problems = []
    if set(want_types) != set(have_types):
        return [f"columns {sorted(have_types)} != {sorted(want_types)}"]
    for c in want_types:
        if want_types[c] != have_types[c]:
            problems.append(f"type of {c}: spark {have_types[c]}, sql {want_types[c]}")
    names = sorted(want_types)
    have = sorted(tuple(_clean(r[c]) for c in names) for r in df.select(*names).collect())
    want = sorted(tuple(_clean(v) for v in r) for r in con.sql(
        "SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall())
    if len(have) != len(want):
        problems.append(f"rows: spark {len(have)}, sql {len(want)}")
    if have != want:
        a, b = set(have), set(want)
        problems.append(f"{len(a - b)} rows only in spark, e.g. {sorted(a - b)[:3]}; "
                        f"{len(b - a)} only in sql, e.g. {sorted(b - a)[:3]} ({names})")
    if not have:
        problems.append("note: empty result")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from dayspell.queries import ORACLES, QUERIES
    from dayspell.session import local_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problems = compare(df, con, ORACLES[name])
            else:
                problems = [f"note: no SQL, {df.count()} rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:900]}"]
        real = [p for p in problems if not p.startswith("note")]
        bad += bool(real)
        print(("FAIL" if real else "ok  "), name, f"{time.time() - t0:.1f}s", *problems, flush=True)
    print("failed:", bad, "of", len(names))
