"""Run queries against their SQL in DuckDB and compare names, types and values.

    python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def expected(con, sql: str) -> tuple[list[str], list[str], Counter]:
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    names = [row[0] for row in described]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = con.execute(sql).fetchall()
    return ([names[i] for i in order], [described[i][1] for i in order],
            Counter(tuple(row[i] for i in order) for row in rows))


def actual(df) -> tuple[list[str], list[str], Counter]:
    names = sorted(df.columns)
    types = dict(df.dtypes)
    kinds = [TYPES.get(types[n], types[n].upper()) for n in names]
    columns = df.select(*[df[f"`{n}`"] for n in names])
    return names, kinds, Counter(tuple(row) for row in columns.collect())


def differences(got, want) -> list[str]:
    problems = []
    if got[0] != want[0]:
        problems.append(f"columns {got[0]} instead of {want[0]}")
    elif got[1] != want[1]:
        problems += [f"type of {n}: {g} instead of {w}" for n, g, w in zip(*got[:2], want[1]) if g != w]
    if got[2] != want[2]:
        extra, lacking = got[2] - want[2], want[2] - got[2]
        problems.append(f"{sum(got[2].values())} rows instead of {sum(want[2].values())}, "
                        f"{sum(extra.values())} unexpected, {sum(lacking.values())} missing; "
                        f"e.g. {list(extra)[:1]} / {list(lacking)[:1]}")
    return problems


def main() -> int:
    from burnledger.plans.oracle import ORACLES
    from burnledger.plans.registry import QUERIES
    from burnledger.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            got = actual(QUERIES[name](spark, sf_dir))
            spent = time.time() - start
            problems = differences(got, expected(con, ORACLES[name]))
            rows = sum(got[2].values())
        except Exception as error:  # report and go on with the next query
            problems, rows, spent = [f"{type(error).__name__}: {str(error)[:1500]}"], -1, time.time() - start
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={rows} {spent:.2f}s", *problems, sep="\n     "
              if problems else " ", flush=True)
    print(f"{len(names) - failed} of {len(names)} queries agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
