"""Run registered queries and their SQL side by side: python tests/oracle_check.py [sf] [name prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    names = sorted(spark_df.columns)
    got = Counter(tuple(canon(row[n]) for n in names) for row in spark_df.collect())
    cursor = con.execute(sql)
    have = [d[0] for d in cursor.description]
    if sorted(have) != names:
        return False, f"columns spark={names} sql={sorted(have)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = [have.index(n) for n in names]
    want = Counter(tuple(canon(row[i]) for i in order) for row in cursor.fetchall())
    if got == want:
        bad = [n for n in names if "HUGEINT" in types[n] or "DECIMAL" in types[n]]
        return True, f"{sum(got.values())} rows" + (f" TYPES {bad}" if bad else "")
    extra, lacking = list((got - want).items())[:3], list((want - got).items())[:3]
    return False, f"spark {sum(got.values())} sql {sum(want.values())} rows; only spark {str(extra)[:700]}; only sql {str(lacking)[:700]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from surveyloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failures = 0
    oracle = oracle_sql()
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                ok, note = compare(df, con, oracle[name])
            else:
                ok, note = True, f"{len(df.collect())} rows, no sql"
        except Exception as fault:  # report and go on with the next query
            ok, note = False, f"{type(fault).__name__}: {str(fault)[:900]}"
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
