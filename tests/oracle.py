"""Compare registered queries with their SQL: python tests/oracle.py SF_DIR [name...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def normal(frame):
    def cell(x):
        if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
            return None
        if isinstance(x, float):
            return round(x, 6) + 0.0
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return bool(x)
        return int(x) if type(x).__name__.startswith(("int", "uint")) else str(x)

    names = sorted(frame.columns)
    return names, sorted((tuple(cell(x) for x in row) for row in frame[names].itertuples(index=False)), key=str)


def compare(spark, sf_dir, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{where}')")
    return normal(query(spark, sf_dir).toPandas()), normal(con.execute(sql).df())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(os.environ.get("ORACLE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sorted(sql):
        began = time.time()
        try:
            got, expected = compare(spark, sys.argv[1], name, queries[name], sql[name])
            same = got == expected
            print("OK  " if same else "DIFF", name, len(got[1]), f"{time.time() - began:.1f}s", flush=True)
            if not same:
                print("  ", got[0], expected[0], len(expected[1]))
                left = [x for x in got[1] if x not in set(expected[1])][:2]
                right = [x for x in expected[1] if x not in set(got[1])][:2]
                print("   spark ", left, "\n   duckdb", right)
        except Exception as e:
            print("FAIL", name, str(e)[:700].replace("\n", " "), flush=True)
