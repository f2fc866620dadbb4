"""Side-by-side check of registered queries against their SQL."""

import datetime
import decimal
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def spark_rows(df):
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(row[i]) for i in order) for row in df.collect())


def differences(spark, con, sf_dir, fn, sql, shown=3):
    """Empty list when both sides agree."""
    left_names, left = spark_rows(fn(spark, sf_dir))
    right_names, right = duck_rows(con, sql)
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    if left == right:
        return []
    ours, theirs = set(left) - set(right), set(right) - set(left)
    return [f"rows {len(left)} vs {len(right)}"] + [f"spark {r}" for r in sorted(ours)[:shown]] + [f"sql   {r}" for r in sorted(theirs)[:shown]]


def main(argv):
    from weftline.plans import registry
    from weftline.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls = registry.oracle_sql()
    failed = []
    for name, fn in registry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            if name in sqls:
                bad = [d[:900] for d in differences(spark, con, sf_dir, fn, sqls[name])]
                note = "same" if not bad else "DIFFERENT"
            else:
                note, bad = f"{fn(spark, sf_dir).count()} rows, no SQL", []
        except Exception as problem:  # report and go on with the next query
            note, bad = "ERROR", [str(problem)[:1500]]
        if bad:
            failed.append(name)
        print(f"{name}: {note} {time.time() - began:.1f}s", *bad, sep="\n    ", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv)
