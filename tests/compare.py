"""Run registered queries against their SQL in DuckDB: python tests/compare.py FOLDER [NAME…]."""

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as contract  # noqa: E402


def connect(folder):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([str(r[i]) for i in order] for r in rows))


def differences(spark, db, name, folder):
    """Seconds, row count and the first differing rows of one query."""
    begin = time.time()
    frame = contract.queries()[name](spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - begin
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return seconds, len(ours), []
    result = db.sql(sql)
    if sorted(result.columns) != sorted(frame.columns):
        return seconds, len(ours), [("columns", frame.columns, result.columns)]
    theirs = rows_of(result.columns, result.fetchall())
    if len(ours) != len(theirs):
        return seconds, len(ours), [("rows", len(ours), len(theirs))]
    return seconds, len(ours), [(a, b) for a, b in zip(ours, theirs) if a != b][:3]


def main():
    folder, names = sys.argv[1], sys.argv[2:] or list(contract.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in names:
        try:
            seconds, count, wrong = differences(spark, db, name, folder)
            print(f"{'FAIL' if wrong else 'ok  '} {name} {count} rows {seconds:.1f}s", flush=True)
            for item in wrong:
                print("    ", str(item)[:900])
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name} {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
