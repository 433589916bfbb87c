"""Run catalog queries and show schema, count and time: run_spark.py SF_DIR [name ...]"""

import logging
import sys
import time

logging.disable(logging.CRITICAL)
from pyspark.sql import SparkSession

sys.path.insert(0, "/root/repo")
from notespark.plans.catalog import QUERIES  # noqa: E402

spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "12g")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
for name in sys.argv[2:] or QUERIES:
    start = time.time()
    try:
        df = QUERIES[name](spark, sys.argv[1])
        built = time.time() - start
        df._jdf.queryExecution().executedPlan()
        planned = time.time() - start
        rows = df.collect()
        print(f"{name:28} {len(rows):8} rows {built:6.2f} {planned:6.2f} {time.time() - start:6.2f}s", (str(rows[0])[:150] if rows else ""), flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"{name:28} FAILED", str(e)[:600].replace("\n", " "), flush=True)
