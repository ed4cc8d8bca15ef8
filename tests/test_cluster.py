"""What only shows where executors are processes of their own: rows that are fetched from several of them come in any order."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from wideleaf.dialect import results

conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "512m", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": sys.argv[1]}
spark = SparkSession.builder.master("local-cluster[3,1,1024]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
result = spark.range(4000, numPartitions=12).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("v")).orderBy("k")
want = [r.asDict() for r in result.collect()]
rows = lambda *a, **b: [r for x in results.stream(result, *a, **b) for r in x.rows()]
wrong = [] if rows() == want else [0]
for place in (300, 1777, 4000):
    found = list(results.stream(result, b"%d" % place, size=1 << 10))
    if [r for x in found for r in x.rows()] != want[place:] or found and found[-1].token != b"4000":
        wrong.append(place)
print("wrong:", wrong, flush=True)
spark.stop()
"""


def test_results_resume_on_executors(tmp_path):
    top = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=top, capture_output=True, text=True, timeout=300)
    assert done.stdout.splitlines()[-1:] == ["wrong: []"], done.stdout + done.stderr[-2000:]
