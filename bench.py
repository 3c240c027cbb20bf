"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import random
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphstream.operators import approx, grep
from glyphstream.plans.queries import QUERIES

HEADLINE = ("line_counts", "grep_fixed", "grep_count", "grep_property", "grep_multi", "grep_match", "grep_max_count", "wc", "wc_total", "base64", "utf16", "lz4_round_trip", "bits_match_star", "parens_match", "approx_parts", "top_per_source", "semi_labels", "events_by_hour")


def grep_64(spark, sf_dir):
    """Lines that hold one of 64 words."""
    words = [f"{a}{b}" for a in "theworld" for b in ("a", "e", "i", "o", "un", "er", "st", "al")]
    return grep.count(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", words)


def approx_64(spark, sf_dir):
    """64 patterns of 19 letters within 2 edits over 108,584 bytes."""
    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(108_584))
    patterns = [genome[at : at + 19] for at in rng.sample(range(100_000), 32)] + ["".join(rng.choice("ACGT") for _ in range(19)) for _ in range(32)]
    return approx.approx_find(spark.createDataFrame([(1, genome)], "id int, text string"), "id", "text", patterns, 2)


EXTRA = {"grep_64": grep_64, "approx_64": approx_64}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "2m"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["line_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms up the JVM
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    seconds = {}
    for name in (*HEADLINE, *EXTRA):
        began = time.time()
        (QUERIES | EXTRA)[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    rates = {k: round(size / seconds[k], 1) for k in ("grep_fixed", "grep_count", "grep_property", "grep_multi", "wc", "base64", "utf16", "grep_64")}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "mb_per_s": rates, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
