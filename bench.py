"""Seconds of the reference operators' queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: one JSON line."""

import json
import os
import time

from tallywright.session import session

def main() -> None:
    from tallywright.plans import queries as catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in catalog.QUERIES:
        took = []
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(min(took), 3)
    print(json.dumps({"metric": "seconds of the better of two runs, summed over all queries of the reference's operators", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
