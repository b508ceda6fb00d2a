"""Per-query plan summary: shuffles, broadcasts, Python stages, Spark jobs and time.

    python -m tests.plan_report [sf_dir]

Counts come from the final adaptive plan of one execution (noop sink).
"""

from __future__ import annotations

import re
import sys
import time


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from sightings.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = build_session("local[8]")
    sc = spark.sparkContext
    print("| query | shuffles | broadcasts | python | jobs | sec |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in E.queries().items():
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t0
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", final))
        bcast = final.count("BroadcastExchange")
        py = len(re.findall(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython", final))
        print(f"| {name} | {shuffles} | {bcast} | {py} | {jobs} | {sec:.2f} |", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
