"""Job and stage times of one catalogue query, from Spark's event log (no UI, no server).

usage: python tools/stages.py <query> [sf_dir] [cores]

The event log goes to a fresh ``mktemp`` folder under /tmp; the query runs once to warm
up and once measured (job group "measured"), fully executed into the ``noop`` sink.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(folder: str):
    for f in sorted(glob.glob(os.path.join(folder, "*", "events_*")) + glob.glob(os.path.join(folder, "*.zstd"))):
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard

                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                stream = io.TextIOWrapper(fh, encoding="utf-8")
            for line in stream:
                yield json.loads(line)


def main():
    name = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    cores = sys.argv[3] if len(sys.argv) > 3 else "8"
    evd = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cores)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", evd)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from textpairs.plans.catalogue import QUERIES

    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("measured", name)
    t0 = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    wall = time.time() - t0
    spark.stop()

    jobs, stages = {}, {}
    for e in read_events(evd):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            props = e.get("Properties", {})
            jobs[e["Job ID"]] = {
                "start": e["Submission Time"],
                "group": props.get("spark.jobGroup.id"),
                "stages": e["Stage IDs"],
                "site": (props.get("callSite.short") or "")[:70],
            }
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si.get("Completion Time", 0) - si.get("Submission Time", 0), si["Number of Tasks"], si["Stage Name"][:60])
    print(f"{name}: wall {wall:.2f}s")
    for j, d in sorted(jobs.items()):
        if d["group"] != "measured":
            continue
        print(f"  job {j:4d} {d.get('end', d['start']) - d['start']:7d} ms  {d['site']}")
        for s in d["stages"]:
            if s in stages:
                ms, tasks, sname = stages[s]
                print(f"       stage {s:4d} {ms:7d} ms  tasks={tasks:4d}  {sname}")


if __name__ == "__main__":
    main()
