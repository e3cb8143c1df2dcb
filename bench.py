"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

All forms of the workload must agree before anything is timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from docweave import corpora
    from docweave.plans.infer import infer
    from docweave.plans.layout import laid_out
    from docweave.plans.stores import Flat, Nested, Raw, disagreements
    from docweave.operators.contract import enforced
    from docweave.operators.shred import records, shredded
    from docweave.sources.corpus import from_rows

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}

    def timed(name, f, batches=1):
        """Median over batches; of several, each repeats what it times until it lasts 50 ms."""
        took = []
        for _ in range(batches):
            began, n = time.perf_counter(), 0
            while not n or batches > 1 and time.perf_counter() - began < 0.05:
                out, n = f(), n + 1
            took.append((time.perf_counter() - began) / n)
        seconds[name] = round(statistics.median(took), 4)
        return out

    levels = corpora.CUSTOMERS
    text = corpora.customers(spark, folder).repartition(int(cpus)).cache()
    timed("build_documents", text.count)
    inference = timed("infer", lambda: infer(from_rows(text), corpora.CUSTOMERS_CONFIG))
    layout = laid_out(inference)

    def load_flat():
        typed = records(from_rows(text), layout).persist()
        tables = {n: enforced(df, layout.by_name()[n]).cache() for n, df in shredded(typed, layout).items()}
        for df in tables.values():
            df.agg(*[F.count(f"`{c}`") for c in df.columns]).collect()
        typed.unpersist()
        return tables

    def load_nested():
        df = text.select(F.from_json("value", levels.record()).alias("d")).cache()
        df.agg(F.count("d")).collect()
        return df

    flat = Flat(timed("load_flat", load_flat), levels)
    stores = {"raw": Raw(text, levels), "nested": Nested(timed("load_nested", load_nested), levels), "flat": flat}
    asked = {"document": lambda s: s.document(7), "scan": lambda s: s.scan(3_000_000), "computed": lambda s: s.computed(3_000_000), "by_name": lambda s: s.by_name(), "three_hop": lambda s: s.three_hop("BUILDING")}
    if wrong := disagreements(stores, asked):
        raise SystemExit(f"the stores disagree: {wrong}")
    for store, s in stores.items():
        for name, ask in asked.items():
            timed(f"{name}_{store}", lambda ask=ask, s=s: ask(s).collect(), 5)
    print(json.dumps({"metric": "seconds over all queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
