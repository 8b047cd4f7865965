"""Times the build of the stored graph and warm questions on it. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import mapping as m
from remitgraph.operators import load, profile, requests, retrieve, validate
from remitgraph.plans.staging import shared_folder, stage
from remitgraph.session import configure
from remitgraph.sources import store

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
A, B = "Corporation #1", "Corporation #2"


def session() -> SparkSession:
    builder = configure(SparkSession.builder.master(f"local[{CPUS}]").appName("bench"))
    # Small data on one machine: as many partitions as cores, and small ones.
    spark = (builder.config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}

    def timed(name: str, action, runs: int = RUNS) -> None:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            action()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)

    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    built: dict[str, object] = {}

    def build(at: str) -> None:
        built["graph"] = store.write_graph(m.graph(spark, D), f"{folder}/{at}", buckets=16, derive_edges=True)

    build("first")  # warms the JVM, like the first run of every question below
    timed("build_and_store", lambda: build("second"), 1)
    graph = built["graph"]
    asked = stage(m.requests(spark, D), "requests")
    some = asked.filter(F.pmod(F.xxhash64("request_id"), F.lit(15)) == 0)
    questions = {
        "q1_entity_relationship": lambda: retrieve.entity_relationship(graph, A, B),
        "q2_entity_laundering": lambda: retrieve.entity_laundering(graph, A),
        "q3_top_laundering_senders": lambda: retrieve.top_laundering_senders(graph, 5),
        "q4_subject_transactions": lambda: retrieve.subject_transactions(graph, A),
        "q5_pair_transactions": lambda: retrieve.pair_transactions(graph, A, B),
        "q6_top_senders_simple": lambda: retrieve.top_senders_simple(graph, 5),
        "q7_transaction_paths": lambda: retrieve.transaction_paths(graph),
        "q8_entity_count": lambda: retrieve.entity_count(graph),
        "q9_about_100_requests": lambda: requests.answer_requests(graph, some),
        "q9_1566_requests": lambda: requests.answer_requests(graph, asked),
        "v10_transaction_summary": lambda: validate.transaction_summary(graph.transactions),
        "v14_relationship_summary": lambda: validate.relationship_summary(graph),
        "v15_missing_endpoints": lambda: validate.missing_endpoints(graph),
        "l9_graph_counts": lambda: load.graph_counts(graph),
        "f4_numeric_summary": lambda: profile.numeric_summary(graph.transactions, ["amount_paid", "amount_received"]),
    }
    for name, question in questions.items():
        run(question())
        timed(name, lambda q=question: run(q()))
    print(json.dumps({
        "metric": "graph questions, warm, and build of the stored graph",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(D.rstrip("/")), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
