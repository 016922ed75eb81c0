"""Suites of storage trials: a document that names a dataset, engines, queries and results, run with resume.

    {"name": "floats", "dataset": {"name": "lineitem", "column": "l_discount"}, "parquet": {"codec": ["zstd", "snappy"]},
     "queries": {"full_scan": true, "range": [0.1], "in": [[0.05, 3]]}, "results": {"rounds": 10, "baseline": "..."}}

Samples are kept in a store of Parquet parts, one for each run, with the version of their layout; a run
takes only the samples that the store lacks.  ``python -m profilark.plans.suite run|report|compare|clean``
works on suites from the shell.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilark.plans import predicates, storage

ENGINES = storage.FORMATS
REQUIRED = ("name", "dataset", "queries", "results")
KNOWN = {
    "dataset": {"name", "path", "column", "rows"},
    "queries": {"full_scan", "range", "in", "seed"},
    "results": {"rounds", "baseline", "seed", "confidence"},
    **{e: set(storage.AXES) - {"format"} for e in ENGINES},
}
#: Layout of the store; a part of another version is not read.
VERSION = 2
SAMPLES = "version int, run string, suite string, variant string, query string, round int, seconds double, cpu_seconds double, load double"


@dataclass(frozen=True)
class Suite:
    name: str
    dataset: dict
    engines: dict[str, dict]
    queries: dict
    results: dict = field(default_factory=dict)

    @property
    def rounds(self) -> int:
        return int(self.results.get("rounds", 10))


def parse(text: str | dict) -> Suite:
    """A suite from JSON (or YAML, where that module is at hand) or a dictionary; unknown keys are errors."""
    doc = text
    if isinstance(text, str):
        try:
            doc = json.loads(text)
        except json.JSONDecodeError:
            try:
                import yaml
            except ImportError:
                raise ValueError("the suite is not JSON, and YAML can't be read here") from None
            doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ValueError("a suite is a mapping")
    if missing := [k for k in REQUIRED if k not in doc]:
        raise ValueError(f"missing blocks: {missing}")
    engines = {k: dict(doc[k] or {}) for k in ENGINES if k in doc}
    if not engines:
        raise ValueError(f"one engine block at least: {list(ENGINES)}")
    if unknown := set(doc) - set(REQUIRED) - set(ENGINES):
        raise ValueError(f"unknown blocks: {sorted(unknown)}")
    for block, keys in KNOWN.items():
        own = engines.get(block) if block in ENGINES else doc.get(block)
        if own is None:
            continue
        if not isinstance(own, dict):
            raise ValueError(f"{block} is a mapping")
        if unknown := set(own) - keys:
            raise ValueError(f"{block}: unknown keys {sorted(unknown)}")
    data = doc["dataset"]
    if "column" not in data or ("name" in data) == ("path" in data):
        raise ValueError("dataset: a column, and either a name or a path")
    for share in doc["queries"].get("range", []):
        if not 0 < share <= 1:
            raise ValueError("queries.range: shares above 0, at most 1")
    for pair in doc["queries"].get("in", []):
        if len(pair) != 2 or not 0 < pair[0] <= 1 or pair[1] < 1:
            raise ValueError("queries.in: pairs of a share and a number of values")
    if not any(doc["queries"].get(k) for k in ("full_scan", "range", "in")):
        raise ValueError("queries: none")
    if int(doc["results"].get("rounds", 10)) < 1:
        raise ValueError("results.rounds: 1 at least")
    return Suite(doc["name"], dict(data), engines, dict(doc["queries"]), dict(doc["results"]))


def cells(suite: Suite, column_type: str) -> tuple[list[storage.Variant], list[tuple[storage.Variant, str]]]:
    """The variants of all engine blocks, and those that can't be built with their reasons."""
    good, bad = [], []
    for engine, axes in suite.engines.items():
        a, b = storage.grid(column_type, {"format": [engine], **{k: v if isinstance(v, list) else [v] for k, v in axes.items()}})
        good += a
        bad += b
    return good, bad


def label(v: storage.Variant) -> str:
    return "/".join(f"{k}={x}" for k, x in asdict(v).items())


def queries(suite: Suite, df: DataFrame) -> list[predicates.Query]:
    c, seed = suite.dataset["column"], int(suite.queries.get("seed", 0))
    out = [predicates.Query("full_scan", c)] if suite.queries.get("full_scan") else []
    out += [predicates.choose_range(df, c, share, seed) for share in suite.queries.get("range", [])]
    return out + [predicates.choose_in(df, c, share, n) for share, n in suite.queries.get("in", [])]


def filter_where(report: DataFrame, conditions: list[str]) -> DataFrame:
    """The rows of a report whose variant has these axis=value pairs."""
    for c in conditions:
        axis, sep, value = c.partition("=")
        if not sep or axis not in storage.AXES:
            raise ValueError(f"{c!r}: an axis of {list(storage.AXES)}, =, a value")
        report = report.where(F.array_contains(F.split("variant", "/"), f"{axis}={value}"))
    return report


def quietness() -> float:
    """Running processes a processor: above 1, timings compete."""
    return os.getloadavg()[0] / (os.cpu_count() or 1)


class Store:
    """Samples as Parquet parts under one folder, each written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(f"{self.path}/samples")

    def samples(self, suite: str | None = None) -> DataFrame:
        from profilark.functions.cluster import exists

        if not exists(self.spark, f"{self.path}/samples"):
            return self.spark.createDataFrame([], SAMPLES)
        got = self.spark.read.schema(SAMPLES).parquet(f"{self.path}/samples").where(F.col("version") == VERSION)
        return got if suite is None else got.where(F.col("suite") == suite)

    def held(self, suite: str) -> dict[tuple[str, str], int]:
        """How many samples there are of each (variant, query)."""
        return {(r["variant"], r["query"]): r["n"] for r in self.samples(suite).groupBy("variant", "query").agg(F.count("*").alias("n")).collect()}

    def drift(self) -> int:
        """Samples of other versions, which are not read."""
        from profilark.functions.cluster import exists

        return self.spark.read.schema(SAMPLES).parquet(f"{self.path}/samples").where(F.col("version") != VERSION).count() if exists(self.spark, f"{self.path}/samples") else 0


def run(spark: SparkSession, suite: Suite, df: DataFrame, store: Store, folder: str, more: int = 0) -> int:
    """Write the variants, run the rounds that are missing (and ``more``), keep the samples; returns how many were taken.

    In each round every missing (variant, query) runs once, in seeded shuffled order, after an untimed warm-up.
    """
    import random

    good, _ = cells(suite, df.schema[suite.dataset["column"]].dataType.simpleString())
    asked = {q.id(): q for q in queries(suite, df)}
    held = store.held(suite.name)
    todo = {(v, q): max(0, suite.rounds - held.get((label(v), q), 0)) + more for v in good for q in asked}
    todo = {k: n for k, n in todo.items() if n}
    frames = {}
    for v in dict.fromkeys(v for v, _ in todo):
        path = storage.write(df, suite.dataset["column"], v, f"{folder.rstrip('/')}/{uuid.uuid5(uuid.NAMESPACE_OID, label(v)).hex}")
        frames[v] = spark.read.format(v.format).load(path)
    own = lambda q: predicates.Query(q.kind, "v", q.values, q.operator)
    for v, q in todo:
        predicates.run(frames[v], own(asked[q])).collect()
    r, taken, token = random.Random(int(suite.results.get("seed", 0))), 0, uuid.uuid4().hex
    for k in range(max(todo.values(), default=0)):
        turn = [x for x, n in todo.items() if n > k]
        r.shuffle(turn)
        rows = []
        for v, q in turn:
            began, cpu = time.perf_counter(), time.process_time()
            predicates.run(frames[v], own(asked[q])).collect()
            rows.append((VERSION, token, suite.name, label(v), q, held.get((label(v), q), 0) + k, time.perf_counter() - began, time.process_time() - cpu, quietness()))
        store.append(rows)  # a round is kept whole: a run that breaks off goes on with the next
        taken += len(rows)
    return taken


def export(recommended: DataFrame, dataset: str, folder: str, rounds: int = 10) -> list[str]:
    """A suite for each recommended column: its type against the one that it has; returns the files' paths."""
    from profilark.plans.recommend import spark_type

    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for r in recommended.select("column", "dtype", "type").collect():
        if r["type"] is None or r["type"].startswith(("list", "struct", "fixed", "null")):
            continue
        types = list(dict.fromkeys([spark_type(r["type"]), r["dtype"]]))
        doc = {"name": f"{dataset}-{r['column']}", "dataset": {"name": dataset, "column": r["column"]}, "parquet": {"type": types, "codec": ["zstd", "snappy"]}, "queries": {"full_scan": True}, "results": {"rounds": rounds}}
        parse(doc)
        path = Path(folder) / f"{dataset}-{r['column']}.json"
        path.write_text(json.dumps(doc, indent=1))
        out.append(str(path))
    return out


def clocks_disagree(samples: DataFrame, factor: float = 1.5) -> DataFrame:
    """``variant, query``: pairs of a query's variants that one clock orders against the other by more than the factor."""
    stats = samples.groupBy("variant", "query").agg(F.median("seconds").alias("wall"), F.median("cpu_seconds").alias("cpu"))
    best = stats.groupBy("query").agg(F.min("wall").alias("least_wall"), F.min("cpu").alias("least_cpu"))
    ratio = (F.col("wall") / F.col("least_wall")) / F.nullif(F.col("cpu") / F.nullif(F.col("least_cpu"), F.lit(0.0)), F.lit(0.0))
    return stats.join(F.broadcast(best), "query").where((ratio > factor) | (ratio < 1 / factor)).select("variant", "query", "wall", "cpu")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="profilark.plans.suite", description="Storage trials.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "report", "compare", "clean", "datasets"):
        own = commands.add_parser(name)
        if name in ("run", "report", "clean"):
            own.add_argument("suite", help="a suite's file")
        if name == "compare":
            own.add_argument("stores", nargs=2)
        if name != "compare":
            own.add_argument("--store", default="suite-store")
        if name == "run":
            own.add_argument("--samples-add", type=int, default=0)
            own.add_argument("--tables", default=None, help="folder of the standard tables")
        if name == "report":
            own.add_argument("--where", action="append", default=[])
    args = parser.parse_args(argv)
    from profilark.sources import datasets

    if args.command == "datasets":
        print("\n".join(datasets.names()))
        return 0
    spark = spark or SparkSession.builder.appName("suite").getOrCreate()
    if args.command == "compare":
        from profilark.plans.evaluate import compare

        a, b = (Store(spark, s).samples().groupBy("suite", "variant", "query").agg(F.median("seconds").alias("seconds")) for s in args.stores)
        compare(a, b, ["suite", "variant", "query"], "seconds").orderBy("suite", "variant", "query").show(1000, truncate=False)
        return 0
    suite, store = parse(Path(args.suite).read_text()), Store(spark, args.store)
    if args.command == "run":
        df = datasets.load(spark, suite.dataset.get("name") or suite.dataset["path"], args.tables)
        print(run(spark, suite, df, store, f"{args.store}/variants/{suite.name}", args.samples_add), "samples")
    elif args.command == "report":
        samples = store.samples(suite.name)
        got = samples.groupBy("variant", "query").agg(F.count("*").alias("n"), *(F.expr(f"percentile(seconds, {p})").alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)), F.max("load").alias("load"))
        filter_where(got, args.where).orderBy("query", "p50").show(1000, truncate=False)
        if old := store.drift():
            print(f"{old} samples of other versions left out", file=sys.stderr)
    else:
        from profilark.functions.cluster import remove

        remove(spark, f"{args.store}/variants/{suite.name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
