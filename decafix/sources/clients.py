"""Client descriptions (as a TOML table would hold them) and the batch or stream they stand for."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decafix.sources import generators, scans
from decafix.streaming import paced


@dataclass(frozen=True)
class Client:
    """kind: file, uniform, normal or another of ``generators.distribution`` (with mean and std as its parameters). amount: rows at most, None for no end. interval_s: pause between batches."""

    kind: str
    amount: int | None = None
    run_s: float | None = None
    interval_s: float = 0.0
    path: str | None = None
    skip: int = 0
    delim: str = ","
    mean: float = 0.0
    std: float = 1.0
    low: float = 0.0
    high: float = 1.0
    seed: int = 0

    def batch(self, spark: SparkSession) -> DataFrame:
        """All rows, ``amount`` of them if given."""
        if self.kind == "file":
            rows = scans.csv_floats(spark, self.path, self.skip, self.delim)
            return rows if self.amount is None else rows.limit(self.amount)
        if self.amount is None:
            raise ValueError("a generated batch needs an amount; use the stream for one without end")
        if self.kind == "normal":
            return generators.normal(spark, self.amount, self.mean, self.std, self.seed)
        if self.kind == "uniform":
            return generators.uniform(spark, self.amount, self.low, self.high, self.seed)
        return generators.distribution(spark, self.amount, self.kind, self.mean, self.std, self.seed)

    def stream(self, spark: SparkSession, per_second: int = 1000) -> DataFrame:
        if self.kind == "file":
            return paced.text_source(spark, self.path, self.skip, self.delim)
        if self.kind == "normal":
            return paced.rate_source(spark, per_second, self.mean, self.std)
        if self.kind == "uniform":
            rows = paced.rate_source(spark, per_second)
            u = F.pmod(F.xxhash64("pos", F.lit(self.seed)), F.lit(2**53)) / float(2**53)
            return rows.withColumn("x", F.lit(self.low) + u * F.lit(self.high - self.low))
        raise ValueError(f"no stream of kind {self.kind!r}")

    def run(self, spark: SparkSession, out: str, checkpoint: str) -> int:
        """Streams into Parquet under ``out``, a batch each ``interval_s``, until ``amount`` rows are taken or ``run_s`` seconds have passed; a file client without either stops when
        all that is there has been read. Whole batches are taken, so there may be some more rows than ``amount``. Returns the rows taken."""
        writer = self.stream(spark).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        if self.kind == "file" and self.amount is None and self.run_s is None:
            q = writer.trigger(availableNow=True).start()
            q.awaitTermination()
            return sum(p["numInputRows"] for p in q.recentProgress)
        return paced.run_bounded(writer.trigger(processingTime=f"{self.interval_s} seconds").start(), self.amount, self.run_s)


def described(spec: dict) -> Client:
    """A client from either form of table: flat, by this class's fields; or type ("file" or "gen"), gen_type, amount, run_period and frequency (each sec and nano_sec), and params (path, skip, delim; mean, std; low, high)."""
    if "type" not in spec:
        return Client(**spec)
    names = {"frequency": "interval_s", "run_period": "run_s", "file": "path", "skip_val": "skip", "max": "high", "min": "low", "std_dev": "std"}
    flat = {names.get(k, k): v for k, v in {**{k: v for k, v in spec.items() if k not in ("type", "gen_type", "params")}, **spec.get("params", {})}.items()}
    kind = "file" if spec["type"].lower() == "file" else spec["gen_type"].lower()
    flat = {k: v.get("sec", 0) + v.get("nano_sec", 0) / 1e9 if isinstance(v, dict) else v for k, v in flat.items()}
    known = {f.name for f in fields(Client)}
    return Client(kind=kind, **{k: v for k, v in flat.items() if k in known})


def load(path: str) -> dict[str, Client]:
    """Clients by name from a TOML file's [clients.*] tables."""
    return {name: described(spec) for name, spec in tomllib.loads(Path(path).read_text()).get("clients", {}).items()}
