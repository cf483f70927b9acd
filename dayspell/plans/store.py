"""Intermediate tables of a long build: written once, found again by the next run.

A table counts as built when the manifest lists it, and it is listed only after all of it is written and its
checks have passed. A build that was interrupted, or refused its input, leaves at most an unlisted folder behind;
the next run builds that table again and reads the others.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession

MANIFEST = "name string, key string, path string, facts string, turn int"


def shared_folder(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="dayspell-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: for a table that several parts of one plan read, where
    each would otherwise scan and build it again."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(*parts: object) -> str:
    """A key of rules and inputs; a DataFrame stands for its schema and the files it reads."""
    told = [(p.schema.simpleString(), sorted(p.inputFiles())) if isinstance(p, DataFrame) else repr(p) for p in parts]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Held:
    """One listed table and what was observed while it was written."""

    key: str
    path: str
    facts: Mapping[str, str | None]


class Store:
    """Tables by name under one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/") if folder else f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        self.built: list[str] = []  # names written by this object, in order
        self.listed = self._read()

    def _read(self) -> dict[str, Held]:
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest").orderBy("turn").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []  # one row per table of the build
        self.turns = len(rows)
        return {r["name"]: Held(r["key"], r["path"], json.loads(r["facts"])) for r in rows}

    def holds(self, name: str, key: str) -> bool:
        return name in self.listed and self.listed[name].key == key

    def table(self, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table `name`, built now unless it is listed under the same key."""
        if not self.holds(name, key):
            self.write(name, key, build())
        return self.spark.read.parquet(self.listed[name].path)

    def write(self, name: str, key: str, df: DataFrame, observed: Observation | None = None,
              check: Callable[[Mapping[str, object]], None] | None = None) -> Held:
        """Write and list a table. Metrics of `observed` are kept beside it; `check` may refuse them."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        metrics = dict(observed.get) if observed is not None else {}
        if check is not None:
            check(metrics)
        facts = {k: v.hex() if isinstance(v, (bytes, bytearray)) else v if v is None else str(v) for k, v in metrics.items()}
        self.turns += 1
        entry = self.spark.createDataFrame([(name, key, path, json.dumps(facts), self.turns)], MANIFEST)
        entry.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        self.listed[name] = Held(key, path, facts)
        self.built.append(name)
        return self.listed[name]

    def facts(self, name: str) -> Mapping[str, str | None]:
        return self.listed[name].facts


def observed(df: DataFrame, metrics: Sequence[Column]) -> tuple[DataFrame, Observation]:
    """`df` with metrics that the action over it computes on the way."""
    watch = Observation()
    return df.observe(watch, *metrics), watch
