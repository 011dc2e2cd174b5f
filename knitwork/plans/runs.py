"""Runs on disk: a manifest that says what is done, and resuming that refuses what has changed."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MARKER = "run.json"


@dataclass
class Run:
    """A folder of stage tables with its manifest. The manifest is a small file beside them, on a file
    system that the driver shares; tables are Parquet, written whole or not at all."""

    spark: SparkSession
    root: str
    run_id: str
    hashes: dict[str, str | None]
    done: list[str] = field(default_factory=list)
    status: str = "running"
    stage: str | None = None

    @property
    def path(self) -> Path:
        return Path(self.root) / MARKER

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        text = json.dumps({"run_id": self.run_id, "hashes": self.hashes, "done": self.done, "status": self.status, "stage": self.stage}, indent=2, sort_keys=True)
        self.path.write_text(text, encoding="utf-8")

    def complete(self, name: str) -> bool:
        """Listed as done, and its table is there."""
        return name in self.done and (Path(self.root) / name / "_SUCCESS").exists()

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read if complete, else made, written and read."""
        where = f"{self.root}/{name}"
        if not self.complete(name):
            self.stage, self.status = name, "running"
            self.save()
            df = make()
            df.write.mode("overwrite").parquet(where)
            self.done = [*[x for x in self.done if x != name], name]
            self.stage = None
            self.save()
            return self.spark.read.schema(df.schema).parquet(where)
        return self.spark.read.parquet(where)

    def finish(self) -> None:
        self.status, self.stage = "complete", None
        self.save()


def open_run(spark: SparkSession, root: str, run_id: str, hashes: dict[str, str | None], resume: bool = False) -> Run:
    """A new run, or the one in ``root``: whose id and hashes (those that are given) must be the same."""
    if not resume:
        run = Run(spark, root, run_id, dict(hashes))
        run.save()
        return run
    path = Path(root) / MARKER
    if not path.exists():
        raise ValueError(f"nothing to resume in {root}")
    found = json.loads(path.read_text(encoding="utf-8"))
    if found["run_id"] != run_id:
        raise ValueError("the run has another id")
    changed = [k for k, v in hashes.items() if v is not None and found["hashes"].get(k) != v]
    if changed:
        raise ValueError(f"not resumed, as these have changed: {', '.join(sorted(changed))}")
    return Run(spark, root, run_id, found["hashes"], found["done"], found["status"] if found["status"] == "complete" else "running")
