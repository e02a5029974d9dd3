"""A tree of tasks that yield DataFrames: run in order, repeated over parameters, skipped where their output exists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Task:
    name: str
    run: Callable[[Project], DataFrame | None]
    skip_existing: bool = False
    enabled: bool = True
    children: list[Task] = field(default_factory=list)


@dataclass
class Repeat:
    """Runs its children once for each row of parameters, which become attributes of the project."""

    name: str
    parameters: Callable[[Project], Sequence[Mapping]]
    children: list[Task] = field(default_factory=list)


class Project:
    """Holds parameters (as attributes), the results by task name, and the output folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.root: list[Task | Repeat] = []
        self.results: dict[str, DataFrame] = {}
        self.log: list[str] = []

    def add_task(self, run: Callable[[Project], DataFrame | None], name: str | None = None, parent: Task | Repeat | None = None, skip_existing: bool = False) -> Task:
        task = Task(name or run.__name__, run, skip_existing)
        (parent.children if parent else self.root).append(task)
        return task

    def add_iterator(self, parameters: Callable[[Project], Sequence[Mapping]], name: str, parent: Task | None = None) -> Repeat:
        node = Repeat(name, parameters)
        (parent.children if parent else self.root).append(node)
        return node

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def execute(self) -> Project:
        self._run(self.root, "")
        return self

    def _run(self, nodes: Sequence[Task | Repeat], prefix: str) -> None:
        for node in nodes:
            if isinstance(node, Repeat):
                for i, values in enumerate(node.parameters(self)):
                    for k, v in values.items():
                        setattr(self, k, v)
                    self._run(node.children, f"{prefix}{node.name}-{i}/")
                continue
            if not node.enabled:
                continue
            name = prefix + node.name
            path = self.path(name)
            if node.skip_existing and self._exists(path):
                self.log.append(f"skipped {name}")
            elif (out := node.run(self)) is not None:
                out.write.mode("overwrite").parquet(path)
                self.log.append(f"ran {name}")
            else:
                self.log.append(f"ran {name}")
                self._run(node.children, f"{name}/")
                continue
            self.results[name] = self.spark.read.parquet(path)
            self._run(node.children, f"{name}/")
