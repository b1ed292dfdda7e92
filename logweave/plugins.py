"""Stages, exporters and sources that users add."""

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class StageError(RuntimeError):
    """A stage failed; no row is passed on silently."""


def run_stages(entries: DataFrame, stages, context=None, sample: int = 5) -> DataFrame:
    """Applies stages (DataFrame, context) -> DataFrame in order, each tried on a few rows first.

    A stage that fails fails the job: executors cannot agree to skip it from some row on.
    """
    for stage in stages:
        try:
            stage(entries.limit(sample), context).collect()
        except Exception as e:
            raise StageError(f"{getattr(stage, '__name__', stage)}: {e}") from e
        entries = stage(entries, context)
    return entries


def by_row(function, schema):
    """A stage from a function of one row's dict to a dict, or None to drop the row; it runs in Arrow batches."""

    def stage(entries, context=None):
        names = list(entries.columns)

        def run(frames):
            import pandas as pd

            for frame in frames:
                out = [r for r in (function(dict(zip(names, row))) for row in frame.itertuples(index=False, name=None)) if r is not None]
                yield pd.DataFrame(out, columns=names)

        return entries.mapInPandas(run, schema or entries.schema)

    return stage


@dataclass
class Registry:
    """Named stages, exporters and sources, with the last errors of those that could not be added."""

    api: tuple = (1, 0)
    stages: dict = field(default_factory=dict)
    exporters: dict = field(default_factory=dict)
    sources: dict = field(default_factory=dict)
    errors: deque = field(default_factory=lambda: deque(maxlen=50))
    disabled: set = field(default_factory=set)

    def add(self, kind: str, name: str, thing, needs: tuple = (1, 0)) -> bool:
        """Adds a part unless its name is taken or it needs another major version or a later minor one."""
        held = getattr(self, kind)
        if name in held:
            self.errors.append((name, "the name is taken"))
        elif needs[0] != self.api[0] or needs[1] > self.api[1]:
            self.errors.append((name, f"needs version {needs[0]}.{needs[1]}"))
        else:
            held[name] = thing
            return True
        return False

    def disable(self, name: str, reason: str) -> None:
        self.disabled.add(name)
        self.errors.append((name, reason))

    def source(self, name: str):
        if name not in self.sources or name in self.disabled:
            raise StageError(f"{name}: no such source")
        return self.sources[name]

    def exporter(self, name: str):
        """An exporter (entries, path) by name, or None."""
        return None if name in self.disabled else self.exporters.get(name)

    def run(self, name: str, part, *args):
        """Calls a part; one that fails is disabled, and the failure passed on."""
        try:
            return part(*args)
        except Exception as e:
            self.disable(name, str(e))
            raise StageError(f"{name}: {e}") from e

    def apply(self, entries: DataFrame, context=None) -> DataFrame:
        for name, stage in self.stages.items():
            if name not in self.disabled:
                entries = run_stages(entries, [stage], context)
        return entries
