"""A stream source that follows files as they grow: SELECT by spark.readStream.format("tail").

Spark's file source sees whole new files only.  An offset here names, for each file, its identity, the bytes that are
done, an epoch and a check of the bytes before; a file that shrinks, is replaced, or whose checked bytes change is
read anew under the next epoch, so that state by (source, epoch) starts afresh.
"""

import json
import logging
import os
import time
import zlib

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.fixed import BACKOFF

ANCHOR = 64  # bytes before the offset that must not change
MOST = 8 << 20  # bytes of a file in one batch


def check(handle, offset):
    start = max(0, offset - ANCHOR)
    handle.seek(start)
    return zlib.crc32(handle.read(offset - start))


class Backoff:
    """When a file that could not be read is tried again: later each time, and not at all once the steps are used up."""

    def __init__(self, steps=BACKOFF, clock=time.monotonic):
        self.steps, self.clock, self.held = steps, clock, {}

    def over(self, path) -> bool:
        return path not in self.held or self.clock() >= self.held[path][1]

    def fine(self, path) -> None:
        self.held.pop(path, None)

    def failed(self, path, why) -> None:
        n = self.held.get(path, (0, 0))[0] + 1
        self.held[path] = (n, self.clock() + self.steps[n - 1] if n <= len(self.steps) else float("inf"))
        logging.getLogger(__name__).warning("%s: %s; %s", path, why, f"tried again in {self.steps[n - 1]} s" if n <= len(self.steps) else "given up")


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, paths, from_start):
        self.paths, self.from_start, self.waits = paths, from_start, Backoff()

    def initialOffset(self):
        out = {}
        for p in self.paths:
            done = 0 if self.from_start or not os.path.exists(p) else os.path.getsize(p)
            out[p] = self.state(p, done, 0, 0)
        return {"files": json.dumps(out, sort_keys=True)}

    @staticmethod
    def state(path, done, line, epoch):
        try:
            with open(path, "rb") as f:
                return [os.fstat(f.fileno()).st_ino, done, line, epoch, check(f, done)]
        except OSError:
            return [0, 0, line, epoch, 0]

    def advance(self, path, state, stop=None):
        """(rows, next state): whole lines behind the offset; a partial last line waits."""
        inode, done, line, epoch, seal = state
        rows = []
        try:
            with open(path, "rb") as f:
                info = os.fstat(f.fileno())
                if inode and (info.st_ino != inode or info.st_size < done or check(f, done) != seal):
                    done, line, epoch = 0, 0, epoch + 1
                f.seek(done)
                data = f.read(MOST if stop is None else max(0, stop - done))
                if stop is None and len(data) == MOST and b"\n" not in data:
                    data += f.readline()  # a line longer than a batch is taken whole
                data = data[: data.rfind(b"\n") + 1]
                for text in data.decode("utf-8", "replace").split("\n")[:-1]:
                    rows.append((path, epoch, line, text.removesuffix("\r")))
                    line += 1
                self.waits.fine(path)
                return rows, [info.st_ino, done + len(data), line, epoch, check(f, done + len(data))]
        except FileNotFoundError:
            return [], state  # it may come, or come back
        except OSError as e:
            if stop is None:
                self.waits.failed(path, e)
            return [], state

    def read(self, start):
        rows, after = [], {}
        for path, state in json.loads(start["files"]).items():
            got, after[path] = self.advance(path, state) if self.waits.over(path) else ([], state)
            rows += got
        return iter(rows), {"files": json.dumps(after, sort_keys=True)}

    def readBetweenOffsets(self, start, end):
        rows, ends = [], json.loads(end["files"])
        for path, state in json.loads(start["files"]).items():
            stop = ends[path]
            again = [state[0], 0, 0, stop[3], 0] if stop[3] != state[3] else state
            got, _ = self.advance(path, [0, *again[1:]] if stop[3] != state[3] else again, stop[1])
            rows += got
        return iter(rows)


class TailSource(DataSource):
    """Options: path (several separated by the path separator), startingOffsets ("earliest" or "latest")."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return "source string, epoch long, line_no long, raw string"

    def simpleStreamReader(self, schema):
        return TailReader(self.options["path"].split(os.pathsep), self.options.get("startingOffsets", "earliest") == "earliest")


def tail(spark, paths, starting="earliest"):
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", os.pathsep.join(paths)).option("startingOffsets", starting).load()
