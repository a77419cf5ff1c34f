"""Counters, gauges and histograms of a store, as text in the Prometheus exposition format."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds: 5 microseconds doubling 14 times, and 1 doubling 12 times.
SECONDS_BUCKETS = tuple(5e-6 * 2**k for k in range(14))
SIZE_BUCKETS = tuple(float(2**k) for k in range(12))


class Metrics:
    """Does nothing unless enabled."""

    def __init__(self, enabled: bool = False, namespace: str = "keelson"):
        self.enabled, self.namespace, self._lock = enabled, namespace, threading.Lock()
        self._counters: dict[tuple, float] = defaultdict(float)
        self._histograms: dict[tuple, list] = {}
        self._gauges: dict[str, Callable[[], float]] = {}

    @staticmethod
    def _labels(labels: dict) -> tuple:
        return tuple(sorted(labels.items()))

    def count(self, name: str, n: float = 1, **labels) -> None:
        if self.enabled:
            with self._lock:
                self._counters[name, self._labels(labels)] += n

    def observe(self, name: str, value: float, buckets: tuple[float, ...] = SECONDS_BUCKETS, **labels) -> None:
        if self.enabled:
            with self._lock:
                h = self._histograms.setdefault((name, self._labels(labels)), [buckets, [0] * (len(buckets) + 1), 0.0])
                h[1][bisect_left(h[0], value)] += 1
                h[2] += value

    def gauge(self, name: str, read: Callable[[], float]) -> None:
        if self.enabled:
            self._gauges[name] = read

    @contextmanager
    def timed(self, op: str):
        """Counts and times an operation; the block may set the result in the dict that it gets."""
        start, told = time.perf_counter(), {"result": "ok"}
        try:
            yield told
        except Exception:
            told["result"] = "error"
            raise
        finally:
            self.count("ops_total", op=op, result=told["result"])
            self.observe("op_duration_seconds", time.perf_counter() - start, op=op)

    def value(self, name: str, **labels) -> float:
        return self._counters.get((name, self._labels(labels)), 0.0)

    def exposition(self) -> str:
        line = lambda name, labels, v: f"{self.namespace}_{name}" + ("{" + ",".join(f'{k}="{x}"' for k, x in labels) + "}" if labels else "") + f" {v:g}"
        out, typed = [], set()

        def kind(name: str, what: str) -> None:
            if name not in typed:
                typed.add(name)
                out.append(f"# TYPE {self.namespace}_{name} {what}")

        with self._lock:
            for (name, labels), v in sorted(self._counters.items()):
                kind(name, "counter")
                out.append(line(name, labels, v))
            for (name, labels), (buckets, counts, total) in sorted(self._histograms.items()):
                kind(name, "histogram")
                below = 0
                for bound, n in zip([*buckets, float("inf")], counts, strict=True):
                    below += n
                    out.append(line(f"{name}_bucket", (*labels, ("le", "+Inf" if bound == float("inf") else f"{bound:g}")), below))
                out += [line(f"{name}_sum", labels, total), line(f"{name}_count", labels, below)]
            for name, read in sorted(self._gauges.items()):
                kind(name, "gauge")
                out.append(line(name, (), read()))
        return "\n".join(out) + "\n" if out else ""


def exponential_bucket(value: Column, buckets: int = len(SIZE_BUCKETS)) -> Column:
    """The number of the first power of two that is at least the value, within the buckets."""
    k = F.ceil(F.log2(F.greatest(value, F.lit(1.0)))).cast("int")
    return F.greatest(F.lit(0), F.least(k, F.lit(buckets - 1)))


def bucket_counts(df: DataFrame, column: str, buckets: int = len(SIZE_BUCKETS)) -> DataFrame:
    """(bucket, n) over a column; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(exponential_bucket(F.col(column), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
