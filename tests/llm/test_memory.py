import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from tenura.llm.common import held, map_batches


def resident() -> int:
    """MB of this process."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


def test_batches_are_bounded_in_bytes(spark):
    """Ten thousand rows of long texts were one batch, which a task holds several times."""
    docs = spark.range(10_000, numPartitions=1).selectExpr("repeat('x', 4000) AS text")
    rows = map_batches(docs, lambda b: pa.RecordBatch.from_pylist([{"rows": b.num_rows, "size": b.nbytes}]), "rows long, size long").collect()
    assert sum(r["rows"] for r in rows) == 10_000
    assert max(r["size"] for r in rows) < 8e6


def test_workers_give_memory_back(spark):
    """What a task freed stayed with its worker, beside what later tasks of the executor took."""

    def measure(fill):
        def run(batch):
            before = resident()
            if fill:
                small = [np.ones(5000) for _ in range(4000)]  # 160 MB in pieces that malloc keeps
                kept = held(("memory", os.getpid()), lambda: small[399::400])  # the last of them too
                del small
                return pa.RecordBatch.from_pylist([{"pid": os.getpid(), "mb": before, "n": len(kept)}])
            return pa.RecordBatch.from_pylist([{"pid": os.getpid(), "mb": before, "n": 0}])

        return {r["pid"]: r["mb"] for r in map_batches(spark.range(8, numPartitions=8), run, "pid long, mb long, n long").collect()}

    before = measure(False)
    filled = measure(True)
    after = measure(False)
    both = [p for p in after if p in before and p in filled]
    assert both
    assert all(after[p] - before[p] < 80 for p in both)
