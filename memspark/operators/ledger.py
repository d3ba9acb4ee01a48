"""Hash-chained append-only ledgers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame


def build_chain(events: DataFrame) -> DataFrame:
    """events(run, seq, payload) with `previous` and `hash`: each hash covers the one before it and the payload.

    A run's events are streamed in order from its sorted partition, so a long run needs no more memory than a short one.
    """
    ordered = events.select("run", "seq", "payload").repartition("run").sortWithinPartitions("run", "seq")

    def run(batches):
        at, last = None, ""
        for b in batches:
            previous, hashes = [], []
            for r, payload in zip(b.column("run").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if r != at:
                    at, last = r, ""
                previous.append(last)
                last = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
                hashes.append(last)
            arrays = [*b.columns, pa.array(previous, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["run", "seq", "payload", "previous", "hash"])

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInArrow(run, f"run {kinds['run']}, seq {kinds['seq']}, payload string, previous string, hash string")
