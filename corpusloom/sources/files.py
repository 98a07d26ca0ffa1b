"""One file for each text, made by the tasks that hold the texts."""

from __future__ import annotations

import os
import sys
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext, cloudpickle

# sent by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDERS = 256


def write_each(root: str):
    """Writes ``_text`` (bytes) of each row and a line end below the local folder ``root``; a task that runs again replaces its files."""
    def run(batches):
        task, seen, made = TaskContext.get().partitionId(), Counter(), set()
        for batch in batches:
            for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                missing = not text.is_valid
                folder = f"{root}/missing={str(missing).lower()}/{hash(key) % FOLDERS:03d}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                name = f"doc_id={key}.{seen[key]}.part-{task:05d}.txt"
                seen[key] += 1
                # hidden until it is whole
                with open(hidden := f"{folder}/.{name}.{os.getpid()}", "wb") as f:
                    f.write(b"" if missing else text.as_py())
                    f.write(b"\n")
                os.replace(hidden, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return run
