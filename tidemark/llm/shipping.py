"""Makes this package importable in Python workers, wherever the driver imported it from."""

from __future__ import annotations

import io
import os
import zipfile

from pyarrow.fs import FileSystem
from pyspark.sql import SparkSession

import tidemark
from tidemark.plans.staging import scratch_path

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts are handed to Python workers in batches of at most so many bytes. The JVM and the worker
#: both hold a batch outside the Java heap, in buffers of up to twice its size.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application, and bound batches."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(tidemark.__file__))
    source = io.BytesIO()
    with zipfile.ZipFile(source, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(root)))
    path = f"{scratch_path(spark, 'tidemark-source')}.zip"
    store, place = FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place) as f:
        f.write(source.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
