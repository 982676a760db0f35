"""Input size estimates from public APIs (no job is run).

Used to size partitions and to choose between physical forms: the number of
tasks a scan of a DataFrame will run, from ``DataFrame.inputFiles()``, the
sizes of a sample of those files and ``spark.sql.files.maxPartitionBytes``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def _bytes_conf(value: str) -> int:
    v = value.strip().lower()
    for suffix, mult in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("tb", 1 << 40),
                         ("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30), ("t", 1 << 40), ("b", 1)):
        if v.endswith(suffix):
            return int(float(v[: -len(suffix)]) * mult)
    return int(v)


SIZE_SAMPLE_FILES = 64


def _file_sizes(uris: list[str]) -> list[int] | None:
    """Sizes of files given as URIs (local, ``file:``, s3/s3a, gs, hdfs), via ``pyarrow.fs``."""
    from urllib.parse import urlparse

    from pyarrow import fs as pafs
    first = urlparse(uris[0])
    scheme = first.scheme or "file"
    base = f"{'s3' if scheme == 's3a' else scheme}://{first.netloc}" if scheme != "file" else "file:///"
    filesystem, _ = pafs.FileSystem.from_uri(base)

    def path(u: str) -> str:
        pu = urlparse(u)
        return pu.netloc + pu.path if scheme in ("s3", "s3a", "gs", "gcs") else pu.path

    infos = filesystem.get_file_info([path(u) for u in uris])
    sizes = [i.size for i in infos]
    return None if any(sz is None for sz in sizes) else sizes


def scan_tasks(df: DataFrame) -> int | None:
    """Tasks a scan of ``df`` will run, estimated from its input files (no job).

    ``inputFiles()`` lists the files; the sizes of at most ``SIZE_SAMPLE_FILES``
    of them, scaled to the file count, over ``spark.sql.files.maxPartitionBytes``
    give the task count. None when unknown (plans over checkpointed RDDs have
    no input files); the merge then stays one level.
    """
    try:
        files = df.inputFiles()
        if not files:
            return None
        step = max(1, len(files) // SIZE_SAMPLE_FILES)
        sample = files[::step][:SIZE_SAMPLE_FILES]
        sizes = _file_sizes(sample)
        mpb = _bytes_conf(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    except Exception:  # noqa: BLE001 - the estimate is advisory
        return None
    if not sizes or mpb <= 0:
        return None
    total = sum(sizes) / len(sizes) * len(files)
    return max(len(files) if total > 0 else 1, math.ceil(total / mpb))
