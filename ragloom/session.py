"""Session helpers: a local session for tests/bench and the shared work folder.

Library functions never create a session; they take DataFrames. Only tests,
``bench.py`` and tools call :func:`build_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "ragloom", conf: dict | None = None) -> SparkSession:
    """Local session used by tests, bench and tools (not by the library)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("RAGLOOM_DRIVER_MEM", "8g")))
    for k, v in {**BASE_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    The session setting wins. Only when it is unset *and* the master is local
    (tests, bench) a fresh folder under /tmp is taken; on a cluster an unset
    folder is an error, because a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    d = tempfile.mkdtemp(prefix="ragloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``ragloom`` importable in Python workers (``addPyFile``), once per context.

    Tasks run numpy / Arrow code from this package (top-k, MMR, model stages);
    workers must import it wherever the driver was started. Nothing is done
    when the application already ships it (``spark-submit --py-files
    ragloom.zip``). Otherwise the package is zipped into the shared checkpoint
    folder (never a machine-local temporary folder) and added from there.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    shipped = spark.conf.get("spark.submit.pyFiles", "") or ""
    if any(os.path.basename(p.rstrip("/")).startswith("ragloom") for p in shipped.split(",") if p):
        _SHIPPED.add(key)
        return
    import io
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = work_path(spark, "code") + "/ragloom.zip"
    _write_bytes(target, buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(key)


def _write_bytes(uri: str, data: bytes) -> None:
    """Write one file to the shared folder (local path, ``file:`` or a remote URI)."""
    if "://" not in uri or uri.startswith("file:"):
        path = uri[len("file:"):] if uri.startswith("file:") else uri
        path = "/" + path.lstrip("/") if uri.startswith("file:") else path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(data)
        return
    from pyarrow import fs as pafs
    try:
        filesystem, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    except Exception as exc:  # noqa: BLE001
        raise RuntimeError(f"cannot write the code archive to {uri}; ship the package with "
                           "spark-submit --py-files ragloom.zip") from exc
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(data)


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/ragloom-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
