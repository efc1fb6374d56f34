"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillspark") -> SparkSession:
    """Local session with AQE on and the UI off (tests, benches)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture costs several driver round trips per Column call while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be a shared file system; without it this is an error. Only on a
    local master (tests, a laptop) is a fresh local folder made and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quill-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint folder for one written table; the innermost open scope owns it."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if scopes := spark.__dict__.get("_quill_scopes"):
        scopes[-1].paths.append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` as the driver's JVM opens it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(*frames: DataFrame) -> None:
    """Removes the scratch tables that the frames read. For tables of this library that nothing reads any more."""
    for df in frames:
        root = checkpoint_root(df.sparkSession).rstrip("/").replace(":///", ":/", 1)
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.replace(":///", ":/", 1).removeprefix("file:").startswith(root.removeprefix("file:") + "/"):
                fs, p = hadoop_path(df.sparkSession, folder)
                fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


class ScratchScope:
    """Owns the scratch tables made while it is the innermost open scope, and removes them when it closes.

    ``keep(df)`` holds back the tables that ``df`` reads: they go when ``release()`` is called, once the result is no longer
    needed. Tables made outside of any scope stay, as results may read them. Not for several threads of one session.

        with ScratchScope(spark) as scope:
            report = scope.keep(eval_mts_numeric(spark, completions))
        report.show()
        scope.release()
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self._results = spark, [], []

    def __enter__(self) -> "ScratchScope":
        self.spark.__dict__.setdefault("_quill_scopes", []).append(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.__dict__["_quill_scopes"].remove(self)
        needed = set() if error and error[0] else {p for df in self._results for p in self._read_by(df)}
        self._remove([p for p in self.paths if p not in needed])

    def keep(self, df: DataFrame) -> DataFrame:
        self._results.append(df)
        return df

    def release(self) -> None:
        """Removes what was held back for results."""
        self._results = []
        self._remove(list(self.paths))

    def _read_by(self, df: DataFrame) -> list[str]:
        files = [f.replace(":///", ":/", 1) for f in df.inputFiles()]
        plan = df._jdf.queryExecution().analyzed().toString()  # names the folders that tasks read (sources.files.read_in_tasks)
        paths = {p: p.replace(":///", ":/", 1) for p in self.paths}
        return [p for p, q in paths.items() if q in plan or any(f.startswith(q + "/") for f in files)]

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)
            self.paths.remove(path)
