"""What a session needs to run the library's Python tasks anywhere."""

from __future__ import annotations

import os
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that tasks import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._newsloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None):
        return spark.conf.get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write down and go on from there, in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Dealt anew in turn where a scan has fewer tasks than there are cores, as with one small file of heavy rows; a large table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


class Progress:
    """Tells a hook how far the jobs of a run's stages are: (stage, tasks done, tasks known so far).

    A stage is a job group of Spark's own, whose tasks the status tracker counts; a thread asks now and then, and once more when
    the stage ends. Without a hook nothing is asked. The hook's own failures do not stop the run.
    """

    def __init__(self, spark: SparkSession, hook: Callable[[str, int, int], None] | None, every: float = 0.5):
        self.context, self.hook, self.every = spark.sparkContext, hook, every

    def _count(self, group: str) -> tuple[int, int, bool]:
        """Tasks done and known, and whether all jobs have ended; stages that an ended job passed over are none of its tasks."""
        tracker, done, known, ended = self.context.statusTracker(), 0, 0, True
        for job in tracker.getJobIdsForGroup(group):
            if info := tracker.getJobInfo(job):
                over = info.status != "RUNNING"
                ended &= over
                for tasks in filter(None, map(tracker.getStageInfo, info.stageIds)):
                    if tasks.numCompletedTasks or not over:
                        done, known = done + tasks.numCompletedTasks, known + tasks.numTasks
        return done, known, ended

    def _tell(self, name: str, group: str, last: bool = False) -> None:
        try:
            for _ in range(20 if last else 1):  # the tracker hears of an end a little later
                done, known, ended = self._count(group)
                if ended or not last:
                    break
                time.sleep(0.05)
            self.hook(name, done, known)
        except Exception:  # of the caller's hook
            self.hook = lambda *_: None

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Jobs that this thread starts inside belong to the stage; a job group around it holds again afterwards."""
        if self.hook is None:
            yield
            return
        keys = ("spark.jobGroup.id", "spark.job.description")
        before = [self.context.getLocalProperty(k) for k in keys]
        group, ended = f"{name}-{uuid.uuid4().hex}", threading.Event()
        self.context.setJobGroup(group, name)

        def watch() -> None:
            while not ended.wait(self.every):
                self._tell(name, group)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            ended.set()
            watcher.join()
            for k, v in zip(keys, before, strict=True):
                self.context.setLocalProperty(k, v)
            self._tell(name, group, last=True)
