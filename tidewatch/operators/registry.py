"""Model bundles, and a registry of versions with one champion and one challenger.

A bundle is a folder: the boosted model as Spark saves it, and ``bundle.json``
with its columns, the isolation forest, the calibration's knots, the stacker and
whatever the caller adds. The registry's state is the manifest of the highest
number. A change writes the next number, which must not exist yet, so of two
writers that have read the same state one fails and reads again; a manifest is
whole before it has its name. All files go through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models as md
from . import trees as tr

# The states of a version.
STATUSES = ("champion", "challenger", "archived")
_VERSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


class RegistryError(ValueError):
    """A change that the registry does not allow."""


class Conflict(RegistryError):
    """Another writer was first: read the registry again."""


class _Files:
    """The few file operations that a registry needs, on any file system that Spark can use."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path())] if self.fs.exists(self.path()) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file under a name that is free; False if it is taken. Readers see all of it or nothing."""
        part = f".{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), False)
        out.write(text.encode())
        out.close()
        if not self.fs.exists(self.path(name)) and self.fs.rename(self.path(part), self.path(name)):
            return True
        self.fs.delete(self.path(part), False)
        return False


@dataclass
class Bundle:
    """A boosted model and what belongs to its scores."""

    model: GBTClassificationModel
    columns: list[str]
    forest: dict
    knots: list[float]
    stacker: dict[str, float]
    intercept: float
    about: dict

    def scores(self, df: DataFrame, key: str = "tx_id") -> DataFrame:
        """key, ml_score, anomaly_score of rows with the bundle's columns."""
        p = md.boosted_scores(self.model, df.select(key, *self.columns), self.columns)
        a = md.forest_scores(p.select(key, *self.columns, F.col("p").alias("ml_score")), self.forest, self.columns)
        return a.select(key, "ml_score", md.calibrated(F.col("anomaly"), self.knots).alias("anomaly_score"))

    def stacked(self, df: DataFrame) -> DataFrame:
        """Adds ``stacked`` to rows with the stacker's inputs."""
        return df.withColumn("stacked", md.stacked(self.stacker, self.intercept))

    def paths(self, spark: SparkSession, folder: str) -> list[tr.Path]:
        """The saved model's paths, for attributions."""
        return tr.paths(tr.saved_nodes(spark, f"{folder}/model"))


def save_bundle(bundle: Bundle, folder: str) -> None:
    """Writes a bundle to a folder that does not exist yet; ``bundle.json`` comes last, and a folder without it is no bundle."""
    spark = SparkSession.active()
    files = _Files(spark, folder)
    if files.names():
        raise RegistryError(f"{folder} is there already")
    bundle.model.write().save(f"{folder}/model")
    text = {k: v for k, v in vars(bundle).items() if k != "model"}
    files.write_new("bundle.json", json.dumps(text))


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    files = _Files(spark, folder)
    if "bundle.json" not in files.names():
        raise RegistryError(f"{folder} holds no bundle")
    return Bundle(GBTClassificationModel.load(f"{folder}/model"), **json.loads(files.read("bundle.json")))


class Registry:
    """Versions in one folder. At most one is champion and one challenger; the rest are archived."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = _Files(spark, root)

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self._files.names() if (m := re.fullmatch(r"manifest-(\d{8})\.json", n)))

    def read(self) -> dict:
        """The state now: number, champion, challenger, models by version."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "champion": None, "challenger": None, "models": {}}
        return json.loads(self._files.read(f"manifest-{numbers[-1]:08d}.json"))

    def _write(self, state: dict) -> dict:
        state = {**state, "number": state["number"] + 1}
        if not self._files.write_new(f"manifest-{state['number']:08d}.json", json.dumps(state, ensure_ascii=False)):
            raise Conflict(f"manifest {state['number']} was written by another")
        return state

    def _change(self, change: Callable[[dict], None], state: dict | None) -> dict:
        state = json.loads(json.dumps(self.read() if state is None else state))
        change(state)
        return self._write(state)

    def models(self) -> DataFrame:
        """version, status, created_at, metrics (JSON) of every version."""
        rows = [(v, m["status"], m["created_at"], json.dumps(m["metrics"], sort_keys=True)) for v, m in sorted(self.read()["models"].items())]
        return self.spark.createDataFrame(rows, "version string, status string, created_at string, metrics string")

    def register(self, version: str, bundle: Bundle, metrics: dict, status: str = "challenger", state: dict | None = None) -> dict:
        """Saves a bundle and enters it; ``state`` is the state that the caller has read, if the change rests on it."""
        if not _VERSION.fullmatch(version):
            raise RegistryError(f"no name for a version: {version!r}")
        if status not in STATUSES:
            raise RegistryError(f"no status: {status}")
        save_bundle(bundle, f"{self.root}/{version}")

        def enter(s: dict) -> None:
            s["models"][version] = {"status": "archived", "metrics": metrics, "created_at": datetime.now(UTC).isoformat(timespec="seconds")}
            _set_status(s, version, status)

        return self._change(enter, state)

    def set_status(self, version: str, status: str, state: dict | None = None) -> dict:
        """Champion: the old one is archived. Challenger: likewise, and the champion cannot become one. Archived: it leaves its role."""
        if status not in STATUSES:
            raise RegistryError(f"no status: {status}")
        return self._change(lambda s: _set_status(s, version, status), state)

    def promote(self, version: str, state: dict | None = None) -> dict:
        return self.set_status(version, "champion", state)

    def restore(self, state: dict) -> dict:
        """The roles and versions of an earlier state, as a new one: what undoes a promotion."""
        return self._write({**state, "number": self.read()["number"]})

    def load(self, version: str) -> Bundle:
        return load_bundle(self.spark, f"{self.root}/{version}")

    def load_role(self, role: str) -> Bundle | None:
        """The bundle of ``champion`` or ``challenger``; None where there is none."""
        version = self.read().get(role)
        return None if version is None else self.load(version)


def _set_status(state: dict, version: str, status: str) -> None:
    models = state["models"]
    if version not in models:
        raise RegistryError(f"no version {version}")
    if status == "challenger" and state["champion"] == version:
        raise RegistryError("the champion cannot become the challenger")
    if status in ("champion", "challenger"):
        old = state[status]
        if old and old != version:
            models[old]["status"] = "archived"
        if status == "champion" and state["challenger"] == version:
            state["challenger"] = None
        state[status] = version
    else:
        for role in ("champion", "challenger"):
            if state[role] == version:
                state[role] = None
    models[version]["status"] = status
