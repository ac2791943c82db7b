"""Saving and loading of model bundles, by versions.

Every save goes to a folder of its own. Its manifest, with the digest of every
file, is written last and appears whole or not at all, so a save that breaks off
leaves the former version current, and a reader never meets a mixture. Old
versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession, functions as F

from riskframe.operators.attrib import Explainer, explainer
from riskframe.operators.calibrate import Calibration
from riskframe.operators.model import FittedModel
from riskframe.operators.prep import FeatureSpec, RareLevelJoin
from riskframe.operators.score import Bundle

SCHEMA = (
    "numeric array<string>, categorical array<string>, constant array<string>, names array<string>, "
    "method string, slope double, offset double, threshold double, level double, labels array<string>, "
    "base double, means array<double>"
)


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path: (path, its file system)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """Digest of every file of a version, read by the executors; one row per file comes back."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.sha2("content", 256).alias("digest")).collect()
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return {r["path"].split(f"/{name}/", 1)[1]: r["digest"] for r in rows}


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions, oldest first."""
    place, files = _files(spark, f"{path}/manifests")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> str:
    """Add a version under ``path``; returns its name."""
    now = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%fZ")
    version = f"{now}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/versions/{version}"
    _write_version(spark, bundle, folder)
    _publish(spark, path, version, _digests(spark, folder))
    return version


def _publish(spark: SparkSession, path: str, version: str, digests: dict[str, str]) -> None:
    draft, files = _files(spark, f"{path}/manifests/.{version}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "files": digests}, sort_keys=True).encode()))
    out.close()
    if not files.rename(draft, _files(spark, f"{path}/manifests/{version}.json")[0]):
        raise OSError(f"could not publish version {version} of {path}")


def _write_version(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Model, calibration curve and one row of parameters under ``path``."""
    stages = []
    for i, stage in enumerate(bundle.model.stages.stages):
        if isinstance(stage, RareLevelJoin):  # its level table moves into the bundle
            kept = f"{path}/rare/{i}"
            spark.read.parquet(stage.getOrDefault(stage.path)).write.parquet(kept)
            stage = stage.copy({stage.path: kept})
        stages.append(stage)
    PipelineModel(stages).write().save(f"{path}/model")
    if bundle.calibration.curve is not None:
        bundle.calibration.curve.write().save(f"{path}/curve")
    spec, means = bundle.model.spec, bundle.explain.means
    row = (
        spec.numeric,
        spec.categorical,
        spec.constant,
        bundle.model.names,
        bundle.calibration.method,
        bundle.calibration.slope,
        bundle.calibration.offset,
        float(bundle.threshold),
        float(bundle.level),
        list(bundle.labels),
        float(bundle.explain.base),
        None if means is None else [float(v) for v in means],
    )
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{path}/params")


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The bundle of a version (the latest without one), after its files' digests were compared."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete version {version or ''} of a bundle at {path}")
    version = version or known[-1]
    manifest = json.loads(spark.read.text(f"{path}/manifests/{version}.json", wholetext=True).first()[0])
    path = f"{path}/versions/{version}"
    if _digests(spark, path) != manifest["files"]:
        raise ValueError(f"the files of {path} are not those of its manifest")
    row = spark.read.schema(SCHEMA).parquet(f"{path}/params").first()
    spec = FeatureSpec(list(row["numeric"]), list(row["categorical"]), list(row["constant"]))
    model = FittedModel(spec, list(row["names"]), PipelineModel.load(f"{path}/model"))
    curve = IsotonicRegressionModel.load(f"{path}/curve") if row["method"] == "isotonic" else None
    clf = model.classifier
    if isinstance(clf, LogisticRegressionModel):
        explain = Explainer(model.names, row["base"], clf.coefficients.toArray(), np.array(row["means"]))
    else:
        explain = explainer(model)
    return Bundle(
        model,
        Calibration(row["method"], row["slope"], row["offset"], curve),
        row["threshold"],
        row["level"],
        explain,
        list(row["labels"]),
    )
