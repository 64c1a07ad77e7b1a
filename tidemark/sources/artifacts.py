"""Content-addressed artifacts: written once under their digest, verified on every read."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 1 << 30


def put(root: str, data: bytes, media_type: str) -> dict:
    """Stores bytes under their digest and gives the reference; the same bytes again change nothing."""
    if len(data) > MOST_BYTES:
        raise ValueError("the artifact is too large")
    digest = hashlib.sha256(data).hexdigest()
    target = Path(root, digest[:2], digest)
    target.parent.mkdir(parents=True, exist_ok=True)
    if not target.exists():
        handle, draft = tempfile.mkstemp(dir=target.parent)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            pass
        finally:
            os.unlink(draft)
    return {"sha256": digest, "size_bytes": len(data), "media_type": media_type}


def get(root: str, ref: dict) -> bytes:
    data = Path(root, ref["sha256"][:2], ref["sha256"]).read_bytes()
    if len(data) != ref["size_bytes"] or hashlib.sha256(data).hexdigest() != ref["sha256"]:
        raise ValueError("the artifact does not match its reference")
    return data


def verify(spark: SparkSession, root: str, refs: DataFrame) -> DataFrame:
    """refs (sha256, size_bytes) with status: verified, missing, or mismatch. Files are read where they lie, by executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("sha256"), F.sha2("content", 256).alias("_digest"), F.col("length").alias("_length"))
    joined = refs.join(found, "sha256", "left")
    right = (F.col("_digest") == F.col("sha256")) & (F.col("_length") == F.col("size_bytes"))
    return joined.withColumn("status", F.when(F.col("_digest").isNull(), "missing").when(right, "verified").otherwise("mismatch")).drop("_digest", "_length")


def permitted(datasets: DataFrame, operation: str, at) -> DataFrame:
    """datasets (permitted_uses array, expires_at) whose rights cover the operation at the instant."""
    return datasets.filter(F.array_contains("permitted_uses", operation) & (F.col("expires_at").isNull() | (F.lit(at) < F.col("expires_at"))))


def admission(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared (object, sha256, rows) against actual objects: (object, status) missing, undeclared, changed, rows, admitted."""
    d = declared.select("object", F.col("sha256").alias("ds"), F.col("rows").alias("dr"), F.lit(True).alias("d"))
    a = actual.select("object", F.col("sha256").alias("as"), F.col("rows").alias("ar"), F.lit(True).alias("a"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "undeclared").when(~F.col("ds").eqNullSafe(F.col("as")), "changed").when(~F.col("dr").eqNullSafe(F.col("ar")), "rows")
    return d.join(a, "object", "full").select("object", F.coalesce(status, F.lit("admitted")).alias("status"))
