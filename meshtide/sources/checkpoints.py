"""Checkpoints of a coded state: two generations in turn, each complete only with its manifest.

A checkpoint carries a *signature* of everything it must be read with.  A state whose positions and
velocities belong to different times is marked so, and refuses to be exported.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meshtide.config import Geometry
from meshtide.sources import store

GENERATIONS = 2


@dataclass(frozen=True)
class Schedule:
    """Coefficients of every step, and the steps after which a snapshot is due."""

    coefficients: tuple[tuple[float, ...], ...]
    snapshots: frozenset[int] = frozenset()

    def signature(self, g: Geometry) -> str:
        """One digest of geometry, coefficients (exact, as hexadecimal floats) and snapshot steps."""
        parts = {
            "geometry": g.fingerprint_fields(),
            "coefficients": [[float(v).hex() for v in row] for row in self.coefficients],
            "snapshots": sorted(self.snapshots),
        }
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Checkpoint:
    """Where a complete generation lies, and what its manifest says."""

    path: str
    generation: int
    step: int
    aligned: bool  # positions and velocities share one time
    signature: str
    details: dict


def aligned(step: int, schedule: Schedule) -> bool:
    return step in schedule.snapshots or step >= len(schedule.coefficients)


def write(coded: DataFrame, scales: DataFrame, g: Geometry, folder: str, step: int, schedule: Schedule,
          details: dict | None = None) -> Checkpoint:
    """Overwrite the older generation; the newer one stays readable until the manifest is in place."""
    last = newest(coded.sparkSession, folder)
    generation = 0 if last is None else (last.generation + 1) % GENERATIONS
    made = Checkpoint(f"{folder}/gen{generation}", generation, step, aligned(step, schedule), schedule.signature(g), details or {})
    store.write_state(coded, scales, g, made.path, {
        "kind": "checkpoint", "step": step, "aligned": made.aligned, "signature": made.signature, "details": made.details})
    return made


def newest(spark: SparkSession, folder: str) -> Checkpoint | None:
    """The complete generation with the highest step."""
    found = []
    for generation in range(GENERATIONS):
        path = f"{folder}/gen{generation}"
        about = (store.try_manifest(spark, path) or {}).get("provenance", {})
        if about.get("kind") == "checkpoint":
            found.append(Checkpoint(path, generation, int(about["step"]), bool(about["aligned"]), about["signature"], about["details"]))
    return max(found, key=lambda c: c.step, default=None)


def load(spark: SparkSession, folder: str, g: Geometry, schedule: Schedule) -> tuple[DataFrame, DataFrame, Checkpoint]:
    """The newest state, if it was written under the same geometry and schedule."""
    last = newest(spark, folder)
    if last is None:
        raise FileNotFoundError(f"{folder} holds no complete checkpoint")
    if last.signature != schedule.signature(g):
        raise ValueError(f"{last.path} was written under another configuration")
    coded, scales, _ = store.load_state(spark, last.path, g)
    return coded, scales, last


def require_aligned(provenance: dict) -> None:
    """Refuse the provenance of a checkpoint taken between two times."""
    if provenance.get("kind") == "checkpoint" and not provenance.get("aligned"):
        raise ValueError("positions are half a step ahead of velocities; export a snapshot or the final state")
