"""Experiments: guarded arguments, isolated run folders with a status, manifests, provenance, the collected tables.

The driver keeps a few JSON files a run; metrics come from tables. Defined results: a run that raises is recorded as
failed with its message and raises again; repeated seeds, unknown models and settings that aren't positive raise before
anything is written; an empty experiment collects to empty tables.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidegraph.operators.records import paired_delta, seed_summary
from tidegraph.sources.sinks import markdown_table, run_directory, stable_json, write_json

#: The models of both tracks.
MODELS = ("prior", "numeric", "graph", "text", "time", "fixed_fusion", "global_fusion", "adaptive_fusion")
RUN = "run_id string, track string, model string, seed int, metric double"


def run_id(track: str, model: str, seed: int, at: datetime | None = None) -> str:
    """<track>-<model>-s<seed>-<UTC time>: the ids of one seed sort by time."""
    at = at or datetime.now(timezone.utc)
    return f"{track}-{model}-s{seed}-{at.strftime('%Y%m%dT%H%M%S%f')}"


def check_arguments(model: str, fanouts: tuple[int, ...] = (10, 5), n_layers: int = 2, n_train: int = 1, n_validation: int = 1, **numbers: int) -> None:
    """Raise unless the model is known, all numbers are positive integers, both roles have labelled rows, and each layer has a positive fanout."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    for k, v in numbers.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValueError(f"{k} must be a positive integer")
    if n_train < 1 or n_validation < 1:
        raise ValueError("train and validation need labelled rows")
    if len(fanouts) != n_layers or any(f < 1 for f in fanouts):
        raise ValueError("one positive fanout a layer is needed")


def provenance(raw: str | None, manifest: str | None) -> dict:
    """The hash of the raw file where it is there, else the one recorded in a manifest, else unavailable."""
    if raw and Path(raw).is_file():
        digest = hashlib.sha256()
        with open(raw, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        return {"source": "file", "sha256": digest.hexdigest()}
    if manifest and Path(manifest).is_file():
        got = json.loads(Path(manifest).read_text()).get("sha256")
        if got:
            return {"source": "manifest", "sha256": got}
    return {"source": "unavailable", "sha256": None}


def run_manifest(spark: SparkSession, config: dict, seed: int, encoder: str, inputs: dict) -> dict:
    """What a run depends on: configuration and its hash, seed, versions, encoder, hashes of inputs."""
    return {"config": config, "config_sha256": hashlib.sha256(stable_json(config).encode()).hexdigest(), "seed": seed, "encoder": encoder, "inputs": inputs, "versions": {"spark": spark.version, "python": platform.python_version()}}


def experiment(root: str, track: str, models: list[str], seeds: list[int], train: Callable[[str, int, bool], float], smoke: bool = False) -> list[dict]:
    """Train each model with each seed in its own folder; train(model, seed, smoke) gives the metric.

    experiment.json says running, complete or failed. smoke: one seed, and training is told to cap its epochs.
    """
    if len(set(seeds)) != len(seeds) or not seeds:
        raise ValueError("seeds must be distinct")
    for m in models:
        check_arguments(m)
    run_directory(root)
    state = {"track": track, "models": models, "seeds": seeds[:1] if smoke else seeds, "smoke": smoke, "status": "running", "runs": []}
    try:
        for m in models:
            for s in state["seeds"]:
                write_json(state, f"{root}/experiment.json")
                name = run_id(track, m, s)
                folder = run_directory(f"{root}/{name}")
                done = {"run_id": name, "track": track, "model": m, "seed": s, "metric": train(m, s, smoke)}
                write_json(done, f"{folder}/summary.json")
                state["runs"].append(done)
    except Exception as e:
        write_json(state | {"status": "failed", "error": str(e)}, f"{root}/experiment.json")
        raise
    write_json(state | {"status": "complete"}, f"{root}/experiment.json")
    return state["runs"]


def dry_run(root: str, models: list[str], train: Callable[[str, int, bool], float]) -> list[dict]:
    """Every model once, with capped epochs."""
    return experiment(root, "dry", models, [0], train, smoke=True)


def collected(runs: DataFrame, metric: str = "metric", pairs: tuple[tuple[str, str], ...] = ()) -> str:
    """Markdown of the latest runs: mean and deviation by model, and paired differences of models."""
    rows = seed_summary(runs, metric).orderBy("track", "model").collect()  # a row a model
    parts = [markdown_table(["track", "model", "seeds", "mean", "sd"], [tuple(r) for r in rows])]
    for a, b in pairs:
        parts.append(markdown_table(["track", "pairs", f"{a} - {b}", "sd"], [tuple(r) for r in paired_delta(runs, metric, a, b).collect()]))
    return "\n\n".join(parts)


