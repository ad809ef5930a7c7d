"""Provenance of a run, on the driver: environment, commit, metadata and traces, version checks. Small values, no data.

Traces are plain mappings: `filled` holds them against a list of names, so a misspelt or absent field is an error.
"""

from __future__ import annotations

import platform
import re
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from importlib import metadata
from itertools import zip_longest
from pathlib import Path

from pagemill.functions.hashing import config_hash
from pagemill.sources.sinks import write_json

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "sentencepiece", "tiktoken", "tokenizers")
# fixed values: names in trace files, first those that have to be given, then those that may be
TRACE_NAMES = (("experiment_id", "config"), ("code_version", "split_artifacts", "preprocessing", "metadata"))
SPLIT_NAMES = (("name", "path"), ("sha256", "seed", "dataset_revision", "split_policy"))
PREPROCESSING_NAMES = (("version",), ("transforms", "notes"))


def filled(given: dict, names: tuple[tuple[str, ...], tuple[str, ...]], **defaults: object) -> dict:
    """The mapping with all its names; absent ones read their default or None."""
    must, may = names
    if wrong := sorted(set(given) - {*must, *may} | {n for n in must if given.get(n) is None}):
        raise ValueError(f"unknown or missing fields: {', '.join(wrong)}")
    return {n: defaults.get(n) if given.get(n) is None else given[n] for n in must + may}


def trace(experiment_id: str, config: dict, **more: object) -> dict:
    """What a run was made of, with the hash of its configuration."""
    made = filled({"experiment_id": experiment_id, "config": config} | more, TRACE_NAMES, metadata={}, split_artifacts=[])
    made["split_artifacts"] = [filled(x, SPLIT_NAMES) for x in made["split_artifacts"]]
    if made["preprocessing"] is not None:
        made["preprocessing"] = filled(made["preprocessing"], PREPROCESSING_NAMES, transforms=[])
    return made | {"config_hash": config_hash(config)}


def environment(packages: tuple[str, ...] = PACKAGES) -> dict:
    """Versions of Python, the machine and the packages; None for one that is not installed."""
    installed = {d.name.lower(): d.version for d in metadata.distributions() if d.name}
    return {"python": sys.version, "platform": platform.platform(), "packages": {p: installed.get(p.lower()) for p in packages}}


def _refs(folder: Path) -> Iterator[tuple[str, str]]:
    """(name, commit) of the packed and then of the loose references."""
    packed = folder / "packed-refs"
    for line in packed.read_text().splitlines() if packed.is_file() else []:
        if line[:1] not in "#^":
            commit, _, name = line.partition(" ")
            yield name, commit
    for p in (folder / "refs").rglob("*"):
        if p.is_file():
            yield p.relative_to(folder).as_posix(), p.read_text().strip()


def checked_out(folder: str = ".") -> str | None:
    """The commit that HEAD of the surrounding repository names, read from its files; None outside of one."""
    at = Path(folder).resolve()
    found = next((p / ".git" for p in (at, *at.parents) if (p / ".git" / "HEAD").is_file()), None)
    if found is None:
        return None
    head = (found / "HEAD").read_text().strip()
    return dict(_refs(found)).get(head[5:]) if head.startswith("ref: ") else head


def write_experiment_metadata(folder: str, config: dict, dataset_info: dict, metrics: dict | None = None) -> None:
    seen = environment()
    made = {"created_at": datetime.now(UTC).isoformat(), "git_commit": checked_out(), "runtime": seen, "python": seen["python"], "platform": seen["platform"]}
    write_json(made | {"config": config, "dataset_info": dataset_info, "metrics": metrics or {}}, f"{folder}/metadata.json")


def release(version: str | None) -> list[int]:
    """Leading numbers of a dotted version; what follows them (rc1, +cu118) is left out."""
    found = re.match(r"\s*\d+(?:[.-]\d+)*", version or "")
    return [int(x) for x in re.findall(r"\d+", found[0])] if found else []


def version_within(version: str | None, least: str | None = None, below: str | None = None) -> bool:
    """least <= version < below, either bound optional; absent numbers are 0. An unknown or unreadable version is never within."""
    mine = release(version)
    if not mine:
        return False
    sign = lambda bound: next((a - b for a, b in zip_longest(mine, release(bound), fillvalue=0) if a != b), 0)
    return (least is None or sign(least) >= 0) and (below is None or sign(below) < 0)
