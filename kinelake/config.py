"""Configuration: session and trial TOML files merged, with typed access to the operators' options."""

from __future__ import annotations

import copy
import tomllib
from pathlib import Path

NAME = "Config.toml"


def merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; nested tables are merged, other values replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def trial_configs(source: str | dict) -> list[dict]:
    """One configuration for each trial below a folder, or for a single trial folder or dictionary.

    A trial's own file overrides that of the folder above; trials that
    ``project.exclude_from_batch`` names are left out.  ``project.project_dir``
    is the trial's folder.
    """
    if isinstance(source, dict):
        return [merge({"project": {"project_dir": "."}}, source)]
    root = Path(source)
    found = sorted(root.rglob(NAME))
    if not found:
        raise FileNotFoundError(f"no {NAME} below {root}")
    load = lambda p: tomllib.loads(p.read_text(encoding="utf-8"))
    trials = [p for p in found if p.parent != root]
    if not trials:
        above = root.resolve().parent / NAME
        own = load(root / NAME)
        return [_placed(merge(load(above), own) if above.exists() else own, root)]
    session = load(root / NAME) if (root / NAME).exists() else {}
    excluded = session.get("project", {}).get("exclude_from_batch", [])
    return [_placed(merge(session, load(p)), p.parent) for p in trials if p.parent.name not in excluded]


def _placed(config: dict, folder: Path) -> dict:
    return merge(config, {"project": {"project_dir": str(folder)}})


def option(config: dict, *names: str, default=None):
    """The first of several dotted names that is set; options have moved between sections over time."""
    for name in names:
        at = config
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            return at
    return default


def frame_rate(config: dict) -> float:
    rate = option(config, "project.frame_rate", default="auto")
    return 30.0 if rate == "auto" else float(rate)


def frame_bounds(config: dict) -> tuple[int | None, int | None]:
    """First and last frame, both included; None where the data decide."""
    bounds = option(config, "project.frame_range", default=[])
    return (int(bounds[0]), int(bounds[1])) if isinstance(bounds, list) and len(bounds) == 2 else (None, None)


def participant(config: dict, person: int = 0, measured: float | None = None) -> tuple[float, float]:
    """Height and mass of a person: configured, else measured, else 1.7 m and 70 kg."""
    pick = lambda v: v[min(person, len(v) - 1)] if isinstance(v, list) and v else v
    height, mass = (pick(option(config, f"project.participant_{n}")) for n in ("height", "mass"))
    height = measured if height in (None, "auto", []) else float(height)
    return height or 1.7, 70.0 if mass in (None, "auto", []) else float(mass)
