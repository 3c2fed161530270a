"""Dependency manifests and lockfiles as rows: declared packages, locked packages, and edges between them."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import BadInput, MissingDependency, NotFound

# Files by ecosystem in order of preference, groups for development, sections of package.json.
MANIFESTS = {"pypi": ("pyproject.toml", "requirements.txt", "Pipfile"), "npm": ("package.json",)}
LOCKFILES = {"pypi": ("poetry.lock", "uv.lock", "Pipfile.lock"), "npm": ("package-lock.json", "pnpm-lock.yaml", "yarn.lock")}
DEV_GROUPS = ("dev", "test", "tests", "lint", "docs")
SECTIONS = (("dependencies", False, False), ("devDependencies", True, False), ("peerDependencies", False, False), ("optionalDependencies", False, True))
REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*(.*)$")

Declared = tuple[str, str | None, bool, bool]  # name, constraint, dev, optional
Locked = tuple[str, str | None, bool, bool]  # name, version, dev, optional
DECLARED = "ecosystem string, ord int, name string, constraint string, dev boolean, optional boolean"
LOCK = "ecosystem string, ord int, name string, version string, dev boolean, optional boolean"
EDGES = "ecosystem string, ord int, parent string, child string"


def requirement(spec: str, dev: bool = False, optional: bool = False) -> Declared | None:
    """A requirement's name and constraint; extras stay with the constraint, markers go."""
    m = REQUIREMENT.match(spec.partition(";")[0].strip())
    return (m[1], ((m[2] or "") + m[3]).strip() or None, dev, optional) if m else None


def requirements(text: str, include: Callable[[str], str | None] = lambda _: None, depth: int = 0) -> tuple[list[Declared], list[str]]:
    """Packages and notes of a requirements file. include gives an included file's text; includes nest once."""
    out: list[Declared] = []
    notes: list[str] = []
    for line in (raw.partition(" #")[0].strip() for raw in text.splitlines()):
        if m := re.match(r"(?:-r|--requirement)\s+(.+)", line):
            other = include(m[1].strip()) if depth < 1 else None
            if depth >= 1:
                notes.append(f"{m[1]} is included by an included file; not read")
            elif other is None:
                notes.append(f"{m[1]} is included but not there")
            else:
                more, said = requirements(other, include, depth + 1)
                out, notes = out + more, [*notes, f"{m[1]} is included", *said]
        elif line and line[0] not in "#-":
            if re.match(r"(git|hg|svn|bzr)\+", line) or "://" in line.partition(";")[0]:
                egg = re.search(r"#egg=([^&\s;]+)", line)
                out += [(egg[1], line.partition(";")[0].rstrip(), False, False)] if egg else []
            elif found := requirement(line):
                out.append(found)
    return out, notes


def pyproject(text: str) -> list[Declared]:
    data = tomllib.loads(text)
    project, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
    specs = [(s, False, False) for s in project.get("dependencies", [])]
    specs += [(s, g in DEV_GROUPS, True) for g, own in (project.get("optional-dependencies") or {}).items() for s in own]
    out = [d for s, dev, optional in specs if (d := requirement(s, dev, optional))]
    tables = [(poetry.get("dependencies"), False), (poetry.get("dev-dependencies"), True)]
    tables += [(g.get("dependencies"), name in DEV_GROUPS) for name, g in (poetry.get("group") or {}).items() if isinstance(g, dict)]
    for own, dev in tables:
        for name, value in (own or {}).items():
            if dev or name.lower() != "python":
                out.append((name, value if isinstance(value, str) else value.get("version") if isinstance(value, dict) else None, dev, False))
    return out


def pipfile(text: str) -> list[Declared]:
    data, out = tomllib.loads(text), []
    for section, dev in (("packages", False), ("dev-packages", True)):
        for name, value in (data.get(section) or {}).items():
            out.append((name, value if isinstance(value, str) else value.get("version") if isinstance(value, dict) else None, dev, False))
    return out


def package_json(text: str) -> list[Declared]:
    data = json.loads(text)
    return [(n, None if v is None else str(v), dev, opt) for s, dev, opt in SECTIONS if isinstance(data.get(s), dict) for n, v in data[s].items()]


def toml_lock(text: str) -> tuple[list[Locked], list[tuple[str, str]]]:
    """poetry.lock and uv.lock: packages, whose dependencies are a table of names or a list of tables with names."""
    packages = [p for p in tomllib.loads(text).get("package", []) if p.get("name")]
    rows = [(p["name"], p.get("version"), p.get("category", "main") in ("dev", "test"), bool(p.get("optional", False))) for p in packages]
    edges = []
    for p in packages:
        own = p.get("dependencies") or {}
        names = list(own) if isinstance(own, dict) else [d.get("name", "") for d in own if isinstance(d, dict)]
        edges += [(p["name"], n) for n in names]
    return rows, edges


def pipfile_lock(text: str) -> tuple[list[Locked], list[tuple[str, str]]]:
    data, rows = json.loads(text), []
    for section, dev in (("default", False), ("develop", True)):
        for name, value in (data.get(section) or {}).items():
            version = (value.get("version") or "") if isinstance(value, dict) else ""
            rows.append((name, version.removeprefix("==") or None, dev, False))
    return rows, []


def package_lock(text: str) -> tuple[list[Locked], list[tuple[str, str]]]:
    """package-lock.json: paths of modules (later ones overwrite), or the older nested tree."""
    data = json.loads(text)
    if isinstance(data.get("packages"), dict) and data.get("lockfileVersion", 1) >= 2:
        name_of = lambda key: key.rpartition("node_modules/")[2] or "<root>"
        own = {k: v for k, v in data["packages"].items() if isinstance(v, dict)}
        rows = [(name_of(k), v.get("version"), bool(v.get("dev")), bool(v.get("optional"))) for k, v in own.items() if k]
        return rows, [(name_of(k), child) for k, v in own.items() for child in (v.get("dependencies") or {})]
    rows, edges, todo = [], [], [(None, data.get("dependencies") or {})]
    while todo:
        parent, level = todo.pop(0)
        for name, v in level.items():
            if isinstance(v, dict):
                rows.append((name, v.get("version"), bool(v.get("dev")), bool(v.get("optional"))))
                edges += [(parent, name)] if parent else []
                todo += [(name, v["dependencies"])] if isinstance(v.get("dependencies"), dict) else []
    return rows, edges


def pnpm_key(key: str) -> tuple[str, str | None]:
    """Name and version of a pnpm key such as /@scope/name@1.2.3(peer@4)."""
    bare = key.removeprefix("/").partition("(")[0]
    name, at, version = bare.rpartition("@")
    return (name, version) if at and name else (bare, None)


def pnpm_lock(text: str) -> tuple[list[Locked], list[tuple[str, str]]]:
    try:
        import yaml
    except ImportError as e:
        raise MissingDependency("pyyaml", "pnpm-lock.yaml") from e
    packages = (yaml.safe_load(text) or {}).get("packages") or {}
    rows, edges = [], []
    for key, entry in packages.items():
        (name, version), own = pnpm_key(str(key)), entry if isinstance(entry, dict) else {}
        if name:
            rows.append((name, version or own.get("version"), bool(own.get("dev")), bool(own.get("optional"))))
            edges += [(name, child) for child in (own.get("dependencies") or {})]
    return rows, edges


READ_DECLARED = {"pyproject.toml": pyproject, "Pipfile": pipfile, "package.json": package_json}
READ_LOCK = {
    "poetry.lock": toml_lock, "uv.lock": toml_lock, "Pipfile.lock": pipfile_lock, "package-lock.json": package_lock, "pnpm-lock.yaml": pnpm_lock
}


def discover(root: Path) -> dict[str, tuple[Path | None, Path | None]]:
    """The preferred manifest and lockfile of each ecosystem at a folder's top, or of a single file's ecosystem."""
    first = lambda names: next((root / n for n in names if (root / n).is_file()), None)
    if root.is_file():
        for eco in MANIFESTS:
            if root.name in MANIFESTS[eco]:
                return {eco: (root, discover(root.parent).get(eco, (None, None))[1])}
            if root.name in LOCKFILES[eco]:
                return {eco: (None, root)}
        raise BadInput(f"{root.name} is no manifest or lockfile that can be read")
    found = {eco: (first(MANIFESTS[eco]), first(LOCKFILES[eco])) for eco in MANIFESTS}
    found = {eco: pair for eco, pair in found.items() if any(pair)}
    if not found:
        raise NotFound(f"no manifest or lockfile in {root}")
    return found


def read_project(spark: SparkSession, root: str | Path) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """declared, lock and edges of a project folder, and notes. Manifests are small; each is read once on the driver."""
    declared, lock, edges, notes = [], [], [], []
    for eco, (manifest, locked) in discover(Path(root)).items():
        if manifest is not None:
            text = manifest.read_text(encoding="utf-8", errors="replace")
            if manifest.name in READ_DECLARED:
                rows = _parsed(READ_DECLARED[manifest.name], text, manifest)
            else:
                at = lambda name, base=manifest.parent: (base / name).read_text(errors="replace") if (base / name).is_file() else None
                rows, said = requirements(text, at)
                notes += said
            declared += [(eco, k, *r) for k, r in enumerate(rows)]
        if locked is not None and locked.name in READ_LOCK:
            rows, pairs = _parsed(READ_LOCK[locked.name], locked.read_text(encoding="utf-8", errors="replace"), locked)
            lock += [(eco, k, *r) for k, r in enumerate(rows)]
            edges += [(eco, k, *p) for k, p in enumerate(pairs)]
        elif locked is not None:
            notes.append(f"{locked.name} isn't parsed; only direct dependencies are listed")
        else:
            notes.append(f"No lockfile for {eco}; versions aren't resolved")
    return spark.createDataFrame(declared, DECLARED), spark.createDataFrame(lock, LOCK), spark.createDataFrame(edges, EDGES), notes


def _parsed(parse: Callable, text: str, path: Path):
    try:
        return parse(text)
    except (ValueError, AttributeError, TypeError) as e:
        raise BadInput(f"Failed to parse {path}: {e}") from e


def versions_behind(pairs: Iterator[tuple[str | None, str | None]]) -> Iterator[bool | None]:
    """Whether each resolved version is older than the latest; null where either is missing."""
    for resolved, latest in pairs:
        yield None if not resolved or not latest else resolved != latest and version_key(resolved) < version_key(latest)


def version_key(version: str):
    """A key that sorts versions: as Python's packaging has it, else by numbers before any pre-release."""
    try:
        from packaging.version import InvalidVersion, Version

        try:
            return (1, Version(version.lstrip("v")))
        except InvalidVersion:
            pass
    except ImportError:
        pass
    parts = version.removeprefix("v").partition("-")[0].split(".")
    return (0, [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in parts])
