"""The catalog of skills: folders of user skills and plugins, and built-in commands."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell import schemas

#: Names of the built-in commands and what they do.
BUILTIN = (
    ("clear", "Clear the conversation's context."),
    ("compact", "Compact the conversation to free context."),
    ("cost", "Show tokens and cost of the session."),
    ("help", "Show the help menu."),
    ("ide", "Connect to an editor's extension."),
    ("init", "Write a guide file for the working directory."),
    ("mcp", "Manage the session's tool servers."),
    ("memory", "Manage lasting memory."),
    ("model", "Switch the model."),
    ("plugin", "Manage plugins."),
    ("reload-plugins", "Load plugins anew."),
    ("resume", "Resume an earlier session."),
    ("review", "Ask for a review of the changes."),
    ("security-review", "Ask for a security review of the changes."),
    ("status", "Show the session's status."),
)


def front_matter(text: str) -> dict[str, str]:
    """``key: value`` lines between the dashes that begin a file; quotes are dropped; of broken ones, none."""
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    out: dict[str, str] = {}
    for line in m[1].splitlines() if m else ():
        key, sep, value = line.partition(":")
        if sep and re.fullmatch(r"[A-Za-z_][\w-]*", key):
            out[key] = value.strip().strip("'\"")
    return {k: v for k, v in out.items() if v}


def _row(path: Path | None, name: str, skill_id: str, kind: str, meta: dict, plugin: str | None, version: str | None) -> tuple:
    return skill_id, name, plugin, version, kind, meta.get("description"), meta.get("argument-hint") or meta.get("argument_hint"), str(path) if path else None


def _version(path: Path) -> tuple:
    return tuple((0, int(x), "") if x.isdigit() else (-1, 0, x) for x in re.split(r"[.\-+]", path.name))


def _folders(root: Path) -> list[Path]:
    return sorted(p for p in root.iterdir() if p.is_dir()) if root.is_dir() else []


def _meta(path: Path) -> dict[str, str]:
    try:
        return front_matter(path.read_text(encoding="utf-8", errors="replace"))
    except OSError:
        return {}


def walk(user_root: str | Path | None, plugin_root: str | Path | None) -> Iterator[tuple]:
    """Rows in order of precedence. A plugin's newest version counts; its skills and commands appear bare and with its name."""
    for folder in _folders(Path(user_root)) if user_root else ():
        if (path := folder / "SKILL.md").exists():
            meta = _meta(path)
            name = meta.get("name") or folder.name
            yield _row(path, name, name, "user-skill", meta, None, None)
    for owner in _folders(Path(plugin_root)) if plugin_root else ():
        for plugin in _folders(owner):
            versions = _folders(plugin)
            if not versions:
                continue
            newest = max(versions, key=_version)
            try:
                manifest = json.loads((newest / ".claude-plugin" / "plugin.json").read_text())
            except (OSError, ValueError):
                manifest = {}
            owner_name, version = manifest.get("name") or plugin.name, manifest.get("version") or newest.name
            found = [(x / "SKILL.md", None, "plugin-skill") for x in _folders(newest / "skills") if (x / "SKILL.md").exists()]
            found += [(x, x.stem, "plugin-command") for x in sorted((newest / "commands").glob("*.md"))]
            for path, stem, kind in found:
                meta = _meta(path)
                name = stem or meta.get("name") or path.parent.name
                for skill_id in (name, f"{owner_name}:{name}"):
                    yield _row(path, name, skill_id, kind, meta, owner_name, version)
    for name, about in BUILTIN:
        yield _row(None, name, name, "builtin", {"description": about}, None, None)


def catalog(spark: SparkSession, user_root: str | Path | None = None, plugin_root: str | Path | None = None, now: datetime | None = None) -> DataFrame:
    """The first row of each (skill_id, source_kind)."""
    rows = [(k, *r) for k, r in enumerate(walk(user_root, plugin_root))]
    fields = "nr int, skill_id string, name string, plugin string, plugin_version string, source_kind string, description string, argument_hint string, source_path string"
    df = spark.createDataFrame(rows, fields).withColumn("n", F.row_number().over(Window.partitionBy("skill_id", "source_kind").orderBy("nr")))
    df = df.where("n = 1").withColumn("synced_at", F.lit(now or datetime.now(UTC)))
    return df.select(*[c.split()[0] for c in schemas.TABLES["skills_catalog"].split(", ")])
