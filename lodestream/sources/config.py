"""Project lists (JSON) and settings (INI), read on the driver."""

from __future__ import annotations

import configparser
import json
import os
import re
from dataclasses import dataclass, field

NAME = re.compile(r"[a-z][a-z0-9_]*")
# Globs that are left out of the index unless a project has its own list.
DEFAULT_EXCLUDES = (
    "**/node_modules", "**/node_modules/**",
    "**/work", "**/work/**",
    "**/target", "**/target/**",
    "**/.git", "**/.git/**",
    "**/*.jar",
    "**/tomcat", "**/tomcat/**",
    "**/build", "**/build/**",
)


def is_valid_name(name: str) -> bool:
    return bool(NAME.fullmatch(name or ""))


@dataclass(frozen=True)
class Project:
    name: str
    roots: tuple[str, ...]
    excludes: tuple[str, ...] = DEFAULT_EXCLUDES
    folder: str | None = None

    def root_of(self, repo: str) -> str | None:
        return next((r for r in reversed(self.roots) if os.path.basename(r.rstrip("/")) == repo), None)


@dataclass
class Projects:
    by_name: dict[str, Project] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Projects:
        with open(path) as f:
            return cls.of(json.load(f))

    @classmethod
    def of(cls, config: dict) -> Projects:
        """Check a configuration: projects, valid and different names, roots, no two roots of one name in a project."""
        listed = config.get("projects") or []
        if not listed:
            raise ValueError("no projects are configured")
        found: dict[str, Project] = {}
        for entry in listed:
            name = entry.get("name", "")
            if not is_valid_name(name):
                raise ValueError(f"project name {name!r} does not match [a-z][a-z0-9_]*")
            if name in found:
                raise ValueError(f"project {name} is configured twice")
            roots = tuple(entry.get("roots") or ())
            if not roots:
                raise ValueError(f"project {name} has no roots")
            names = [os.path.basename(r.rstrip("/")) for r in roots]
            if len(set(names)) < len(names):
                raise ValueError(f"project {name} has two roots of one name")
            excludes = entry.get("excludeGlobs")
            found[name] = Project(name, roots, DEFAULT_EXCLUDES if excludes is None else tuple(excludes), entry.get("project_dir"))
        return cls(found)

    def get(self, name: str) -> Project:
        if name not in self.by_name:
            raise KeyError(f"no project {name}")
        return self.by_name[name]

    @property
    def names(self) -> list[str]:
        return list(self.by_name)


def load_ini(path: str) -> dict[str, dict[str, str]]:
    """Sections of an INI file; entries before any section are under the empty name."""
    parser = configparser.RawConfigParser(strict=False, allow_no_value=True, default_section="\0")
    parser.optionxform = str
    with open(path) as f:
        parser.read_string("[\1]\n" + f.read())
    return {("" if s == "\1" else s): {k: v or "" for k, v in parser.items(s)} for s in parser.sections()}


@dataclass(frozen=True)
class Settings:
    """How an index is made; the defaults are those of the configuration file's keys of the same meaning."""

    model: str = "hashing"
    dimension: int = 768
    batch_texts: int = 32
    batch_bytes: int = 6000
    max_file_bytes: int = 1_048_576

    @classmethod
    def of(cls, section: dict[str, str]) -> Settings:
        number = lambda key, default: int(section.get(key) or default)
        return cls(
            section.get("EmbeddingModel") or cls.model,
            number("EmbeddingDim", cls.dimension),
            number("EmbeddingBatch", cls.batch_texts),
            number("EmbeddingMaxBatchBytes", cls.batch_bytes),
            number("RAGMaxFileBytes", cls.max_file_bytes),
        )


#: URLs and drivers of the databases that tables can be read from over JDBC (fixed values).
JDBC = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}:{database}", "oracle.jdbc.driver.OracleDriver", 1521),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", 0),
}


def jdbc_options(kind: str, database: str, host: str = "localhost", port: int | None = None, user: str | None = None, password: str | None = None) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``; the driver's jar must be on the class path."""
    url, driver, usual = JDBC[kind.lower()]
    out = {"url": url.format(host=host, port=port or usual, database=database), "driver": driver}
    return out | ({"user": user} if user else {}) | ({"password": password} if password else {})
