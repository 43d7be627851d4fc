"""Logging to console and file for the time of a run, and metadata beside its outputs."""

from __future__ import annotations

import getpass
import logging
import os
import platform
import re
import subprocess
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path

import yaml

FORMAT = "%(asctime)s [%(levelname)-8s] %(name)s: %(message)s"


def describe_commit(folder: str | Path = ".") -> str | None:
    """What git calls the commit of a folder, or None."""
    try:
        run = subprocess.run(["git", "describe", "--tags", "--always", "--dirty"], cwd=folder, capture_output=True, text=True, timeout=1, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return run.stdout.strip() or None


#: A semantic version: three numbers, then what comes before it, then its build.
_PART, _NUMBER = r"[0-9A-Za-z-]+", r"(0|[1-9]\d*)"
VERSION = rf"{_NUMBER}\.{_NUMBER}\.{_NUMBER}(-{_PART}(\.{_PART})*)?(\+{_PART}(\.{_PART})*)?"


@dataclass
class Tool:
    """A program's name and version."""

    name: str
    version: str
    homepage: str | None = None
    commit: str | None = field(default_factory=describe_commit)

    def __post_init__(self):
        if not re.fullmatch(VERSION, self.version):
            raise ValueError(f"{self.version!r} is no semantic version, like 1.2.3 or 1.2.3-rc.1+build")


@dataclass
class System:
    """Where a program runs."""

    user: str
    host: str
    python: str
    system: str
    machine: str
    spark: str | None = None
    cpus: int | None = None
    memory_gb: float | None = None

    @classmethod
    def load(cls, spark=None) -> System:
        """This one."""
        memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else 0
        here = getpass.getuser(), platform.node(), platform.python_version(), platform.platform(), platform.machine()
        return cls(*here, spark.version if spark else None, os.cpu_count(), round(memory / 1e9, 1) or None)


@dataclass(frozen=True)
class PackageFilter:
    """Lets only the records of some packages, and of the modules in them, through a handler."""

    packages: tuple[str, ...]

    def filter(self, record: logging.LogRecord) -> bool:
        """Whether the record's logger is one of theirs."""
        return any(re.match(rf"{re.escape(p)}(\.|$)", record.name) for p in self.packages)


def handler(path: str | Path | None = None, level: int = logging.DEBUG, packages: tuple[str, ...] = ()) -> logging.Handler:
    """A handler that writes to a file, or to the console without one, whatever the packages (or all) record."""
    made = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    made.setLevel(level)
    made.setFormatter(logging.Formatter(FORMAT))
    if packages:
        made.addFilter(PackageFilter(packages))
    return made


def get_logger(name: str, path: str | Path | None = None, console: bool = True, level: int = logging.DEBUG) -> logging.Logger:
    """A logger with handlers of its own, which replace those that an earlier call gave it."""
    logger = logging.getLogger(name)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    logger.setLevel(level)
    if console:
        logger.addHandler(handler(level=logging.INFO))
    if path:
        logger.addHandler(handler(path, level))
    return logger


@contextmanager
def temporary_log(logger: logging.Logger, path: str | Path, level: int = logging.DEBUG) -> Iterator[logging.Handler]:
    """For the time of a block, what a logger records goes to one more file."""
    extra = handler(path, level)
    logger.addHandler(extra)
    try:
        yield extra
    finally:
        logger.removeHandler(extra)
        extra.close()


class RunLog:
    """A context in which a package's records and warnings go to the console and a file; errors are recorded."""

    def __init__(self, package: str, tool: Tool, path: str | Path | None = None, console: bool = True):
        self.logger, self.tool = logging.getLogger(package), tool
        self.handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
        for h in self.handlers:
            h.setLevel(logging.INFO)
        if path:
            self.handlers.append(logging.FileHandler(path, encoding="utf-8"))
        for h in self.handlers:
            h.setFormatter(logging.Formatter(FORMAT))

    def add(self, extra: logging.Handler) -> None:
        """One more handler, for the rest of the run."""
        self.handlers.append(extra)
        self.logger.addHandler(extra)
        logging.getLogger("py.warnings").addHandler(extra)

    def __enter__(self) -> logging.Logger:
        self.level = self.logger.level
        self.logger.setLevel(logging.DEBUG)
        logging.captureWarnings(True)
        for h in self.handlers:
            self.logger.addHandler(h)
            logging.getLogger("py.warnings").addHandler(h)
        self.logger.info("%s %s", self.tool.name, self.tool.version)
        self.logger.debug("%s", asdict(System.load()))
        return self.logger

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self.logger.critical("the run failed", exc_info=error)
        for h in self.handlers:
            self.logger.removeHandler(h)
            logging.getLogger("py.warnings").removeHandler(h)
            h.close()
        logging.captureWarnings(False)
        self.logger.setLevel(self.level)


def write_metadata(folder: str | Path, tool: Tool, spark=None, name: str = "metadata.yml", **more) -> Path:
    """Tool, system and more as YAML in a folder that exists."""
    folder = Path(folder)
    if not folder.is_dir():
        raise NotADirectoryError(folder)
    rows = {"written": f"{datetime.now():%Y-%m-%d %H:%M:%S}", "tool": asdict(tool), "system": asdict(System.load(spark)), **more}
    (path := folder / name).write_text(yaml.safe_dump(rows, sort_keys=False), encoding="utf-8")
    return path
