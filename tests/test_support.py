"""Fan-out, configuration, command line and logging."""

import argparse
import logging
import time
from pathlib import Path

import pytest
from pydantic import BaseModel

from odweave.support import cli, config, logs
from odweave.support.fanout import fan_out


def test_fan_out(spark):
    calls = [(i,) for i in range(10)]
    assert fan_out(spark, lambda x, k=1: x * k, calls, [{"k": 2}] * 10) == [2 * i for i in range(10)]
    assert fan_out(spark, lambda x: x, calls, tasks=0) == list(range(10))
    assert sorted(fan_out(spark, lambda x: x, calls, tasks=-1, in_order=False)) == list(range(10))
    with pytest.raises(ValueError):
        fan_out(spark, print, [()], [{}, {}])
    with pytest.raises(TimeoutError):
        fan_out(spark, time.sleep, [(20,)], timeout=1)


def test_config(tmp_path, monkeypatch):
    a = cli.VectorArgs(vector="a.csv", correspondence="c.csv", zone="z")
    a.save(tmp_path / "x.yml", "two\nlines")
    assert cli.VectorArgs.load(tmp_path / "x.yml") == a
    cli.VectorArgs.example(tmp_path / "e.yml", zone="here")
    assert "vector: REQUIRED" in (tmp_path / "e.yml").read_text() and "zone: here" in (tmp_path / "e.yml").read_text()
    assert cli.parse(["translate-config", str(tmp_path / "x.yml")]) == a
    assert cli.parse(["matrix-translate", "m.csv", "c.csv", "--target", "b"]).target == "b"
    monkeypatch.setenv("FLAG", "Yes")
    assert config.env_flag("FLAG", False) and config.env_flag("NO_FLAG", True)
    monkeypatch.setenv("FLAG", "maybe")
    with pytest.raises(ValueError):
        config.env_flag("FLAG", False)


def test_logs(tmp_path):
    tool = logs.Tool("t", "1.0.0")
    with pytest.raises(RuntimeError), logs.RunLog("pkg", tool, tmp_path / "x.log", console=False) as log:
        log.info("hello")
        raise RuntimeError("gone")
    text = (tmp_path / "x.log").read_text()
    assert "hello" in text and "CRITICAL" in text and "gone" in text and not logging.getLogger("pkg").handlers
    assert "version: 1.0.0" in logs.write_metadata(tmp_path, tool, extra=1).read_text()
    with pytest.raises(NotADirectoryError):
        logs.write_metadata(tmp_path / "none", tool)


def test_loggers(tmp_path):
    log = logs.get_logger("some.tool", tmp_path / "all.log", console=False)
    assert len(logs.get_logger("some.tool", tmp_path / "all.log", console=False).handlers) == 1
    with logs.temporary_log(log, tmp_path / "block.log"):
        log.debug("inside")
    log.debug("outside")
    assert "inside" in (tmp_path / "block.log").read_text() and "outside" not in (tmp_path / "block.log").read_text()
    assert "outside" in (tmp_path / "all.log").read_text()
    only = logs.PackageFilter(("some",))
    named = lambda name: logging.LogRecord(name, logging.INFO, "", 0, "", None, None)
    assert only.filter(named("some.tool")) and only.filter(named("some")) and not only.filter(named("something"))
    assert only == logs.PackageFilter(("some",)) and len({only, logs.PackageFilter(("some",))}) == 1
    logs.get_logger("some.tool", console=False)


@pytest.mark.parametrize(
    ("annotation", "want"),
    [
        ("Optional[float]", (float, True, None)), ("float | None", (float, True, None)), ("types.DirectoryPath", (Path, False, None)), ("bool", (bool, False, None)),
        ("str | float", (str, False, None)), ("Union[int, float, None]", (float, True, None)), ("tuple[int, float, int]", (float, False, 3)), ("list[Union[int, None]]", (int, False, "*")),
        ("Optional[list[str]]", (str, True, "*")), ("tuple[int, ...]", (int, False, "*")), ("<class 'int'>", (int, False, None)), ("<class 'pathlib._local.Path'>", (Path, False, None)),
        (int | str | None, (str, True, None)), (tuple[Path, Path], (Path, False, 2)), (list[float], (float, False, "*")), (Path, (Path, False, None)),
    ],
)
def test_argument_details(annotation, want):
    assert cli.argument_details(annotation) == want


@pytest.mark.parametrize("annotation", ["dict[str, int]", "complex", "int or so", "frozenset[int]"])
def test_unknown_annotations(annotation):
    with pytest.warns(cli.AnnotationWarning):
        assert cli.argument_details(annotation) == (str, False, None)


class Odd(BaseModel):
    sizes: tuple[int, int]
    names: list[str]
    share: float = 0.5
    path: Path | None = None
    flag: bool = False
    many: list[int] = [1]


def test_typed_arguments(capsys):
    parser = cli.add_model(argparse.ArgumentParser(formatter_class=cli._Formatter), Odd)
    got = vars(parser.parse_args(["3", "4", "a", "b", "--share", "0.25", "--flag", "--many", "5", "6"]))
    assert got == {"sizes": [3, 4], "names": ["a", "b"], "share": 0.25, "path": None, "flag": True, "many": [5, 6]}
    assert Odd.model_validate(got).sizes == (3, 4)
    for wrong in (["3"], ["3", "x", "a"], ["3", "4", "a", "--share", "much"]):
        with pytest.raises(SystemExit):
            parser.parse_args(wrong)
    text = parser.format_help()
    assert "(default: 0.5)" in text
    with pytest.raises(TypeError):
        cli.add_model(parser, dict)


def test_versions_and_system(spark):
    for good in ("0.1.0", "1.2.3-rc.1+build.5", "10.20.30-0a"):
        assert logs.Tool("t", good).version == good
    for bad in ("1.0", "01.2.3", "1.2.3-", "v1.2.3", "1.2.3 "):
        with pytest.raises(ValueError, match="semantic"):
            logs.Tool("t", bad)
    here = logs.System.load(spark)
    assert here.cpus >= 1 and here.memory_gb > 0.1 and here.spark == spark.version
