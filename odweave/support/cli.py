"""Command line: translate vectors and matrices in CSV files."""

from __future__ import annotations

import argparse
import ast
import re
import sys
import typing
import warnings
from collections.abc import Sequence
from pathlib import Path

from pydantic import BaseModel

from odweave.support.config import Config, env_flag


class AnnotationWarning(UserWarning):
    """An annotation that says nothing of an argument's type."""


#: Types of arguments by the names that annotations give them, from the one that any value fits to the narrowest.
KINDS = {"str": str, "float": float, "int": int, "bool": bool, "filepath": Path, "directorypath": Path, "newpath": Path, "path": Path}


def _named(node: ast.expr) -> str:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else str(getattr(node, "value", ""))


def _choices(node: ast.expr) -> list[ast.expr]:
    """The members of a union, in either way to write it, or a type by itself."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _choices(node.left) + _choices(node.right)
    if isinstance(node, ast.Subscript) and (outer := _named(node.value).lower()) in ("union", "optional", "annotated"):
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        none = [ast.Constant(None)] if outer == "optional" else []
        return [c for x in (inner[:1] if outer == "annotated" else inner) for c in _choices(x)] + none
    return [node]


def argument_details(annotation: str | object) -> tuple[type, bool, int | str | None]:
    """(type, whether None is allowed, number of values) of an annotation, as text or as a type.

    Of several types the one that all values fit is taken; a list takes any number of values, a tuple as many as it has.
    Anything else is a string, with a warning.
    """
    text = annotation if isinstance(annotation, str) else annotation.__name__ if isinstance(annotation, type) and not typing.get_args(annotation) else repr(annotation)
    text = re.sub(r"<class '([^']+)'>", r"\1", text.strip())
    try:
        parts = _choices(ast.parse(text, mode="eval").body)
    except SyntaxError:
        parts = []
    optional = any(_named(p).lower() in ("none", "nonetype") for p in parts)
    parts, many = [p for p in parts if _named(p).lower() not in ("none", "nonetype")], None
    if len(parts) == 1 and isinstance(parts[0], ast.Subscript):
        outer, inner = _named(parts[0].value).lower(), parts[0].slice
        own = inner.elts if isinstance(inner, ast.Tuple) else [inner]
        if outer not in ("list", "tuple", "set", "sequence"):
            parts = []
        else:
            open_ = outer != "tuple" or any(isinstance(x, ast.Constant) and x.value is ... for x in own)
            many, parts = "*" if open_ else len(own), [c for x in own for c in _choices(x) if not (isinstance(x, ast.Constant) and x.value is ...)]
    names = {_named(p).lower() for p in parts if not isinstance(p, ast.Subscript)}
    kind = next((k for n, k in KINDS.items() if n in names), None)
    if kind is None:
        warnings.warn(f"{text} says nothing of an argument's type", AnnotationWarning, stacklevel=2)
        return str, optional, many
    return kind, optional, many


class _Formatter(argparse.ArgumentDefaultsHelpFormatter):
    """Help with defaults, and with required arguments before the options."""

    def _format_usage(self, usage, actions, groups, prefix):
        return super()._format_usage(usage, sorted(actions, key=lambda a: bool(a.option_strings)), groups, prefix)


def add_model(parser: argparse.ArgumentParser, model: type[BaseModel]) -> argparse.ArgumentParser:
    """An argument for each field, of its type and number of values: positional if required, else an option; booleans are flags."""
    if not (isinstance(model, type) and issubclass(model, BaseModel)):
        raise TypeError(f"{model!r} is no model")
    for name, f in model.model_fields.items():
        kind, optional, many = argument_details(f.annotation)
        text, name = f.description or "no description", f.alias or name
        counted = {"nargs": many} if many is not None else {}
        if f.is_required():
            parser.add_argument(name, help=text, type=kind, **(counted or ({"nargs": "?"} if optional else {})))
        elif kind is bool and many is None:
            parser.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=f.default, help=text)
        else:
            parser.add_argument(f"--{name}", default=f.get_default(call_default_factory=True), help=text, type=kind, **counted)
    return parser


class VectorArgs(Config):
    """A vector file, a correspondence file, and where the result goes. Columns are names or places."""

    vector: Path
    correspondence: Path
    output: Path = Path("translated")
    zone: int | str = 0
    source: int | str = 0
    target: int | str = 1
    factor: int | str | None = 2

    def run(self, spark) -> None:
        """Translate."""
        from odweave.sources.ingest import translate_vector_file

        cols = {k: _place(getattr(self, k)) for k in ("source", "target", "factor")}
        translate_vector_file(spark, str(self.vector), str(self.correspondence), str(self.output), _place(self.zone), **cols)


class MatrixArgs(Config):
    """A matrix file, a correspondence file, and where the result goes."""

    matrix: Path
    correspondence: Path
    output: Path = Path("translated")
    source: int | str = 0
    target: int | str = 1
    factor: int | str | None = 2

    def run(self, spark) -> None:
        """Translate."""
        from odweave.sources.ingest import translate_matrix_file

        cols = {k: _place(getattr(self, k)) for k in ("source", "target", "factor")}
        translate_matrix_file(spark, str(self.matrix), str(self.correspondence), str(self.output), **cols)


def _place(c):
    return int(c) if isinstance(c, str) and c.isdigit() else c


COMMANDS = {"translate": VectorArgs, "matrix-translate": MatrixArgs}


def parse(argv: Sequence[str] | None = None) -> Config:
    """The model that a command line gives; NAME-config takes a YAML file instead of arguments."""
    parser = argparse.ArgumentParser(prog="odweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, model in COMMANDS.items():
        add_model(commands.add_parser(name, help=model.__doc__, formatter_class=_Formatter), model)
        commands.add_parser(f"{name}-config", help=f"{name}, from a file").add_argument("config_path", type=Path)
    args = vars(parser.parse_args(argv))
    command = args.pop("command")
    model = COMMANDS[command.removesuffix("-config")]
    return model.load(args["config_path"]) if command.endswith("-config") else model.model_validate(args)


def main(argv: Sequence[str] | None = None) -> None:
    """Parse and run; errors end the program with a message, or a traceback if ODWEAVE_TRACEBACK is set."""
    from pyspark.sql import SparkSession

    args = parse(argv)
    try:
        args.run(SparkSession.builder.appName("odweave").getOrCreate())
    except Exception as e:
        if env_flag("ODWEAVE_TRACEBACK", False):
            raise
        sys.exit(f"{type(e).__name__}: {e}")
