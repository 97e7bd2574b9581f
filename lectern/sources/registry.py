"""Parsers by file type: functions from a file's text or bytes to elements, run over batches of files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ELEMENT, ELEMENT_NAMES

_PARSERS: dict[str, tuple[Callable, bool]] = {}
_TYPES: dict[str, str] = {}


def register_parser(file_type: str, extensions: list[str], binary: bool = False):
    """Decorator: the function parses files with these extensions; it gets their bytes if ``binary``, else their text."""

    def keep(fn: Callable) -> Callable:
        _PARSERS[file_type] = (fn, binary)
        _TYPES.update({e.lower(): file_type for e in extensions})
        return fn

    return keep


def get_parser(file_type: str) -> Callable | None:
    return _PARSERS.get(file_type, (None, False))[0]


def list_types() -> list[str]:
    return sorted(_PARSERS)


def classify_file(path: str) -> str:
    return _TYPES.get(os.path.splitext(path)[1].lower(), "unknown")


def file_type(path: Column) -> Column:
    """The type of a path as an expression; ``unknown`` without a parser."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    table = F.create_map(*(F.lit(x) for kv in sorted(_TYPES.items()) for x in kv))
    return F.coalesce(table[ext], F.lit("unknown"))


def parse_report(files: DataFrame) -> DataFrame:
    """Elements of files (content, file_type, source_label, source_module, file_path), and ``error``.

    A file without elements has one row without a type; so has a file that can't be
    parsed, with what went wrong.
    """
    parsers = dict(_PARSERS)
    none = dict.fromkeys(ELEMENT_NAMES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f in frame.itertuples():
                fn, binary = parsers.get(f.file_type, (None, False))
                found, error = [], None
                try:
                    if fn is not None and f.content is not None:
                        found = fn(f.content if binary or isinstance(f.content, str) else bytes(f.content).decode("utf-8", "replace"))
                except Exception as e:  # one bad file must not end the job; the row says so
                    error = f"{type(e).__name__}: {e}"[:300]
                rows += [{**e, "source_label": f.source_label, "source_module": f.source_module, "file_path": f.file_path, "error": error} for e in found or [none]]
            yield pd.DataFrame(rows, columns=[*ELEMENT_NAMES, "error"])

    return files.select("content", "file_type", "source_label", "source_module", "file_path").mapInPandas(run, ELEMENT + ", error string")


def elements_of(report: DataFrame) -> DataFrame:
    return report.where("type is not null").drop("error")


def failures_of(report: DataFrame) -> DataFrame:
    """source_label, source_module, file_path, error of the files that couldn't be parsed."""
    return report.where("error is not null").select("source_label", "source_module", "file_path", "error")


def parse_files(files: DataFrame) -> DataFrame:
    """The elements of files."""
    return elements_of(parse_report(files))


def _register_known() -> None:
    from .headers import parse_header
    from .html_pages import parse_page
    from .pdf import parse_pdf

    register_parser("html", [".html", ".htm"])(parse_page)
    register_parser("header", ".hxx .hpp .h".split())(parse_header)
    register_parser("pdf", [".pdf"], binary=True)(parse_pdf)


_register_known()
