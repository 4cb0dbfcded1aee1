"""Fluent plans: immutable descriptions of a scan that become a DataFrame when run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession

from rangelake import kernel
from rangelake.operators import scan as ops
from rangelake.operators.index import build_index
from rangelake.sources.files import read_documents


@dataclass(frozen=True)
class ScanPlan:
    df: DataFrame
    content: str = "content"
    keep: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    include_content: bool = False
    hashes: bool = True
    validate_utf8: bool = True
    validate_structure: bool = True
    max_object_size: int = kernel.MAX_OBJECT_SIZE
    continue_on_error: bool = True
    extractor: Column | Callable | None = None
    validator: Callable[[Column], Column] | None = None

    def for_collections(self, *names: str) -> ScanPlan:
        return replace(self, targets=names)

    def with_content(self, on: bool = True) -> ScanPlan:
        return replace(self, include_content=on)

    def with_hashes(self, on: bool = True) -> ScanPlan:
        return replace(self, hashes=on)

    def with_max_object_size(self, most: int) -> ScanPlan:
        return replace(self, max_object_size=most)

    def extract_properties(self, extractor: Column | Callable) -> ScanPlan:
        return replace(self, extractor=extractor)

    def with_validator(self, validator: Callable[[Column], Column]) -> ScanPlan:
        """A test of content in place of the strict structure check."""
        return replace(self, validator=validator, validate_structure=False)

    def skip_validation(self) -> ScanPlan:
        """Neither structure nor UTF-8 is checked."""
        return replace(self, validate_utf8=False, validate_structure=False)

    def stop_on_error(self) -> ScanPlan:
        """Rows with an error, of the scan, of an own validator or of an extractor that raises, are left out."""
        return replace(self, continue_on_error=False)

    def _options(self) -> dict:
        return {
            "keep": self.keep, "validate_utf8": self.validate_utf8, "validate_structure": self.validate_structure,
            "max_object_size": self.max_object_size, "continue_on_error": self.continue_on_error,
        }

    def run(self) -> DataFrame:
        content = self.include_content or self.extractor is not None or self.validator is not None
        out = ops.scan_collections(self.df, self.content, self.targets, include_content=content, hashes=self.hashes, **self._options())
        if self.validator is not None:
            out = ops.with_validation(out, self.validator)
        if self.extractor is not None:
            out = ops.with_properties(out, self.extractor)
        elif self.validator is None:
            return out
        if not self.continue_on_error:
            out = out.filter("error is null")
        return out if self.include_content else out.drop("content")

    def errors(self) -> DataFrame:
        return ops.scan_errors(self.df, self.content, self.targets, **self._options())

    def build_index(self, **options) -> DataFrame:
        """Postings; the scan checks nothing, as an index takes what it can read."""
        return build_index(self.skip_validation().with_hashes(False).with_content().run(), keep=self.keep, **options)


@dataclass(frozen=True)
class PathPlan:
    df: DataFrame
    json_path: str
    content: str = "content"
    keep: tuple[str, ...] = ()
    strict: bool = False
    include_content: bool = True
    hashes: bool = True
    validate_utf8: bool = False
    max_object_size: int = kernel.MAX_OBJECT_SIZE
    continue_on_error: bool = True

    def strict_mode(self) -> PathPlan:
        return replace(self, strict=True)

    def with_content(self, on: bool = True) -> PathPlan:
        return replace(self, include_content=on)

    def with_hashes(self, on: bool = True) -> PathPlan:
        return replace(self, hashes=on)

    def with_utf8_validation(self) -> PathPlan:
        return replace(self, validate_utf8=True)

    def with_max_object_size(self, most: int) -> PathPlan:
        return replace(self, max_object_size=most)

    def skip_validation(self) -> PathPlan:
        return replace(self, validate_utf8=False)

    def stop_on_error(self) -> PathPlan:
        return replace(self, continue_on_error=False)

    def _options(self) -> dict:
        return {"strict": self.strict, "validate_utf8": self.validate_utf8, "max_object_size": self.max_object_size, "continue_on_error": self.continue_on_error}

    def run(self) -> DataFrame:
        options = {"keep": self.keep, "include_content": self.include_content, "hashes": self.hashes}
        return ops.extract_path(self.df, self.content, self.json_path, **options, **self._options())

    def errors(self) -> DataFrame:
        return ops.path_errors(self.df, self.content, self.json_path, keep=self.keep, **self._options())

    def stats(self, key: str) -> DataFrame:
        return ops.path_stats(self.df, self.content, self.json_path, key=key, **self._options())


def scan(source: DataFrame | str, *, spark: SparkSession | None = None, content: str = "content", keep: tuple[str, ...] = ()) -> ScanPlan:
    """A plan over a DataFrame of documents, or over the files of a path (which then is kept)."""
    if isinstance(source, str):
        return ScanPlan(read_documents(spark or SparkSession.active(), source), "content", keep or ("path",))
    return ScanPlan(source, content, keep)


def extract(source: DataFrame | str, json_path: str, *, spark: SparkSession | None = None, content: str = "content", keep: tuple[str, ...] = ()) -> PathPlan:
    if isinstance(source, str):
        return PathPlan(read_documents(spark or SparkSession.active(), source), json_path, "content", keep or ("path",))
    return PathPlan(source, json_path, content, keep)


def python_nodes(df: DataFrame) -> int:
    """How many nodes of the plan run Python: a scan should have one."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(text.count(n) for n in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow"))
