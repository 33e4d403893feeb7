"""Annotators: a registry, and the runner that times them and catches their errors."""

from __future__ import annotations

import importlib.util
import time
import traceback
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TYPE_CHECKING, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akzentor.functions.marks import remove_marks, to_plus

if TYPE_CHECKING:
    from akzentor.engine import StressEngine

RESULT = "accented_text string, process_time_seconds double, errors array<struct<type:string,message:string,traceback:string>>, load_time_seconds double"


class Annotator(Protocol):
    """One per worker: building it loads what it needs; `description()` is optional."""

    def accentuate(self, text: str) -> str: ...


_REGISTRY: dict[str, Callable[[], Annotator]] = {}


def register(name: str, make: Callable[[], Annotator]) -> None:
    _REGISTRY[name] = make


def registered() -> list[str]:
    return sorted(_REGISTRY)


def discover(folder: str) -> list[str]:
    """Names of the adapter modules in a folder: Python files but those that start with _, and
    runner. Each must define a class Accentuator; it is imported only where it runs."""
    found = [p.stem for p in sorted(Path(folder).glob("*.py")) if not p.name.startswith("_") and p.stem != "runner"]
    for name in found:
        register(name, _Loader(str(Path(folder) / f"{name}.py")))
    return found


class _Loader:
    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self) -> Annotator:
        spec = importlib.util.spec_from_file_location(Path(self.path).stem, self.path)
        if spec is None or spec.loader is None:
            raise ImportError(self.path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.Accentuator()


def annotate(sentences: DataFrame, name: str, keys: list[str], text: str = "text", make: Callable[[], Annotator] | None = None) -> DataFrame:
    """(keys, lib, original_text, accented_text, process_time_seconds, errors, load_time_seconds).

    Marks are taken off before; what comes back has its marks written as pluses. A text that
    fails keeps its clean form and carries the error.
    """
    make = make or _REGISTRY[name]
    clean = sentences.select(*keys, remove_marks(text).alias("original_text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in clean.schema.fields), RESULT])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.perf_counter()
        own = make()
        load = round(time.perf_counter() - began, 4)
        for part in parts:
            rows = []
            for t in part["original_text"]:
                at, errors = time.perf_counter(), []
                try:
                    said = own.accentuate(t)
                except Exception as e:  # one text's failure is a result
                    said, errors = t, [{"type": type(e).__name__, "message": str(e), "traceback": traceback.format_exc()}]
                rows.append((said, round(time.perf_counter() - at, 6), errors, load))
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(rows, columns=["accented_text", "process_time_seconds", "errors", "load_time_seconds"])], axis=1)

    return clean.mapInPandas(run, schema).withColumn("accented_text", to_plus("accented_text")).withColumn("lib", F.lit(name))


def annotate_by_engine(engine: StressEngine, sentences: DataFrame, name: str, keys: list[str], text: str = "text") -> DataFrame:
    """What `annotate` gives, by this package's own engine, which takes whole tables: its time isn't taken
    text by text."""
    clean = sentences.select(*keys, remove_marks(text).alias("original_text"))
    docs = clean.select(F.to_json(F.struct(*keys)).alias("doc_id"), F.col("original_text").alias("text"))
    said = engine.accentuate(docs, "annotated").select("doc_id", F.col("text").alias("accented_text"))
    met = clean.withColumn("doc_id", F.to_json(F.struct(*keys))).join(said, "doc_id", "left").drop("doc_id")
    errors = F.array().cast("array<struct<type:string,message:string,traceback:string>>")
    return met.select(*keys, "original_text", F.coalesce("accented_text", "original_text").alias("accented_text"), F.lit(0.0).alias("process_time_seconds"), errors.alias("errors"), F.lit(0.0).alias("load_time_seconds"), F.lit(name).alias("lib"))


def performance(runs: DataFrame) -> DataFrame:
    """(lib, load_time_seconds, process_time_seconds, exceptions) of `annotate`'s rows."""
    return runs.groupBy("lib").agg(F.max("load_time_seconds").alias("load_time_seconds"), F.round(F.sum("process_time_seconds"), 4).alias("process_time_seconds"), F.count_if(F.size("errors") > 0).alias("exceptions"))
