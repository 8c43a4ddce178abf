"""Saving and loading of fitted presets and operators.

An object is pickled with its tables and Spark ML models taken out: tables are written as Parquet and
models by their own writers, beside the pickle, which is a Parquet table of one row. All of it goes
through Spark, so the path may be in any store that Spark writes to. Load only what you saved yourself:
a pickle runs code.
"""

from __future__ import annotations

import importlib
import io
import pickle
from typing import Any

from pyspark.cloudpickle import CloudPickler
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession


class Saver(CloudPickler):
    def __init__(self, buffer: io.BytesIO, path: str):
        super().__init__(buffer)
        self.path, self.n, self.known = path, 0, {}

    def persistent_id(self, thing: Any) -> tuple | None:
        if isinstance(thing, Column):
            raise TypeError("a Column can't be saved; keep plain values in operators")
        if not isinstance(thing, (DataFrame, Model)):
            return None
        if id(thing) not in self.known:
            self.n += 1
            place = f"{self.path}/{self.n}"
            if isinstance(thing, DataFrame):
                thing.write.mode("overwrite").parquet(place)
                self.known[id(thing)] = ("table", self.n), thing
            else:
                thing.write().overwrite().save(place)
                self.known[id(thing)] = ("model", self.n, type(thing).__module__, type(thing).__qualname__), thing
        return self.known[id(thing)][0]


class Loader(pickle.Unpickler):
    def __init__(self, data: bytes, path: str, spark: SparkSession):
        super().__init__(io.BytesIO(data))
        self.path, self.spark, self.known = path, spark, {}

    def persistent_load(self, place: tuple) -> Any:
        if place not in self.known:
            where = f"{self.path}/{place[1]}"
            self.known[place] = self.spark.read.parquet(where) if place[0] == "table" else getattr(importlib.import_module(place[2]), place[3]).load(where)
        return self.known[place]


def save(thing: Any, path: str) -> None:
    """``thing``, an operator, a model or a preset that is fitted, under ``path``; what is there is replaced."""
    buffer = io.BytesIO()
    Saver(buffer, path).dump(thing)
    SparkSession.active().createDataFrame([(bytearray(buffer.getvalue()),)], "state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load(spark: SparkSession, path: str) -> Any:
    """What :func:`save` wrote under ``path``."""
    return Loader(bytes(spark.read.parquet(f"{path}/state").first()["state"]), path, spark).load()
