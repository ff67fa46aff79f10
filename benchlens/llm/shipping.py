"""Objects of this library sent to tasks, also where workers have no copy of the package."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import SparkSession

Thing = TypeVar("Thing")


def packed_object(thing: object) -> bytes:
    """``thing`` with the classes of this package it is made of."""
    return cloudpickle.dumps(thing)


def ship(spark: SparkSession, thing: Thing) -> Callable[[], Thing]:
    """A function that gives ``thing`` inside tasks: broadcast once, and unpacked once in a task."""
    blob = spark.sparkContext.broadcast(packed_object(thing))
    held: list[Thing] = []

    def get() -> Thing:
        if not held:
            held.append(pickle.loads(blob.value))
        return held[0]

    return get
