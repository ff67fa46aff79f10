import os
import subprocess
import sys

import numpy as np

from benchlens.llm.dimension_scan import Plan
from benchlens.llm.shipping import packed_object, ship


def test_objects_load_without_the_package():
    """As on workers that have Spark but no copy of this library."""
    eye = np.eye(2)
    blob = packed_object(Plan(eye, eye, np.arange(2), eye, 0.5, 3))
    code = "import sys, pickle; p = pickle.load(sys.stdin.buffer); import importlib.util as u; " \
           "assert u.find_spec('benchlens') is None; print(p.lists_of(p.sample).tolist(), p.k)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], input=blob, cwd="/", env=env, capture_output=True, timeout=60)
    assert got.stdout.decode().split() == ["[0,", "1]", "3"], got.stderr.decode()


def test_shipped_objects_reach_tasks(spark):
    plan = ship(spark, {"k": 7})

    def add(batches):
        for b in batches:
            yield type(b).from_pydict(
                {"id": b.column(0), "k": [plan()["k"]] * b.num_rows})

    assert {r.k for r in spark.range(9).mapInArrow(add, "id long, k long").collect()} == {7}
