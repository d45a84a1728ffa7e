"""What the stages of the pipeline and their Python workers hold."""

import re
from pathlib import Path

import numpy as np
import pytest

from corroborate.session import RUNTIME_CONF, tune

from .conftest import frame


def held_mb():
    rollup = Path("/proc/self/smaps_rollup")
    if not rollup.exists():
        pytest.skip("memory can't be read here")
    return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup.read_text())[1]) / 1024


def test_stages_called_alone_bound_their_batches(spark):
    import corpus_pipeline as C

    rows = [(i, "the cat and the dog sat by the river while it rained all day long on the hill", "en", None, None) for i in range(4)]
    docs = frame(spark, rows)
    try:
        for name, stage in C.STAGES:
            for key in RUNTIME_CONF:
                spark.conf.unset(key)
            stage(spark, docs, "/root/testdata/sf0.001")
            assert {key: spark.conf.get(key, None) for key in RUNTIME_CONF} == RUNTIME_CONF, name
    finally:
        tune(spark)


def test_a_step_gives_freed_memory_back():
    from corroborate.llm.memory import frugal

    pins = []

    def step(batches):
        for batch in batches:
            pieces = [np.ones(8000) for _ in range(1600)]  # 100 MB below the size that is mapped apart
            pins.append(np.ones(8000))  # stays in use behind them
            del pieces
            yield batch

    before = held_mb()
    assert list(frugal(step)(iter(range(3)))) == [0, 1, 2]
    assert held_mb() < before + 40
