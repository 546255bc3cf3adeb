import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rng():
    return np.random.default_rng(88)


@pytest.fixture
def drifting_panel(rng):
    """9 channels at 100 samples a second: smoothed noise that all share, white noise of their own, a level and a drift."""
    shared = np.convolve(rng.standard_normal(3014), np.ones(15), "valid")
    drift = rng.integers(1, 9, (9, 1)) * np.linspace(-1, 1, 3000) + rng.integers(0, 50, (9, 1))
    return shared + rng.standard_normal((9, 3000)) + drift
