"""Every registered query of the core catalogue against its oracle, on the smallest tables."""

from __future__ import annotations

import parity
import pytest

from brindle import plans, registry

SF = "/root/testdata/sf0.001"
plans.load_all()


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", [n for n, e in registry.ENTRIES.items() if e.oracle])
def test_matches_oracle(spark, con, name):
    e = registry.ENTRIES[name]
    assert parity.compare(spark, con, SF, e.run, e.oracle) == ""


@pytest.mark.parametrize("name", [n for n, e in registry.ENTRIES.items() if not e.oracle])
def test_runs(spark, name):
    assert registry.ENTRIES[name].run(spark, SF).schema is not None
    registry.ENTRIES[name].run(spark, SF).collect()
