from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.session import get_session

    w = tmp_path_factory.mktemp("warehouse")
    return get_session("local[4]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=f"file://{w}", spark__driver__memory="4g")
