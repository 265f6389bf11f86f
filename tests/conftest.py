from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loupewright.sources.session import local_session  # noqa: E402
from loupewright.streaming.live import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(
        8, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    )
