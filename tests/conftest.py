import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driftgauge.operators import ordered  # noqa: E402
from driftgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("driftgauge-tests", cpus=8, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def tiny_tasks(monkeypatch):
    """Make every non-trivial input take the range-bucketed path."""
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
