import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from demandkit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # No spark.checkpoint.dir here: a configured one is kept; otherwise
    # ensure_checkpoint_dir creates a fresh local folder (local master only).
    session = build_session(
        master="local[4]",
        shuffle_partitions=8,
        extra={
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="demandkit-test-out-")

sys.path.insert(0, str(Path(__file__).resolve().parent))
