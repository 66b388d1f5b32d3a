import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clausemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, shuffle_partitions=4, memory="4g", shared=tmp_path_factory.mktemp("shared").as_uri())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
