import sys
from pathlib import Path

import pytest

for _folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(_folder))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rankspark.session import build_session

    session = build_session("local[4]", 4, "3g", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()
