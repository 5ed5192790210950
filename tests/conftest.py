import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textpairs.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=os.environ.get("TEST_CORES", "4"), shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def write_files(tmp_path):
    """write_files({"fa/m1.txt": "...", ...}) -> root path (bytes written as given)."""

    def _write(files: dict) -> str:
        for rel, content in files.items():
            p = tmp_path / "corpus" / rel
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(content.encode("utf-8") if isinstance(content, str) else content)
        return str(tmp_path / "corpus")

    return _write
