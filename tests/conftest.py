import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from corpusflow.session import build_session, checkpoint_dir  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    if not s.conf.get("spark.checkpoint.dir", None):
        checkpoint_dir(s, tempfile.mkdtemp(prefix="test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="cf-test-", dir="/tmp")
