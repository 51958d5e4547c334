import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TEXTFORGE_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="tf-test-ckpt-"))
    from textforge.session import local_session
    s = local_session("*", shuffle_partitions=8, app="textforge-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tf-test-")
