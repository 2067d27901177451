import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablework.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="tablework-tests", shuffle_partitions=4,
                    conf={"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def tmp(tmp_path):
    """A fresh local folder for generated fixture files (tests only)."""
    return tmp_path


def write(path, name, content, encoding="utf-8", mode="w"):
    p = os.path.join(str(path), name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    if isinstance(content, bytes):
        with open(p, "wb") as fh:
            fh.write(content)
    else:
        with open(p, mode, encoding=encoding, newline="") as fh:
            fh.write(content)
    return p


def _key(t):
    return tuple((v is None, "" if v is None else str(v)) for v in t)


def rows(df, order=None):
    cols = order or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


def new_dir(prefix="tw-test-"):
    return tempfile.mkdtemp(prefix=prefix)
