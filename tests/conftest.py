import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from docvet.session import local_session

    s = local_session("*", 8)
    yield s


def expand(pairs):
    """[(value, count), ...] -> rows (id, value) in order of appearance."""
    rows, i = [], 0
    for v, n in pairs:
        for _ in range(n):
            rows.append((i, v))
            i += 1
    return rows
