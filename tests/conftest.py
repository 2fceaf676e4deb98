import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from unimass.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


def rows(df, *cols):
    """Collected rows as a sorted list of tuples."""
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
