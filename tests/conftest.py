import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from ledgerline.session import build_session  # noqa: E402

LOCAL = {
    "spark__sql__shuffle__partitions": "8",
    "spark__ui__enabled": "false",
    "spark__driver__host": "127.0.0.1",
    "spark__driver__bindAddress": "127.0.0.1",
    "spark__driver__memory": "8g",
    "spark__python__sql__dataFrameDebugging__enabled": "false",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__warehouse__dir=str(home / "warehouse"),
        spark__checkpoint__dir=str(home / "checkpoints"),
        **LOCAL,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def collect(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)

    return collect
