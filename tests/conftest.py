import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from taxaflow.session import session, ship

    made = session(
        "tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    yield made
    made.stop()
