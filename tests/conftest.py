import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    from tickloom.session import session

    made = session("local[4]", 4, spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
