import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import close, local_session, shared_folder

    session = local_session(4, shuffle_partitions=4, memory="6g")
    yield session
    folder = Path(shared_folder(session).removeprefix("file://"))
    close(session)
    assert not folder.exists()


@pytest.fixture(scope="session")
def sf():
    return SF
