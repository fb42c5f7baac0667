import pytest

from quire.plans.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture()
def tiny_chunks(monkeypatch):
    """Chunks and salts so small that every test group crosses their borders."""
    from quire.plans import ranks

    monkeypatch.setattr(ranks, "CHUNK_KEYS", 7)
    monkeypatch.setattr(ranks, "SALTS", 3)
