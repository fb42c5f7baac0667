"""The search for free positions reads the resolved pages, and works them out no second time."""

from checks import ordering as checks
from tests.conftest import SMALL


def test_pages_are_resolved_once(spark, capsys):
    found = checks.nearest_free(spark, SMALL)
    capsys.readouterr()
    found.explain("simple")
    assert "FileScan" not in capsys.readouterr().out
    assert found.count() > 0
