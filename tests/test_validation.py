import pytest

from graphloom.validation import check


@pytest.mark.parametrize("ok", [{"text": "x" * 10}, {"text": "x" * 50_000}, {"question": "why"}, {"cypher": "x" * 5_000}, {"max_results": 1}, {"count": 100}, {"depth": 5}])
def test_inside(ok):
    check(**ok)


@pytest.mark.parametrize("bad", [{"text": "short"}, {"text": "x" * 50_001}, {"question": ""}, {"cypher": "x" * 5_001}, {"max_results": 0}, {"count": 101}, {"depth": 6}, {"k": True}, {"text": None}, {"other": 1}])
def test_outside(bad):
    with pytest.raises(ValueError):
        check(**bad)
