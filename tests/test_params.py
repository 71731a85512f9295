import pytest

from ridepulse.functions.params import (
    validate_city,
    validate_city_list,
    validate_horizon,
    validate_hour_range,
    validate_limit,
)


@pytest.mark.parametrize("bad", ["", " ", "a", "x" * 81, None])
def test_city_rejects(bad):
    with pytest.raises(ValueError):
        validate_city(bad)


@pytest.mark.parametrize("ok", ["ab", "  San Diego  ", "x" * 80])
def test_city_accepts(ok):
    assert validate_city(ok) == ok.strip()


def test_city_list_dedup_keeps_first_spelling_and_order():
    assert validate_city_list("a b, A B,Chicago") == ["a b", "Chicago"]
    assert validate_city_list("New York,Los Angeles") == ["New York", "Los Angeles"]


def test_city_list_bounds():
    assert len(validate_city_list(",".join(f"City{i}" for i in range(10)))) == 10
    with pytest.raises(ValueError):
        validate_city_list(",".join(f"City{i}" for i in range(11)))
    with pytest.raises(ValueError):  # one empty item fails the whole list
        validate_city_list("Chicago,,Dallas")


@pytest.mark.parametrize("bad", [0, 26, "x", None])
def test_limit_rejects(bad):
    with pytest.raises(ValueError):
        validate_limit(bad)


def test_limit_accepts_bounds():
    assert validate_limit(1) == 1 and validate_limit("25") == 25


def test_hours():
    assert validate_hour_range(20, 4) == (4, 20)
    assert validate_hour_range(0, 23) == (0, 23)
    with pytest.raises(ValueError):
        validate_hour_range(24, 25)
    with pytest.raises(ValueError):
        validate_hour_range(-1, 3)


@pytest.mark.parametrize("bad", [0, 25, "soon"])
def test_horizon_rejects(bad):
    with pytest.raises(ValueError):
        validate_horizon(bad)


def test_horizon_accepts():
    assert validate_horizon(1) == 1 and validate_horizon(24) == 24
