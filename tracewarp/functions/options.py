"""Options of the library, validated when set."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

LOG_LEVELS = ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "NOTSET")


def _typed(*kinds: type) -> Callable[[str, Any], None]:
    def check(key: str, value: Any) -> None:
        if not isinstance(value, kinds) or isinstance(value, bool) and bool not in kinds:
            raise ValueError(f"{key} takes {' or '.join(k.__name__ for k in kinds)}, not {value!r}")

    return check


bool_validator, str_validator, int_validator, float_validator = _typed(bool), _typed(str), _typed(int), _typed(float, int)


def log_level_validator(key: str, value: Any) -> None:
    str_validator(key, value)
    if value not in LOG_LEVELS:
        raise ValueError(f"{key} is one of {', '.join(LOG_LEVELS)}")


def url_validator(key: str, value: Any) -> None:
    str_validator(key, value)
    scheme, sep, rest = value.partition("://")
    if not sep or scheme not in ("http", "https") or not rest.split("/")[0]:
        raise ValueError(f"{key} takes an http or https address")


DEFAULTS = {"log_level": ("INFO", log_level_validator), "notebook_url": ("http://localhost:8888", url_validator)}
_values = {k: v for k, (v, _) in DEFAULTS.items()}


def _known(key: str) -> None:
    if key not in DEFAULTS:
        raise ValueError(f"no option {key!r}; there are {', '.join(DEFAULTS)}")


def get_option(key: str) -> Any:
    _known(key)
    return _values[key]


def set_option(key: str, value: Any) -> None:
    _known(key)
    DEFAULTS[key][1](key, value)
    _values[key] = value


def reset_option(key: str) -> None:
    """Back to the default; ``all`` resets every option."""
    keys = list(DEFAULTS) if key == "all" else [key]
    for k in keys:
        _known(k)
        _values[k] = DEFAULTS[k][0]
