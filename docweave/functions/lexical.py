"""JSON that keeps numbers as they were written: 1.50, 1e2 and -0.0 come back unchanged."""

from __future__ import annotations

import json
from typing import Any


class Number(str):
    """A number's own text."""

    __slots__ = ()


def loads(text: str) -> Any:
    return _DECODER.decode(text)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)


def _text(value: str) -> str:
    return str.__str__(value) if type(value) is Number else json.encoder.encode_basestring(value)


def _encoder(sort_keys: bool) -> Any:
    make = json.encoder.c_make_encoder
    return make and make(None, None, _text, None, ":", ",", sort_keys, False, True)


#: The library's compiled encoder, which asks for the text of every string; None where it isn't compiled.
_ENCODERS = {k: _encoder(k) for k in (False, True)}


def dumps(value: Any, sort_keys: bool = False) -> str:
    """Compact text; with sort_keys the canonical form that digests are taken of."""
    if encoder := _ENCODERS[sort_keys]:
        return "".join(encoder(value, 0))
    out: list[str] = []
    _write(value, sort_keys, out)
    return "".join(out)


def _write(value: Any, sort_keys: bool, out: list[str]) -> None:
    if isinstance(value, Number):
        out.append(str.__str__(value))
    elif isinstance(value, dict):
        out.append("{")
        for i, key in enumerate(sorted(value) if sort_keys else value):
            out.append(("," if i else "") + json.dumps(key, ensure_ascii=False) + ":")
            _write(value[key], sort_keys, out)
        out.append("}")
    elif isinstance(value, list):
        out.append("[")
        for i, item in enumerate(value):
            out.append("," if i else "")
            _write(item, sort_keys, out)
        out.append("]")
    else:
        out.append(json.dumps(value, ensure_ascii=False))
