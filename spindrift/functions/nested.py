"""Nested values (JSON) cut into pieces that keep their structure."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _size(value: Any) -> int:
    return len(json.dumps(value, ensure_ascii=False))


def _keyed(value: Any) -> Any:
    """Lists as objects with the places as keys."""
    if isinstance(value, dict):
        return {k: _keyed(v) for k, v in value.items()}
    return {str(i): _keyed(v) for i, v in enumerate(value)} if isinstance(value, list) else value


def _put(piece: dict, path: list[str], value: Any) -> int:
    """Place ``value`` under ``path`` and return by how many characters the piece grows; only the new part is measured."""
    depth = 0
    while path[depth] in piece:
        piece, depth = piece[path[depth]], depth + 1
    for key in reversed(path[depth + 1 :]):
        value = {key: value}
    grown = _size({path[depth]: value}) - 2 + (2 if piece else 0)
    piece[path[depth]] = value
    return grown


def split_nested(value: Any, largest: int, least: int) -> list[dict]:
    """Objects that together are ``value``, every member under its whole path; lists become objects keyed by place.

    Members are taken in order. One that is shorter than what the piece has left of ``largest`` characters goes in whole. Any other is
    taken apart into its own members, and if the piece has ``least`` characters by then, the next begins before. A scalar (or an empty
    object) can't be taken apart and goes in as it is: only such a member, and the keys above it, bring a piece beyond ``largest``.
    A value that is a scalar or empty has no pieces.
    """
    pieces: list[dict] = [{}]
    size = 2
    value = _keyed(value)
    open_ = [iter(value.items())] if isinstance(value, dict) else []
    path: list[str] = []
    while open_:
        member = next(open_[-1], None)
        if member is None:
            open_.pop()
            if path:
                path.pop()
            continue
        key, inner = member
        if _size({key: inner}) >= largest - size:
            if size >= least:
                pieces.append({})
                size = 2
            if isinstance(inner, dict) and inner:
                path.append(key)
                open_.append(iter(inner.items()))
                continue
        size += _put(pieces[-1], [*path, key], inner)
    return pieces if pieces[-1] else pieces[:-1]


def json_pieces(text: Column, largest: int = 2000, least: int | None = None) -> Column:
    """The pieces of each JSON text as JSON texts, in order (``split_nested``); null if the text is null or no JSON.

    Sizes follow the surveyed defaults: a piece may have twice ``largest`` characters, and begins anew from ``least`` on, which is
    200 below ``largest`` and at least 50 if it isn't given. A text stands whole in its task; other rows are never needed.
    """
    return F.udf(_splitter(2 * largest, max(largest - 200, 50) if least is None else least), "array<string>", useArrow=True)(text)


def _splitter(largest: int, least: int) -> Callable[[str | None], list[str] | None]:
    def split(text: str | None) -> list[str] | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        return None if text is None else [json.dumps(p, ensure_ascii=False) for p in split_nested(value, largest, least)]

    return split
