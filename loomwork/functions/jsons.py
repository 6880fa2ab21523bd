"""JSON texts changed by JSON texts. Depth is open, so each row is read and written by a small step in Python, on Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(target: object, patch: object) -> object:
    """target after a merge patch: objects are merged key by key, null takes a key away, and anything else stands for what was there."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merged(out.get(key), value)
    return out


def filled(target: object, values: object) -> object:
    """target with the keys of values, other than those whose value is null or a blank text."""
    out = dict(target) if isinstance(target, dict) else {}
    if isinstance(values, dict):
        out |= {k: v for k, v in values.items() if v is not None and not (isinstance(v, str) and not v.strip())}
    return out


def _apply(change: Callable[[object, object], object]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("string")
    def run(target: pd.Series, change_by: pd.Series) -> pd.Series:
        def one(t: str | None, c: str | None) -> str | None:
            if c is None:
                return t
            try:
                return json.dumps(change(None if t is None else json.loads(t), json.loads(c)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return pd.Series([one(t, c) for t, c in zip(target, change_by, strict=True)], dtype=object)

    return lambda a, b: run(a.cast("string"), b.cast("string"))


def merge_patch(target: Column, patch: Column) -> Column:
    """target, a JSON text, after patch (see merged), in compact form; keys keep their order, new ones come after. A null target counts as nothing, a null patch
    changes nothing, and what is no JSON gives null."""
    return _apply(merged)(target, patch)


def merge_filled(target: Column, values: Column) -> Column:
    """target with the keys of values that are not blank (see filled); nulls and broken texts as in merge_patch."""
    return _apply(filled)(target, values)


def array_size(value: Column, path: str) -> Column:
    """How many elements the array at a JSON path has; null where there is no array. In columns only."""
    return F.array_size(F.try_variant_get(F.try_parse_json(value), path, "array<variant>"))
