"""Edit distances with their operations, sequence similarity, and forms that no built-in expression offers: vectorised Arrow functions over Python's library."""

from __future__ import annotations

import difflib
import json
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.functions.text import collapse

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("substitutions", "deletions", "insertions", "errors")])


def edit_operations(reference: list, candidate: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a least-cost alignment; traced back preferring matches, then substitutions, deletions, insertions."""
    n, m = len(reference), len(candidate)
    if not n or not m:
        return 0, n, m
    alphabet = {x: k for k, x in enumerate(dict.fromkeys([*reference, *candidate]))}
    a, b = np.array([alphabet[x] for x in reference]), np.array([alphabet[x] for x in candidate])
    cost = np.empty((n + 1, m + 1), np.int32)
    step = np.arange(m + 1)
    cost[0] = step
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        # Insertions run along the row: the least of all earlier entries plus their distance.
        cost[i] = np.minimum.accumulate(row - step) + step
    subs = dels = ins = 0
    i, j = n, m
    while i or j:
        here = cost[i, j]
        if i and j and a[i - 1] == b[j - 1] and here == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif i and j and here == cost[i - 1, j - 1] + 1:
            subs, i, j = subs + 1, i - 1, j - 1
        elif i and here == cost[i - 1, j] + 1:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return subs, dels, ins


def _counted(reference: pd.Series, candidate: pd.Series, cut) -> pd.DataFrame:
    rows = []
    for r, c in zip(reference, candidate):
        if r is None or c is None:
            rows.append((None,) * 4)
        else:
            s, d, i = edit_operations(cut(r), cut(c))
            rows.append((s, d, i, s + d + i))
    return pd.DataFrame(rows, columns=COUNTS.names).astype("Int64")


@F.pandas_udf(COUNTS)
def character_edits(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    return _counted(reference, candidate, list)


@F.pandas_udf(COUNTS)
def word_edits(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    return _counted(reference, candidate, str.split)


def gestalt(a: str, b: str) -> float:
    """Twice the matching characters over all; the order of arguments matters."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else gestalt(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which no built-in expression offers."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Canonical composition with white space collapsed."""
    return collapse(nfc(text))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Full case folding with white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def _flat(value, path: str, out: dict[str, str]) -> dict[str, str]:
    if isinstance(value, dict):
        for k, v in value.items():
            _flat(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            _flat(v, f"{path}.{k}" if path else str(k), out)
    else:
        out[path] = json.dumps(value, ensure_ascii=False) if not isinstance(value, str) else value
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flat_json(text: pd.Series) -> pd.Series:
    """A JSON document's leaves by dotted path; null where the text is not JSON."""

    def one(t):
        try:
            return None if t is None else _flat(json.loads(t), "", {})
        except ValueError:
            return None

    return text.map(one)


def error_rate(errors: Column, length: Column) -> Column:
    """Errors over the reference's length; null for an empty reference."""
    return F.when(length > 0, errors / length)


def _unique(pairs: list[tuple]) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("repeated key")
    return dict(pairs)


def _no_constant(name: str):
    raise ValueError("not a finite number")


@F.pandas_udf(T.StringType())
def json_problem(text: pd.Series, fields: pd.Series) -> pd.Series:
    """Why a text is no strict JSON object of exactly the given fields: no text, no JSON, a repeated key, a number that is not finite, no object, or other fields; null if it is one."""

    def one(t, names):
        if t is None:
            return "no text"
        try:
            value = json.loads(t, object_pairs_hook=_unique, parse_constant=_no_constant)
        except json.JSONDecodeError:
            return "no JSON"
        except (ValueError, RecursionError) as problem:
            return str(problem)
        if not isinstance(value, dict):
            return "no object"
        return None if set(value) == set(names) else "other fields"

    return pd.Series([one(t, names) for t, names in zip(text, fields)], dtype=object)
