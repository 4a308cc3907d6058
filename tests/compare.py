"""Side-by-side run of a registered query and its oracle SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def _family(dtype, values) -> str:
    """Coarse type family; all-null columns match anything."""
    if values.isna().all():
        return "any"
    kind = getattr(dtype, "kind", "O")
    if kind == "b" or all(isinstance(v, bool) for v in values.dropna().head(5)):
        return "bool"
    if kind in "iuf":
        return "number"
    return "text"


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> list[str]:
    """Empty when both hold the same rows under the same names and type families."""
    found = []
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(duck_frame.columns)}"]
    if len(spark_frame) != len(duck_frame):
        found.append(f"rows {len(spark_frame)} != {len(duck_frame)}")
    for name in spark_frame.columns:
        a = _family(spark_frame[name].dtype, spark_frame[name])
        b = _family(duck_frame[name].dtype, duck_frame[name])
        if "any" not in (a, b) and a != b:
            found.append(f"type of {name}: {a} != {b}")
    left, right = _rows(spark_frame), _rows(duck_frame)
    if left != right:
        shown = [(x, y) for x, y in zip(left, right) if x != y][:2]
        found.append(f"values differ, {sum(x != y for x, y in zip(left, right))} rows; columns {sorted(spark_frame.columns)}; first {shown}")
    return found
