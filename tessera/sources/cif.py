"""mmCIF loops: a tokeniser in Python, one whole text per row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"""'(?:[^'\n]|'(?=\S))*'(?=\s|$)|"(?:[^"\n]|"(?=\S))*"(?=\s|$)|\#[^\n]*|^;.*?^;|\S+""", re.M | re.S)


def tokens(text: str) -> Iterator[str]:
    for m in TOKEN.finditer(text):
        t = m[0]
        if t.startswith("#"):
            continue
        if t[0] in "'\"" and t[-1] == t[0] and len(t) > 1:
            t = "\0" + t[1:-1]  # a quoted value is never a keyword
        elif t[0] == ";" and t.endswith(";") and len(t) > 1:
            t = "\0" + t[1:-1].strip("\n")
        yield t


def loops(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """(names, rows) of each loop_."""
    names: list[str] = []
    values: list[str] = []
    within = False
    for t in [*tokens(text), "loop_"]:
        word = t.lower()
        if word == "loop_" or word.startswith("data_") or within and values and t.startswith("_"):
            if within and names:
                n = len(names)
                yield names, [values[k : k + n] for k in range(0, len(values) - n + 1, n)]
            names, values, within = [], [], word == "loop_"
        elif within and t.startswith("_") and not values:
            names.append(word)
        elif within:
            values.append(t.removeprefix("\0"))


def table_rows(text: str, category: str, columns: list[str]) -> list[dict]:
    """Rows of a category's loop; a column may list fallbacks parted by |."""
    for names, rows in loops(text):
        if names and names[0].startswith(f"_{category}."):
            at = {n.partition(".")[2]: k for k, n in enumerate(names)}
            pick = {c: next((at[x] for x in c.split("|") if x in at), None) for c in columns}
            clean = lambda v: None if v in (".", "?") else v
            return [{c: None if k is None else clean(r[k]) for c, k in pick.items()} for r in rows]
    return []


def cif_table(texts: DataFrame, category: str, columns: dict[str, str]) -> DataFrame:
    """unit and the named columns as strings. texts: unit, value (a whole file); columns: output name -> column, fallbacks parted by |."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, text in zip(b.column("unit").to_pylist(), b.column("value").to_pylist(), strict=True):
                rows = table_rows(text or "", category, list(columns.values()))
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], pa.string()) for c in columns.values())], ["unit", *columns])

    return texts.selectExpr("cast(unit as string) unit", "value").mapInArrow(run, "unit string, " + ", ".join(f"{c} string" for c in columns))
