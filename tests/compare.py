"""Spark rows against SQL rows."""

import math

import pandas as pd


def table_rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r))
    return sorted(out)


def close(a: list[tuple], b: list[tuple]) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if p != q:
                try:
                    if not math.isclose(float(p), float(q), abs_tol=2e-6, rel_tol=1e-9):
                        return False
                except ValueError:
                    return False
    return True
