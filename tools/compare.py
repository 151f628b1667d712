"""Compare the rows of a Spark query and of its DuckDB SQL: exact columns equal, floats within a relative tolerance."""

from __future__ import annotations

import math

REL, ABS = 1e-7, 1e-9


def _plain(v):
    if type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if hasattr(v, "tolist"):
        return v.tolist()
    return v


def _key(row):
    exact = tuple((v is None, str(v)) for v in row if not isinstance(v, float))
    return exact, tuple("nan" if math.isnan(v) else f"{v:.4e}" for v in row if isinstance(v, float))


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=REL, abs_tol=ABS)
    return a == b


def difference(s_rows, s_cols, d_rows, d_cols) -> str | None:
    """What differs first, or None."""
    if sorted(s_cols) != sorted(d_cols):
        return f"columns {sorted(s_cols)} and {sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return f"{len(s_rows)} and {len(d_rows)} rows"
    pick = [sorted(range(len(c)), key=lambda i, c=c: c[i]) for c in (s_cols, d_cols)]
    a, b = (sorted((tuple(_plain(r[i]) for i in p) for r in rows), key=_key) for rows, p in zip((s_rows, d_rows), pick, strict=True))
    for x, y in zip(a, b, strict=True):
        if not all(map(_same, x, y)):
            return f"{x} and {y}"
    return None
