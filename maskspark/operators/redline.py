"""What a mask changed, word by word, as HTML for a reviewer."""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_runs = re.compile(r"\s+|\S+").findall


def marked(original: str, masked: str) -> str:
    """The original with removed words in <del> and new ones in <ins>."""
    a, b = _runs(original), _runs(masked)
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        old, new = html.escape("".join(a[i:j])), html.escape("".join(b[k:m]))
        if kind == "equal":
            out.append(old)
        else:
            out.append((f"<del>{old}</del>" if old else "") + (f"<ins>{new}</ins>" if new else ""))
    return "".join(out)


def page(original: str, masked: str, title: str = "", facts: dict[str, str] | None = None) -> str:
    """A whole HTML page."""
    items = " | ".join(f"{html.escape(k)}: {html.escape(str(v))}" for k, v in (facts or {}).items())
    style = "del{background:#fdd}ins{background:#dfd;text-decoration:none}pre{white-space:pre-wrap}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><p>{items}</p><pre>{marked(original, masked)}</pre></body></html>'


def redline(original: Column, masked: Column) -> Column:
    """marked() of two columns; null where either is null."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else marked(x, y) for x, y in zip(a, b)])

    return run(original, masked)
