"""Pandas frames on their way back to Spark."""

from __future__ import annotations

import pandas as pd


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """A frame whose text columns hold Python objects. Columns of pandas' own text type may consist of several chunks, or none, which can't be sent as one batch."""
    texts = [c for c in frame.columns if isinstance(frame[c].dtype, pd.StringDtype)]
    return frame.astype(dict.fromkeys(texts, object)) if texts else frame
