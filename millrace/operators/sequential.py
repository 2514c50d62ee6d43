"""State machines over the rows of a key in order, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions.frames import plain


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], schema: str, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """Rows of schema that step(state, row) returns for each row of a key, in order, with those of finish(state) at a key's end.

    A key's rows pass one task one Arrow batch after another and only its state is kept, so a key may be of any size; different keys go to different tasks.
    schema starts with the keys. Rows with null keys form a key of their own; ties in order go by all other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order and not dict(df.dtypes)[c].startswith(("map", "variant"))]
    columns = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                own = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if own != key:
                    if key is not None and finish:
                        out += [(*key, *r) for r in finish(state)]
                    key, state = own, start()
                out += [(*own, *r) for r in step(state, row)]
            yield plain(pd.DataFrame(out, columns=columns))
        if key is not None and finish:
            yield plain(pd.DataFrame([(*key, *r) for r in finish(state)], columns=columns))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order, *rest).mapInPandas(run, schema)
