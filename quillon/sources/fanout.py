"""Calls of remote services from tasks: a few at once, tried again with growing pauses, with errors as rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.batches import bounded

#: Calls at once in a task, tries of a call, and seconds before the second try.
PARALLEL, ATTEMPTS, BASE_S = 4, 3, 0.5


def fan_out(
    df: DataFrame, call: Callable[[dict], str | None], out_col: str, parallel: int = PARALLEL, attempts: int = ATTEMPTS, base_s: float = BASE_S, jitter_s: float = 0.1, fatal: tuple[type[Exception], ...] = ()
) -> DataFrame:
    """df with out_col, what call(row) gives, `error` (of the last try; null where one worked) and `tries`. A task runs `parallel` calls at once and
    holds a batch of rows (see bounded). A failed call is tried again after base_s * 2^n seconds and some jitter, but not after errors that are fatal. Tasks that are run again call
    again, so calls must bear that."""

    def one(row: dict) -> tuple[str | None, str | None, int]:
        for n in range(attempts):
            try:
                return call(row), None, n + 1
            except Exception as e:  # any failure is a row's own
                error = f"{type(e).__name__}: {e}"
                if n + 1 == attempts or isinstance(e, fatal):
                    return None, error, n + 1
                time.sleep(base_s * 2**n + random.uniform(0, jitter_s))
        return None, "no attempt", 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for pdf in batches:
                done = list(pool.map(one, pdf.to_dict("records")))
                yield pdf.assign(**{out_col: [x[0] for x in done], "error": [x[1] for x in done], "tries": [x[2] for x in done]})

    bounded(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, `{out_col}` string, error string, tries int")
