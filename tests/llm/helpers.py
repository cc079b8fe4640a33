"""Awkward documents, and brute-force versions of operators."""

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, v string, __spare int"


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", None, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
AWKWARD = [
    (1, "the quick brown fox. jumps\nover it"), (2, None), (3, ""), (4, "   \n\t "), (None, "lost words here"), (5, "the quick brown fox. jumps\nover it"),
    (5, "the quick brown fox. jumps\nover it"), (6, "Ünïcödé 漢字 🙂 x\x00y"), (7, LONG), (8, "a"), (9, "\n\n\n"), (10, "<|endoftext|> it's  I'LL"),
]


def rows(df, *order):
    return df.toPandas().sort_values(list(order) or df.columns, na_position="first").reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return a.astype(object).where(a.notna(), None).values.tolist() == b.astype(object).where(b.notna(), None).values.tolist()
