"""Theta joins on substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that one expression in the scan matches.
SHORT = 500
#: Characters of a gram.
GRAM = 3


def grams(low: Column, size: int) -> Column:
    """The different runs of so many characters in a text: none in shorter ones."""
    n = F.length(low) - size + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(low, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def filed(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, low, gram) of names (name, low: lower case, not empty), each under the gram of its own that fewest texts (low) hold; names shorter than a
    gram under themselves."""
    long = names.where(F.length("low") >= GRAM).withColumn("gram", F.explode(grams(F.col("low"), GRAM)))
    held = texts.select(F.explode(grams(F.col("low"), GRAM)).alias("gram")).join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram"))
    long = long.join(held, "gram", "left").groupBy("name", "low").agg(rarest.alias("r")).select("name", "low", F.col("r.gram").alias("gram"), F.col("r.texts").alias("texts"))
    long = long.where("texts > 0").drop("texts")  # a gram in no text: no text holds the name
    return long.unionByName(names.where(F.length("low") < GRAM).select("name", "low", F.col("low").alias("gram")))


def holding(df: DataFrame, text_col: str, names: DataFrame, name_col: str, short: int = SHORT) -> DataFrame:
    """Rows of df, once for each different name that their text holds, with the name; case doesn't matter.

    The list's size is checked: a short one is matched by one expression in the scan. A longer one becomes an inverted index: each
    name is filed under its rarest gram, each text emits its different grams (as many as it has characters, at most three times over), and what meets there
    is verified: exact for any number of names, which may be larger than memory. Texts travel as hashes until their names are known.
    Null texts and names match nothing; an empty name is in every text."""
    single = names.select(F.col(name_col)).where(F.col(name_col).isNotNull()).distinct()
    few = [r[0] for r in single.limit(short + 1).collect()]
    low = F.lower(F.col(text_col))
    if len(few) <= short:
        found = F.filter(F.array(*(F.lit(c) for c in sorted(few))).cast("array<string>"), lambda c: F.contains(low, F.lower(c)))
        return df.where(F.col(text_col).isNotNull()).withColumn(name_col, F.explode(found))
    texts = df.where(F.col(text_col).isNotNull())
    emitted = texts.select(F.xxhash64(text_col).alias("__text"), low.alias("low"))
    named = single.select(F.col(name_col).alias("name"), F.lower(name_col).alias("low"))
    index = filed(named.where("low <> ''"), emitted)
    every = F.flatten(F.array(*(grams(F.col("low"), n) for n in range(1, GRAM + 1))))
    met = emitted.select("__text", F.explode(every).alias("gram")).join(index, "gram").select("__text", "name", "low").distinct()
    if not named.where("low = ''").isEmpty():
        met = met.unionByName(emitted.select("__text", F.lit("").alias("name"), F.lit("").alias("low")).distinct())
    kept = met.select("__text", F.col("name").alias("__name"), F.col("low").alias("__low"))
    both = texts.withColumn("__text", F.xxhash64(text_col)).join(kept, "__text").where(F.contains(low, F.col("__low")))
    return both.withColumn(name_col, F.col("__name")).drop("__text", "__name", "__low")
