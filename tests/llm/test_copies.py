"""Exact copies of one text are not gathered."""

from helpers import docs
from pyspark.sql import functions as F
from test_ops import check_substrings

from quillon.llm import substring_dedup


def test_copies_send_one_text(spark):
    """A task that reads a text again prints its id alone, and one copy of all goes through the automata."""
    text = " ".join(f"w{i}" for i in range(200))
    df = docs(spark, [(i, text) for i in range(500)]).select("doc_id", "text").repartition(2)
    prints = substring_dedup._prints(df)
    ids, phrases = prints.where("phrase is null"), prints.where("phrase is not null")
    assert ids.count() == 500 and phrases.count() <= 2 * 200 and phrases.agg(F.countDistinct("key")).first()[0] == 1
    least = ids.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"))
    other = docs(spark, [(1000, "z " + text)]).select("doc_id", "text")
    both = df.unionByName(other)
    prints = substring_dedup._prints(both)
    least = prints.where("phrase is null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"))
    sent = substring_dedup._dealt(both, prints, least, 4096, 500_000).where("phrase is null").select("doc_id").distinct()
    assert sorted(r[0] for r in sent.collect()) == [0, 1000]
    lost = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_words(both).collect()}
    assert lost[0] == 0 and all(lost[i] == 200 for i in [*range(1, 500), 1000])


def test_copies_lose_all_but_the_first(spark):
    text = " ".join(f"w{i}" for i in range(120))
    data = [(i, text) for i in (9, 4, 4, 12, 30, None)] + [(7, "start " + text), (3, "x " * 30 + text[:300]), (5, "short text"), (6, "short text"), (8, "start " + text)]
    check_substrings(spark, data)
