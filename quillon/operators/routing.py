"""Where a plan goes next, from the fields of its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES = 10


def _set(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def refine(validation_error: Column, execution_error: Column, generation_error: Column, retries: Column) -> Column:
    any_error = _set(validation_error) | _set(execution_error) | _set(generation_error)
    return F.when(any_error & (F.coalesce(retries, F.lit(0)) < RETRIES), "refine").otherwise("respond")


def wider(execution_error: Column, results: Column, query_type: Column, retries: Column) -> Column:
    empty = F.coalesce(results, F.lit(0)) == 0
    first = F.coalesce(query_type, F.lit("initial")) == "initial"
    return F.when(_set(execution_error), "wider_search").when(empty & first & (F.coalesce(retries, F.lit(0)) < RETRIES), "wider_search").otherwise("respond")


def keep_widening(execution_error: Column, results: Column, retries: Column) -> Column:
    more = _set(execution_error) | (F.coalesce(results, F.lit(0)) == 0)
    return F.when(more & (F.coalesce(retries, F.lit(0)) < RETRIES), "wider_search").otherwise("respond")


def after_validation(validation_error: Column, query_type: Column) -> Column:
    return F.when(_set(validation_error), "refine_sql").when(query_type == "wider_search", "execute_wider_search").otherwise("execute_sql")


def after_tools(databases_off: Column, calls: Column, use_results: Column, results: Column) -> Column:
    has_calls, has_results = F.coalesce(calls, F.lit(0)) > 0, F.coalesce(results, F.lit(0)) > 0
    off = F.coalesce(databases_off, F.lit(False))
    prompt = off & ~has_calls & F.coalesce(use_results, F.lit(False)) & has_results
    return (
        F.when(prompt, "generate_prompt").when(off, "execute_mcp_tool_calls_and_return")
        .when(has_calls & has_results, "return_mcp_response_to_llm").otherwise("generate_sql")
    )


def iterate(can_answer: Column, iteration: Column, most: Column) -> Column:
    return F.when(F.coalesce(can_answer, F.lit(False)), "generate_final_answer").when(iteration < most, "plan_refined_queries").otherwise("generate_failure_response")


def reduce_states(deltas: DataFrame, key: str, seq: str, replace: list[str] = (), append: list[str] = (), add: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """One state per key from deltas in order of seq: the last value of some fields, all values of others in order, sums,
    and first values. Nodes return deltas, not whole states, so nothing is counted twice."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in replace]
    ordered = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, F.col(c).alias("value")))))
    aggs += [F.transform(ordered(c), lambda x: x["value"]).alias(c) for c in append]
    aggs += [F.sum(c).alias(c) for c in add]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep]
    return deltas.groupBy(key).agg(*aggs)
