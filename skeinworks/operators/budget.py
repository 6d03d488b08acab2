"""Greedy choice under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Rows that compete for a budget at most; scopes hold 60 files.
MOST = 1000


def within_budget(ranked: DataFrame, order: list, cost: str, budget: int, keep: list[str], most: int = MOST) -> DataFrame:
    """Rows in order, each taken if it still fits; one that does not is skipped and later,
    smaller ones may follow. As the choice depends on every earlier one, it is made in one
    task, so no more than `most` rows may compete: more raise an error, none is dropped. Returns
    keep, cost, ord, used (tokens so far) and taken."""
    ranked = ranked.orderBy(*order).limit(most + 1)
    names = [f"k{i}" for i in range(len(order))]
    row = F.struct(*(c.alias(n) for c, n in zip(order, names)), F.struct(*keep, cost).alias("row"))
    items = ranked.agg(F.array_sort(F.collect_list(row)).alias("items"))
    too_many = F.raise_error(F.lit(f"more than {most} rows compete for a budget"))
    items = items.select(F.when(F.size("items") > most, too_many).otherwise(F.col("items")).alias("items"))
    schema = ranked.select(*keep, cost).schema.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<row:{schema},ord:int,used:bigint,taken:boolean>>").alias("rows"))

    def step(done, item):
        price = item["row"][cost].cast("long")
        fits = done["used"] + price <= budget
        used = done["used"] + F.when(fits, price).otherwise(0)
        entry = F.struct(item["row"].alias("row"), F.size(done["rows"]).alias("ord"), used.alias("used"), fits.alias("taken"))
        return F.struct(used.alias("used"), F.array_append(done["rows"], entry).alias("rows"))

    return items.select(F.explode(F.aggregate("items", start, step, lambda done: done["rows"])).alias("r")).select("r.row.*", "r.ord", "r.used", "r.taken")
