"""Joins: candidate restriction, search paths over hops, owners of changed rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagewright.model import Entity, Hop, Tables

#: Candidate lists up to this length are broadcast; longer ones are joined as Spark sees fit.
MOST_BROADCAST = 100_000


def candidate_frame(base: DataFrame, entity: Entity, keys: Sequence[Any]) -> DataFrame:
    """Candidate keys with the key's own types; a key of several parts is a tuple."""
    schema = StructType([StructField(c, base.schema[c].dataType) for c in entity.key_columns])
    rows = [k if isinstance(k, (tuple, list)) else (k,) for k in keys]
    return base.sparkSession.createDataFrame([tuple(r) for r in rows], schema)


def restrict(df: DataFrame, entity: Entity, keys: Sequence[Any]) -> DataFrame:
    """Rows whose key is a candidate. Repeated candidates do not repeat rows; an empty list leaves none."""
    if not keys:
        return df.limit(0)
    wanted = candidate_frame(df, entity, keys)
    return df.join(F.broadcast(wanted) if len(keys) <= MOST_BROADCAST else wanted, list(entity.key_columns), "left_semi")


def hop_table(tables: Tables, hop: Hop, with_where: bool = True) -> DataFrame:
    df = tables(hop.table)
    if with_where and hop.where:
        df = df.alias(hop.alias).filter(F.expr(hop.where.replace("{c}", hop.alias)))
    return df


def along(tables: Tables, base: DataFrame, key: Sequence[str], hops: Sequence[Hop], column: str, kind: str = "inner", with_where: bool = True) -> DataFrame:
    """(key..., value) of a field at the end of hops; several rows where a hop leads to several.

    Each table is cut down to its link columns before it is joined, so a wide table never travels whole.
    """
    first = hops[0]
    link = first.referenced_key if first.many else first.foreign_key
    now = base.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(link).alias("_link"))
    for i, hop in enumerate(hops):
        table = hop_table(tables, hop, with_where)
        target = hop.foreign_key if hop.many else hop.referenced_key
        if i + 1 < len(hops):
            onward = hops[i + 1].referenced_key if hops[i + 1].many else hops[i + 1].foreign_key
        else:
            onward = column
        right = table.select(F.col(target).alias("_to"), F.col(onward).alias("_next"))
        now = now.join(right, now["_link"] == right["_to"], kind).select(*[f"_k{j}" for j in range(len(key))], F.col("_next").alias("_link"))
    return now.select(*[F.col(f"_k{j}").alias(c) for j, c in enumerate(key)], F.col("_link").alias("value"))


def owners_with(tables: Tables, base: DataFrame, key: Sequence[str], hops: Sequence[Hop], leaf: DataFrame) -> DataFrame:
    """(key..., score): the least _score that each owner reaches over hops, from the scored rows of the last table back.

    Scores are reduced to one per link before each join, so a table on the way meets no more rows than have a score.
    """
    last = hops[-1]
    least = lambda df, link: df.groupBy(F.col(link).alias("_link")).agg(F.min("_score").alias("_score"))
    now = least(leaf, last.foreign_key if last.many else last.referenced_key)
    for i in range(len(hops) - 1, 0, -1):
        hop, before = hops[i], hops[i - 1]
        here = hop.referenced_key if hop.many else hop.foreign_key
        back = before.foreign_key if before.many else before.referenced_key
        table = hop_table(tables, before).select(F.col(here).alias("_at"), F.col(back).alias("_back"))
        now = least(table.join(now, table["_at"] == now["_link"]), "_back")
    first = hops[0]
    start = first.referenced_key if first.many else first.foreign_key
    owners = base.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(start).alias("_at"))
    return owners.join(now, owners["_at"] == now["_link"]).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)], F.col("_score").alias("score"))


def owners_of(tables: Tables, entity: Entity, hops: Sequence[Hop], changed: DataFrame) -> DataFrame:
    """Distinct owner keys of changed rows of the table at the end of hops.

    changed holds rows of that table, old and new images alike, so the owner that a row was moved away from is
    found too. A direct child row names its owner itself if its foreign key is the owner's key.
    """
    last = hops[-1]
    now = changed.select(F.col(last.foreign_key if last.many else last.referenced_key).alias("_link")).distinct()
    for i in range(len(hops) - 1, 0, -1):
        hop, before = hops[i], hops[i - 1]
        table = tables(before.table)
        here = hop.referenced_key if hop.many else hop.foreign_key
        back = before.foreign_key if before.many else before.referenced_key
        right = table.select(F.col(here).alias("_at"), F.col(back).alias("_back"))
        now = now.join(right, now["_link"] == right["_at"]).select(F.col("_back").alias("_link")).distinct()
    first = hops[0]
    start = first.referenced_key if first.many else first.foreign_key
    if first.many and entity.key_columns == (start,):
        return now.filter("_link is not null").select(F.col("_link").alias(start)).distinct()
    base = tables(entity.table)
    keys = base.select(F.col(start).alias("_at"), *entity.key_columns)
    return keys.join(now, keys["_at"] == now["_link"], "left_semi").select(*entity.key_columns).distinct()
