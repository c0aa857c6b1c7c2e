"""Copying a store of several tables into another, parents before children.

Rows: a null reference names no parent and is kept; a null key is no one's
parent; repeated rows are copied as they are; empty tables are copied empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.columns import column
from quirewise.operators.graph import checkpoint


@dataclass(frozen=True)
class Reference:
    """A column of one table that names rows of another by its key."""

    table: str
    column: str
    parent: str


def references(tables: dict[str, DataFrame], keys: dict[str, str], share: float = 0.5) -> list[Reference]:
    """References found by containment: a column that ends like another table's key and mostly holds its values.

    Names end alike from the last underscore on (``o_custkey`` and ``c_custkey``).
    Of a column's different values at least ``share`` must be keys of the parent;
    what is left over are orphans.
    """
    found = []
    for name, rows in tables.items():
        for field in rows.schema:
            for parent, key in keys.items():
                same_end = field.name.rsplit("_", 1)[-1].lower() == key.rsplit("_", 1)[-1].lower()
                if parent == name or not same_end or field.dataType != tables[parent].schema[key].dataType:
                    continue
                held = tables[parent].select(column(key).alias("v"), F.lit(1).alias("known")).distinct()
                values = rows.select(column(field.name).alias("v")).where("v IS NOT NULL").distinct()
                seen = values.join(held, "v", "left").agg(F.count("*").alias("n"), F.count("known").alias("k")).first()
                if seen.n and seen.k >= share * seen.n:
                    found.append(Reference(name, field.name, parent))
    return found


def parents_first(names: list[str], links: list[Reference]) -> list[str]:
    """Tables in an order in which each comes after those it names; of several the first in ``names``. A cycle is an error."""
    order: list[str] = []
    while len(order) < len(names):
        free = [n for n in names if n not in order and all(x.parent in order for x in links if x.table == n)]
        if not free:
            raise ValueError(f"tables name each other in a cycle: {sorted(set(names) - set(order))}")
        order.append(free[0])
    return order


@dataclass(frozen=True)
class Copied:
    """A copied table: its rows, how many were left behind because a parent is missing, and the next free number."""

    name: str
    place: int
    rows: DataFrame
    copied: int
    orphans: int
    next_number: int | None


def copy_store(
    old: dict[str, DataFrame], keys: dict[str, str], new_columns: dict[str, list[str]], links: list[Reference] | None = None
) -> list[Copied]:
    """The tables of an old store as a new one takes them, in the order of their references.

    ``new_columns`` names the new store's tables and their columns: what both
    stores have is copied, in the new order; a table that the old store lacks is
    skipped.  A row whose parent is missing, or was left behind itself, is an
    orphan and stays behind.  ``keys`` names the tables' numbered keys; the next
    free number follows the largest one.
    """
    names = [n for n in new_columns if n in old]
    known = {n: k for n, k in keys.items() if n in names}
    links = references({n: old[n] for n in names}, known) if links is None else [x for x in links if x.table in names and x.parent in names]
    done: dict[str, Copied] = {}
    for place, name in enumerate(parents_first(names, links)):
        rows = old[name]
        for link in (x for x in links if x.table == name):
            there = done[link.parent].rows.select(column(keys[link.parent]).alias("_parent")).distinct()
            stays = rows.where(column(link.column).isNull())
            named = rows.join(there, column(link.column) == F.col("_parent"), "left_semi")
            rows = named.unionByName(stays)
        rows = checkpoint(rows)
        kept = rows.count()
        key = known.get(name)
        top = rows.agg(F.max(column(key)).alias("m")).first().m if key else None
        shared = rows.select(*[column(c) for c in new_columns[name] if c in rows.columns])
        done[name] = Copied(name, place, shared, kept, old[name].count() - kept, None if key is None else (top or 0) + 1)
    return list(done.values())
