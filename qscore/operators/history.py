"""Commit graphs: what can be reached from a commit, ranges of commits, and merge bases.

The graph is cut into chains along first parents; a parent goes on to one of its children, the others start
chains of their own. What can be reached from a commit is then one place on each chain it leads to (all
before it on the chain can be reached, too), however long the history is. Places on chains come from joins
whose jumps double; chains lead to each other in as many rounds as branches lie behind one another.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from qscore.shared import materialize

_ROUNDS = 200


def _met(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are both as many as commits. Places and links of like chains lie packed on disk, many
    million rows in a few megabytes, by which Spark would send them whole through the driver to all tasks."""
    return rows.join(others.hint("merge"), on, how)


class Graph(NamedTuple):
    """``places``: (repo, commit, chain, pos), pos 0 at the chain's oldest commit. ``links``: (repo, chain, pos,
    to_chain, to_pos) for each parent that lies on another chain."""

    places: DataFrame
    links: DataFrame


def graph(parents: DataFrame) -> Graph:
    """The graph of ``parents``: (repo, commit, nth, parent), a row for each parent of a commit, ``nth`` 0 for the
    first one; a commit without parents has one row with a null parent. Repeated rows count once. A parent that
    is no commit of the table, as in a shallow copy, is a commit without parents. A cycle raises an error."""
    rows = parents.select("repo", "commit", "nth", "parent").distinct()
    known = rows.where("parent is not null")
    commits = rows.select("repo", "commit").unionByName(known.select("repo", F.col("parent").alias("commit"))).distinct()
    # Of the children that a commit is the first parent of, the smallest goes on with its chain.
    on = known.where("nth = 0").groupBy("repo", "parent").agg(F.min("commit").alias("commit"))
    start = _met(commits, on, ["repo", "commit"], "left").select(
        "repo", "commit", F.coalesce("parent", "commit").alias("chain"), F.col("parent").isNotNull().cast("long").alias("pos")
    )
    places = materialize(start, "commit-places")
    for _ in range(commits.count().bit_length() + 1):
        far = places.select("repo", F.col("commit").alias("chain"), F.col("chain").alias("_next"), F.col("pos").alias("_more"))
        moved = _met(places, far, ["repo", "chain"]).select(
            "repo", "commit", F.col("_next").alias("chain"), (F.col("pos") + F.col("_more")).alias("pos"), F.col("_more")
        )
        moved = materialize(moved, "commit-places")
        places = moved.drop("_more")
        if not moved.where("_more > 0").select("repo").take(1):
            break
    else:
        raise ValueError("the history has a cycle")
    to = places.select("repo", F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    links = _met(_met(known, places, ["repo", "commit"]), to, ["repo", "parent"]).where("chain <> to_chain")
    return Graph(places, materialize(links.select("repo", "chain", "pos", "to_chain", "to_pos").distinct(), "commit-links"))


def _reach(of: Graph, tips: DataFrame) -> DataFrame:
    """(id, repo, chain, pos): the last commit of each chain that can be reached from ``tips`` (id, repo, commit)."""
    now = materialize(_met(tips, of.places, ["repo", "commit"]).select("id", "repo", "chain", "pos").distinct(), "reach")
    links = of.links.withColumnRenamed("pos", "_from")
    new = now
    for _ in range(_ROUNDS):
        # Only what the last round brought can bring more.
        more = _met(new, links, ["repo", "chain"]).where("_from <= pos")
        more = more.select("id", "repo", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"))
        both = now.select("*", F.lit(True).alias("_old")).unionByName(more.select("*", F.lit(False).alias("_old")))
        old = F.coalesce(F.max(F.when(F.col("_old"), F.col("pos"))), F.lit(-1))
        both = both.groupBy("id", "repo", "chain").agg(F.max("pos").alias("pos"), old.alias("_was"))
        both = materialize(both, "reach")
        now, new = both.drop("_was"), both.where("pos > _was").drop("_was")
        if not new.select("id").take(1):
            return now
    raise ValueError("the history has a cycle, or too many branches behind one another")


def reachable(of: Graph, tips: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(id, repo, commit): the commits that can be reached from ``tips`` (id, repo, commit), themselves included, and
    not from ``without`` of the same id; with one tip each this is ``without..tip``. An id may have several of
    either. A tip that is no commit reaches nothing."""
    found = _reach(of, tips).withColumnRenamed("pos", "_to")
    if without is None:
        found = found.withColumn("_after", F.lit(-1))
    else:
        less = _reach(of, without).withColumnRenamed("pos", "_after")
        found = _met(found, less, ["id", "repo", "chain"], "left").withColumn("_after", F.coalesce("_after", F.lit(-1)))
    # Chains of which nothing is left would meet all their commits for none.
    found = found.where("_to > _after")
    return _met(of.places, found, ["repo", "chain"]).where("pos > _after and pos <= _to").select("id", "repo", "commit")


def merge_bases(of: Graph, pairs: DataFrame) -> DataFrame:
    """(id, repo, commit): the best common ancestors of ``pairs`` (id, repo, base, target): those that no other
    common ancestor descends from. Histories without a common commit have none; criss-cross merges several."""
    sides = [
        _reach(of, pairs.select("id", "repo", F.col(c).alias("commit"))).select("id", "repo", "chain", F.col("pos").alias(f"_{c}"))
        for c in ("base", "target")
    ]
    common = _met(*sides, ["id", "repo", "chain"])
    common = materialize(common.select("id", "repo", "chain", F.least("_base", "_target").alias("pos")), "common-ancestors")
    # A common ancestor that another one leads to is led to from the chain's own last common ancestor, in one step.
    links = of.links.withColumnRenamed("pos", "_from")
    led = _met(common, links, ["repo", "chain"]).where("_from <= pos")
    led = led.groupBy("id", "repo", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("_led"))
    best = _met(common, led, ["id", "repo", "chain"], "left").where("_led is null or _led < pos")
    return _met(best, of.places, ["repo", "chain", "pos"]).select("id", "repo", "commit")
