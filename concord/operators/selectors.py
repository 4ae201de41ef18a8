"""Selectors evaluated against whole pages: which elements of its page does each of them match?

An element is the interval of the nodes it holds, from its own number to that of the last node inside it (``node_id`` to
``last_id``), so one element lies in another where its number lies in the other's interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(inner: str, outer: str) -> Column:
    """Whether the node of the table ``inner`` lies inside the element of the table ``outer`` of the same page."""
    i, o = f"{inner}.node_id", f"{outer}.node_id"
    return (F.col(f"{inner}.page_id") == F.col(f"{outer}.page_id")) & (F.col(i) > F.col(o)) & (F.col(i) <= F.col(f"{outer}.last_id"))


def nearest(nodes: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the innermost element of ``outer`` around each as ``name``; those that lie in none are left out."""
    i, o = nodes.select("page_id", "node_id").alias("i"), outer.select("page_id", "node_id", "last_id").alias("o")
    found = i.join(o, within("i", "o")).groupBy("i.page_id", "i.node_id").agg(F.max("o.node_id").alias(name))
    return nodes.join(found, ["page_id", "node_id"])


def inside(nodes: DataFrame, outer: DataFrame, itself: bool = True) -> DataFrame:
    """(page_id, node_id) of the nodes inside an element of ``outer`` (or that are one), as much to be merged as nodes are."""
    i, o = nodes.select("page_id", "node_id").alias("i"), outer.select("page_id", "node_id", "last_id").alias("o")
    own = within("i", "o")
    if itself:
        own = (F.col("i.page_id") == F.col("o.page_id")) & F.col("i.node_id").between(F.col("o.node_id"), F.col("o.last_id"))
    return i.join(o, own, "left_semi").select("page_id", "node_id").hint("merge")


def class_names(c: Column) -> Column:
    """The classes of an attribute, each once."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\f\r]+"), lambda x: x != ""))


def matches(selectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(selector, page_id, node_id): what each of ``selectors(selector, page_id, container, tag, classes)`` matches.

    An element of the tag that has all the classes, whatever else it has; with a ``container`` (or null) only inside elements of that id.
    Of the classes of a selector the one that fewest elements of its page have is looked up, and the elements found are tried for
    the others.
    """
    held = nodes.select("page_id", "node_id", "tag", class_names(F.try_element_at("attrs", F.lit("class"))).alias("names"), F.try_element_at("attrs", F.lit("id")).alias("own_id"), "last_id")
    posted = held.select("page_id", "tag", "node_id", "names", F.explode(F.concat(F.array(F.lit("")), "names")).alias("name"))
    sizes = posted.groupBy("page_id", "tag", "name").agg(F.count("*").alias("n"))
    asked = selectors.select("selector", "page_id", "container", "tag", "classes", F.explode(F.concat(F.array(F.lit("")), "classes")).alias("name"))
    rarest = asked.join(sizes, ["page_id", "tag", "name"], "left").groupBy("selector", "page_id", "container", "tag", "classes").agg(F.min_by("name", F.struct(F.coalesce("n", F.lit(0)), "name")).alias("name"))
    found = rarest.join(posted, ["page_id", "tag", "name"]).where(F.size(F.array_except("classes", "names")) == 0).select("selector", "page_id", "container", "node_id")
    free = found.where("container is null").select("selector", "page_id", "node_id")
    boxes = held.where("own_id is not null").select("page_id", "node_id", "last_id", "own_id").alias("o")
    bound = found.where("container is not null").alias("i").join(boxes, within("i", "o") & (F.col("i.container") == F.col("o.own_id")), "left_semi")
    return free.union(bound.select("selector", "page_id", "node_id"))
