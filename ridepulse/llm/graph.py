"""Connected components by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.llm.common import written


def _between(links: DataFrame) -> DataFrame:
    """Distinct links (a < b)."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _renamed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links`` between the labels (node, comp) of their ends; one end at a time, so that AQE can split a hot node's rows."""
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias(end), F.col("comp").alias("to"))
        links = written(links.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to"), "links")
    return _between(links)


def _trees(links: DataFrame) -> DataFrame:
    """(node, comp): every node hangs on its smallest neighbour if that is smaller; comp is the root of its tree."""
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
                     .select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        jumped = written(labels.join(up, F.col("comp") == F.col("up")).select("node", F.col("top").alias("comp"), F.col("comp").alias("old")),
                         "labels")
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> old").isEmpty():
            return labels


def _through(labels: DataFrame, of_labels: DataFrame) -> DataFrame:
    """``labels`` (node, comp), each comp replaced by its own label where it has one."""
    to = of_labels.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b long): comp is the smallest node of its component.

    Each round a tree becomes one node and the links inside it go, so at most half of a component's nodes are left and
    links are read in full by the first round only.  The chains inside the trees close in a logarithmic number of
    jumps.  A node with very many links is combined before the shuffle.
    """
    rest, found = written(_between(links), "links"), None
    while True:
        trees = _trees(rest)
        found = trees if found is None else written(_through(found, trees), "labels")
        rest = written(_renamed(rest, trees), "links")
        if rest.isEmpty():
            return found


def grown(comp: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``comp`` (node, comp) with the links ``more`` (a, b) added: only links between components are looked at."""
    part = components(_renamed(more, comp))
    new = part.join(comp.select("node"), "node", "left_anti")
    return written(_through(comp, part).unionByName(new), "labels")
