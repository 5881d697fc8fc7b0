"""What each module gives out, re-exports followed to their end: pointer doubling over all repositories at once.

A name of a module has a definition there, or takes (imports) from other names, or both. Its value is that of its last
take that leads to a definition, whatever the order of files, else its own definition. So every name points to one
other, and a chain of n takes is followed in log2(n) rounds.

Names that take from one another in a circle have no such end. There the rule is the one of reading files in order, each
statement replacing what the name stood for, three times over (``PASSES``): a name that stands later in the order sees
the values of this pass, an earlier one those of the pass before. Only names with a definition of their own count in
that; the others hand on what they take. A circle without any definition gives nothing, and takes from it are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

PASSES = 3


def chain_ends(steps: DataFrame) -> DataFrame:
    """key, to: where the chain of ``steps`` (key, to; one for each key) that begins at a key ends.

    The end has no step. A chain without an end, one that leads into a circle, gets some key of the circle, and every key
    of a circle is then the ``to`` of one key at least.
    """
    at = materialise(steps.select("key", "to"), "ends")
    rounds = at.count().bit_length()
    for _ in range(rounds):
        ahead = at.select(F.col("key").alias("to"), F.col("to").alias("next"))
        after = materialise(at.join(ahead, "to", "left").select("key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "ends")
        at = after.select("key", "to")
        if after.filter("moved").isEmpty():
            break
    return at


def follow(own: DataFrame, takes: DataFrame) -> DataFrame:
    """key, node: what each name stands for. ``own``: key, node. ``takes``: key, src, at; ``at`` is a total order of all
    statements of a repository, and the last of a key's comes first."""
    own = materialise(own.select("key", "node"), "own")
    defined = own.select("key")
    takes = materialise(takes.select("key", "src", "at").distinct(), "takes")
    while True:
        takes, steps = _live(defined, takes)
        if steps.isEmpty():
            return own
        ends = chain_ends(steps)
        circles = materialise(ends.select(F.col("to").alias("key")).distinct().join(steps.select("key"), "key", "left_semi"), "circles")
        if circles.isEmpty():
            return _valued(own, ends)
        ring = materialise(steps.join(circles, "key", "left_semi").join(defined.withColumn("defines", F.lit(True)), "key", "left"), "ring")
        # names of a circle without a definition hand on: what the next defining name is for each of them
        handed = chain_ends(ring.filter("defines IS NULL").select("key", "to"))
        hollow = materialise(handed.join(defined, handed["to"] == defined["key"], "left_anti").select("key"), "hollow")
        if hollow.isEmpty():
            settled = _turned(own, ring, handed)
            rest = chain_ends(steps.join(settled.select("key"), "key", "left_anti"))
            still = own.join(settled.select("key"), "key", "left_anti").unionByName(settled)
            return _valued(still, rest)
        # a circle of imports alone: what its names take last leads nowhere
        last = takes.join(hollow, "key", "left_semi").groupBy("key").agg(F.max("at").alias("at"))
        takes = materialise(takes.join(last, ["key", "at"], "left_anti"), "takes")


def _live(defined: DataFrame, takes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """takes without those that lead to no definition and no choice, and each key's last take as a step (key, to, at)."""
    n = takes.count()
    while True:
        # a name with one take and no definition hands on what it takes; whole chains of these are judged by their end
        many = takes.groupBy("key").agg(F.count("*").alias("n"))
        lone = takes.join(many.filter("n = 1"), "key", "left_semi").join(defined, "key", "left_anti").select("key", F.col("src").alias("to"))
        stops = defined.unionByName(many.filter("n > 1").select("key")).distinct()
        handed = chain_ends(lone)
        good = stops.unionByName(handed.join(stops, handed["to"] == stops["key"], "left_semi").select("key")).distinct()
        takes = materialise(takes.join(good.select(F.col("key").alias("src")), "src", "left_semi").select("key", "src", "at"), "takes")
        left = takes.count()
        if left == n:
            break
        n = left
    steps = takes.groupBy("key").agg(F.max_by("src", "at").alias("to"), F.max("at").alias("at"))
    return takes, materialise(steps, "steps")


def _valued(own: DataFrame, ends: DataFrame) -> DataFrame:
    """own's values for the keys that end there, and for those without a chain."""
    reached = ends.join(own.select(F.col("key").alias("to"), "node"), "to").select("key", "node")
    return materialise(reached.unionByName(own.join(ends.select("key"), "key", "left_anti")), "exports")


def _turned(own: DataFrame, ring: DataFrame, handed: DataFrame) -> DataFrame:
    """key, node of the defining names of circles after ``PASSES`` passes over the files.

    A name in a pass takes from the next name in the same pass, if that one comes earlier, else in the pass before;
    before the first pass every name has its own definition. These steps have an end, so they are chains again.
    """
    firm = ring.filter("defines")
    ahead = firm.join(handed.select(F.col("key").alias("to"), F.col("to").alias("through")), "to", "left").select("key", "at", F.coalesce("through", "to").alias("to"))
    both = ahead.join(firm.select(F.col("key").alias("to"), F.col("at").alias("their")), "to")
    late = (F.col("their") >= F.col("at")).cast("int")
    passes = F.explode(F.sequence(F.lit(1), F.lit(PASSES))).alias("pass")
    steps = both.select("key", "to", late.alias("late"), passes)
    steps = steps.select(F.struct("key", "pass").alias("key"), F.struct(F.col("to").alias("key"), (F.col("pass") - F.col("late")).alias("pass")).alias("to"))
    ends = chain_ends(steps).filter(F.col("key.pass") == PASSES).select(F.col("key.key").alias("key"), F.col("to.key").alias("to"))
    return materialise(ends.join(own.select(F.col("key").alias("to"), "node"), "to").select("key", "node"), "turned")
