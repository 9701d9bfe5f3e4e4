"""Pairs of named sets whose Jaccard overlap reaches a threshold.

Comparing all pairs, or joining on any shared member, breaks down when a member
such as a load-stamp column is in every set. Three steps keep the work near
the size of the answer:

1. Sets with identical members are folded to one *shape*, known by the least of their names; a
   third of all tables being copies costs one row from here on. Members of several shapes get
   numbers, rare ones first, and from here on shapes are lists of numbers; a member of one
   shape only can't be shared and just counts.
2. Shapes meet on their rarest members only. With all members in one global
   order, rare ones first, a pair reaching overlap t shares a member among the
   first n - ceil(t * n) + 1 of the larger set (size n) and the first
   m - ceil(2t / (1 + t) * m) + 1 of the smaller (size m). Members found
   everywhere come last in that order and are met on only when so much of both
   sets is common that the pair may well qualify. Sizes and positions are
   checked inside the join, the overlap exactly after it; a pair is kept at
   its first common member, so it appears once without a distinct.
3. The answer is classes: one row per name with its class, and pairs of classes that
   match, with counts. It grows with the names and the pairs of different sets, not with
   the square of the copies. Only ``overlapping_sets`` expands it to all pairs of names, in
   blocks, so a shape shared by very many names is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.lookup import salted_join
from tidemill.session import stage

BLOCK = 1000  # names per block when a shape is expanded
SLACK = 1e-9  # keeps ceil() exact where the product is a whole number


def _ceil(value: Column) -> Column:
    return F.ceil(value - F.lit(SLACK)).cast("int")


@dataclass(frozen=True)
class Overlaps:
    """Classes of equal sets and the pairs of classes that overlap, written and read back."""

    sets: DataFrame     # name, items, shape
    shapes: DataFrame   # shape, items, names, representative
    matched: DataFrame  # pair, a, b (representatives), names_a, names_b, overlap, codes; no shape with itself
    numbers: DataFrame  # member, code

    def members(self) -> DataFrame:
        """(name, representative, names, links): a name's class, its size, and how many names it overlaps with.

        A class is named by its least name.
        """
        sides = [self.matched.select(F.col(x).alias("representative"), F.col(f"names_{y}").alias("n"))
                 for x, y in ("ab", "ba")]
        links = sides[0].unionByName(sides[1]).groupBy("representative").agg(F.sum("n").alias("more"))
        counted = self.shapes.select("shape", "representative", "names").join(links, "representative", "left").select(
            "shape", "representative", "names",
            (F.col("names") - 1 + F.coalesce("more", F.lit(0).cast("long"))).alias("links"))
        return salted_join(self.sets.select("name", "shape"), counted, "shape", "name").select(
            "name", "representative", "names", "links")

    def _named(self) -> DataFrame:
        """The pairs of different shapes with the names of what they share."""
        codes = self.matched.select("pair", F.explode("codes").alias("code"))
        shared = (salted_join(codes, self.numbers, "code", "pair", "inner").select("pair", "member")
                  .repartition("pair").groupBy("pair").agg(F.sort_array(F.collect_list("member")).alias("shared")))
        return self.matched.drop("codes").join(shared, "pair").drop("pair")

    def _copies(self) -> DataFrame:
        return self.shapes.filter("names > 1").select(
            F.col("representative").alias("a"), F.col("representative").alias("b"),
            F.col("names").alias("names_a"), F.col("names").alias("names_b"),
            F.lit(1.0).alias("overlap"), F.col("items").alias("shared"))

    def pairs(self) -> DataFrame:
        """(name_a, name_b, names_a, names_b, pairs, overlap, shared) of classes that overlap.

        ``name_a`` <= ``name_b`` are the representatives; ``pairs`` counts the pairs of names behind a row. A
        class of several names is a pair of its own, with itself.
        """
        different = self._named().select(
            F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"),
            F.when(F.col("a") < F.col("b"), F.col("names_a")).otherwise(F.col("names_b")).alias("names_a"),
            F.when(F.col("a") < F.col("b"), F.col("names_b")).otherwise(F.col("names_a")).alias("names_b"),
            (F.col("names_a") * F.col("names_b")).alias("pairs"), "overlap", "shared")
        copies = self._copies().select(
            F.col("a").alias("name_a"), F.col("b").alias("name_b"), "names_a", "names_b",
            F.expr("names_a * (names_a - 1) div 2").alias("pairs"), "overlap", "shared")
        return different.unionByName(copies)

    def total(self) -> DataFrame:
        """One row (pairs): how many pairs of names overlap, none of them made; null if there are none."""
        different = self.matched.select((F.col("names_a") * F.col("names_b")).alias("pairs"))
        copies = self.shapes.filter("names > 1").select(F.expr("names * (names - 1) div 2").alias("pairs"))
        return different.unionByName(copies).agg(F.sum("pairs").alias("pairs"))

    def expanded(self) -> DataFrame:
        """(name_a, name_b, overlap, shared) for every pair of names; the square of the copies."""
        named = self._named()
        alone = (F.col("names_a") == 1) & (F.col("names_b") == 1)  # each name is its class
        several = named.filter(~alone).unionByName(self._copies())
        return (named.filter(alone)
                .select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"), "overlap", "shared")
                .unionByName(_expand(self.sets, self.shapes, several)))


def overlaps(members: DataFrame, threshold: float) -> Overlaps:
    """What overlaps by at least the threshold among the sets of (name, member) rows.

    Duplicates count once; null names and members are passed over. One set must fit a row, as the columns of a table do.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = stage(
        members.filter(F.col("name").isNotNull() & F.col("member").isNotNull())
        .groupBy("name").agg(F.sort_array(F.collect_set("member")).alias("items"))
        # Half of the digest: 128 bits, and shapes group by their items too.
        .withColumn("shape", F.unhex(F.left(F.sha2(F.to_json("items"), 256), F.lit(32)))), "sets")
    shapes = stage(sets.groupBy("shape", "items").agg(
        F.count(F.lit(1)).alias("names"), F.min("name").alias("representative")), "shapes")
    numbers = _numbered(shapes)
    matched = _matching_shapes(shapes, numbers, threshold)
    return Overlaps(sets, shapes, stage(
        matched.select(F.monotonically_increasing_id().alias("pair"), *matched.columns), "matched"), numbers)


def overlapping_sets(members: DataFrame, threshold: float) -> DataFrame:
    """(name_a, name_b, overlap, shared) for every pair with overlap >= threshold.

    ``name_a`` < ``name_b``; ``shared`` is the sorted list of common members.
    """
    return overlaps(members, threshold).expanded()


def _numbered(shapes: DataFrame) -> DataFrame:
    """(member, code) of the members of several shapes, numbered from the rarest on, with gaps."""
    uses = shapes.select(F.explode("items").alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("uses"))
    numbers = stage(uses.filter("uses > 1").orderBy("uses", "member")
                    .select("member", F.monotonically_increasing_id().alias("id")), "numbers")
    # The id is the task in the upper bits and the row within it in the lower 33; closer numbers take half the room.
    task, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    tasks, rows = numbers.agg(F.coalesce(F.max(task), F.lit(0)) + 1, F.coalesce(F.max(row), F.lit(0)) + 1).first()
    code = task * F.lit(rows).cast("long") + row
    return numbers.select("member", code.cast("int" if tasks * rows < 1 << 31 else "long").alias("code"))


def _matching_shapes(shapes: DataFrame, numbers: DataFrame, t: float) -> DataFrame:
    exploded = shapes.select(F.col("representative").alias("id"), "names", F.size("items").alias("size"),
                             F.explode("items").alias("member"))
    coded = salted_join(exploded, numbers, "member", "id", "inner").select("id", "names", "size", "code")
    ranked = stage(
        # Rows of a shape travel one by one: lists of one would be larger.
        coded.repartition("id").groupBy("id", "names", "size")
        .agg(F.sort_array(F.collect_list("code")).alias("codes")), "ranked")

    def heads(length: Column) -> DataFrame:
        # Members of this shape only are its rarest, so they stand before the codes.
        left = F.greatest(length - (F.col("size") - F.size("codes")), F.lit(0))
        return (ranked.withColumn("head", F.slice("codes", F.lit(1), left))
                .select("id", "names", "codes", "size", F.posexplode("head").alias("at", "code")))

    size = F.col("size")
    larger = heads(size - _ceil(F.lit(t) * size) + 1).alias("a")
    smaller = heads(size - _ceil(F.lit(2 * t / (1 + t)) * size) + 1).alias("b")
    needed = _ceil(F.lit(t / (1 + t)) * (F.col("a.size") + F.col("b.size")))
    left = F.least(F.size("a.codes") - F.col("a.at"), F.size("b.codes") - F.col("b.at"))
    in_order = (F.col("a.size") > F.col("b.size")) | (
        (F.col("a.size") == F.col("b.size")) & (F.col("a.id") > F.col("b.id")))
    fits = in_order & (F.col("b.size") >= _ceil(F.lit(t) * F.col("a.size"))) & (left >= needed)
    # A pair meets at each member common to both heads; the first one counts.
    # It is the first when one head starts with it, or nothing before it is shared.
    first = (F.col("a.at") == 0) | (F.col("b.at") == 0) | ~F.arrays_overlap(
        F.slice("a.codes", F.lit(1), F.col("a.at")), F.slice("b.codes", F.lit(1), F.col("b.at")))
    common = F.array_intersect("a.codes", "b.codes")
    count = F.size(common)
    overlap = count / (F.col("a.size") + F.col("b.size") - count)
    # Nested, because the optimizer reorders plain conjuncts and would
    # intersect the lists of every pair that meets.
    qualifies = F.when(fits, F.when(first, F.when(count >= needed, overlap >= t)))
    return (
        larger.join(smaller, (F.col("a.code") == F.col("b.code")) & qualifies)
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"),
                F.col("a.names").alias("names_a"), F.col("b.names").alias("names_b"),
                overlap.alias("overlap"), common.alias("codes"))
    )


def _blocks(names: Column) -> Column:
    return F.ceil(names / F.lit(BLOCK)).cast("int")


def _expand(sets: DataFrame, shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Name pairs behind shape pairs, one block of names against one block."""
    block = F.pmod(F.xxhash64("name"), _blocks(F.col("names"))).cast("int")
    named = (sets.select("name", "shape").join(shapes.select("shape", "representative", "names"), "shape")
             .select("name", "representative", block.alias("block")))

    def numbers(names: str) -> Column:
        return F.explode(F.sequence(F.lit(0), _blocks(F.col(names)) - 1))

    same_shape = F.col("a") == F.col("b")
    tiles = (pairs.withColumn("block_a", numbers("names_a"))
             .withColumn("block_b", numbers("names_b"))
             .filter(~same_shape | (F.col("block_a") <= F.col("block_b"))))
    first = named.select(F.col("name").alias("x"), F.col("representative").alias("a"),
                         F.col("block").alias("block_a"))
    second = named.select(F.col("name").alias("y"), F.col("representative").alias("b"),
                          F.col("block").alias("block_b"))
    mirrored = same_shape & (F.col("block_a") == F.col("block_b")) & (F.col("x") >= F.col("y"))
    return (tiles.join(first, ["a", "block_a"]).join(second, ["b", "block_b"])
            .filter(~mirrored)
            .select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"),
                    "overlap", "shared"))
