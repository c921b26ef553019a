"""Near-duplicate detection by bottom-k sketches from one hash function.

One 64-bit hash orders the distinct word shingles; each document retains its k smallest. Documents with the same set are
one class. Inverted lists of retained values generate overlaps between class representatives; the overlap within the
smallest k values of the union estimates the similarity and filters; the exact similarity of the full sets verifies.

Of the k smallest values of a union, linked documents share at least min_shared(k) but for a chance under 1e-8; so of any
order of a sketch's k values, the first k - min_shared(k) + 1 must meet a partner's. The order taken is rarest first:
values that only one sketch retains need no list, and passages that many documents share fall behind the part listed.
Short sets retain more values, most of them all, as a shared passage fills more of them; sets whose sizes may meet those
of both kinds are listed with both.

Groups of many alike documents never become all their pairs. Members are first held against a few pivots of each list;
short lists then give the pairs that the links found do not yet connect. In a long list members are written as their
difference from its pivot: two sets differ in at least as much as their differences do not share, so a link needs
shared items of the differences, and prefixes of those, rarest first, are joined instead (_crossing_long).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents, gated, stored, text_key
from linework.llm.components import components
from linework.llm.kernels import chunks, mixed, shingle_sets, tidied

#: Values that a set retains: LONG_SKETCH if it has over SHORT_SET items, else SHORT_SKETCH.
SHORT_SET, SHORT_SKETCH, LONG_SKETCH = 200, 170, 64
PIVOT_ROUNDS = 2
#: Lists longer than this are joined by differences from their pivot.
LONG_LIST = 64
RISK = 1e-8


def min_shared(k: int, percent: int, risk: float = RISK) -> int:
    """The most shared values, of the k smallest of a union, that a link may fall short of with a chance under risk."""
    j, tail, m = percent / 100, 0.0, 0
    while m < k:
        tail += comb(k, m) * j**m * (1 - j) ** (k - m)
        if tail > risk:
            break
        m += 1
    return m


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for first, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                doc, h, g = shingle_sets(data, offsets, width)
                counts = np.bincount(doc, minlength=n)
                begin = np.concatenate([[0], np.cumsum(counts)])
                prints = []
                for lane, salt in ((h, 0x5851F42D4C957F2D), (g, 0x14057B7EF767814F)):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(lane ^ np.uint64(salt)), dtype=np.uint64)])
                    prints.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
                k = np.where(counts > SHORT_SET, LONG_SKETCH, SHORT_SKETCH)
                taken = np.arange(len(h)) - begin[doc] < k[doc]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(counts, k))]).astype(np.int32)), pa.array((h[taken] >> np.uint64(1)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), keys.slice(first, n), pa.array(counts.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc_id", "text_key", "n", "print_a", "print_b", "sketch"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node")
            for first, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                doc, h, g = shingle_sets(data, offsets, width)
                begin = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), *(pa.ListArray.from_arrays(begin, pa.array(x.view(np.int64))) for x in (h, g))], ["doc_id", "items", "checks"])

    return run


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per document: text_key, set size n, two 64-bit fingerprints of the set, and its smallest values, ascending."""
    return documents(docs).withColumn("text_key", text_key()).mapInArrow(tidied(_sketched(width)), "doc_id long, text_key long, n long, print_a long, print_b long, sketch array<long>")


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """(value, doc_id, n): the listed part of each representative's sketch, values that two sketches share only.

    Lists of long sets have values below 0.
    """
    whole = F.ceil(F.col("n") * F.lit(percent) / 100)  # small sets' partners retain everything
    n_short = F.least("n", F.lit(SHORT_SKETCH))
    listed_short = F.when(F.col("n") <= SHORT_SKETCH * percent // 100, F.col("n") - whole + 1).otherwise(n_short - min_shared(SHORT_SKETCH, percent) + 1)
    short = reps.where(F.col("n") <= SHORT_SET).select("doc_id", "n", F.lit(False).alias("long"), n_short.alias("kept"), listed_short.alias("listed"), F.explode("sketch").alias("value"))
    n_long = F.least("n", F.lit(LONG_SKETCH))
    long = reps.where(F.col("n") * 100 >= SHORT_SET * percent).select(
        "doc_id", "n", F.lit(True).alias("long"), n_long.alias("kept"), (n_long - min_shared(LONG_SKETCH, percent) + 1).alias("listed"), F.explode(F.transform(F.slice("sketch", 1, LONG_SKETCH), lambda x: -1 - x)).alias("value")
    )
    each = short.unionByName(long)
    shared = each.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    met = each.join(shared, "value")
    per_doc = met.groupBy("doc_id", "n", "long", "kept", "listed").agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("met"))
    room = F.greatest(F.lit(0), F.col("listed") - (F.col("kept") - F.size("met"))).cast("int")
    return per_doc.where(room > 0).select("doc_id", "n", F.explode(F.slice("met", F.lit(1), room)).alias("m")).select(F.col("m.value").alias("value"), "doc_id", "n")


def _fit(percent: int) -> Column:
    """Sizes that allow the similarity."""
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("a") < F.col("b"))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: the union sketch filters, the full sets decide, by both hashes of each shingle."""
    both = (
        pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    )
    long = F.greatest("na", "nb") > SHORT_SET
    k = F.when(long, LONG_SKETCH).otherwise(SHORT_SKETCH)
    both = both.select("a", "b", long.alias("long"), k.alias("k"), F.slice("sa", F.lit(1), k).alias("sa"), F.slice("sb", F.lit(1), k).alias("sb"))
    both = both.withColumn("all", F.array_sort(F.array_union("sa", "sb"))).withColumn("shared", F.array_intersect("sa", "sb"))
    # A union no larger than k is known whole, and there the estimate is the similarity; else min_shared(k) bounds it.
    whole = (F.size("sa") < F.col("k")) & (F.size("sb") < F.col("k"))
    top = F.element_at("all", F.least(F.size("all"), F.col("k")).cast("int"))
    seen = F.size(F.filter("shared", lambda x: x <= top))
    least = F.when(F.col("long"), min_shared(LONG_SKETCH, percent)).otherwise(min_shared(SHORT_SKETCH, percent))
    likely = stored(both.where(F.when(whole, F.size("shared") * 100 >= F.size("all") * percent).otherwise((F.size("all") <= F.col("k")) | (seen >= least))).select("a", "b"), "likely")
    sets = _sets(likely.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, width)
    full = (
        likely.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia"), F.col("checks").alias("ca")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib"), F.col("checks").alias("cb")), "b")
    )

    def alike(x: str, y: str) -> Column:
        common = F.size(F.array_intersect(x, y))
        return common * 100 >= (F.size(x) + F.size(y) - common) * percent

    return stored(full.where(alike("ia", "ib") & alike("ca", "cb")).select("a", "b"), "verified")


def _sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, items, checks): the full shingle sets of the nodes named, as the two hashes of each shingle."""
    asked = stored(ids.distinct(), "asked")
    texts = gated(docs, F.col("node"), asked, "doc_id", asked.count())
    texts = texts.join(asked, texts["node"] == asked["doc_id"], "left_semi")
    return stored(texts.mapInArrow(tidied(_full_sets(width)), "doc_id long, items array<long>, checks array<long>").dropDuplicates(["doc_id"]), "sets")


def _crossing_long(placed: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of the long lists' members in different components that may be links.

    Let D be a member's symmetric difference from the list's pivot, and t the largest difference between linked sets of
    their sizes. A pair with |D1| + |D2| <= t has both members linked with the pivot, so it is in one component already.
    Any other link shares at least (|D1| + |D2| - t) / 2 items of D1 and D2. With |D1| <= |D2|, the first of any common
    order lies in the first |D1| - need + 1 items of D1 and the first |D2| - need + 1 of D2, where need is for the least
    |D2| of a range of sizes, which D1 is listed for one by one (a link's |D2| is at most |D1| + t), and for |D2| alone.
    """
    members = placed.select("value", "doc_id", "n", "component")
    pivots = members.groupBy("value").agg(F.min("doc_id").alias("pivot"))
    met = stored(members.join(pivots, "value").select("pivot", "doc_id", "n", "component").distinct(), "long-members")
    sets = _sets(met.select(F.explode(F.array("doc_id", "pivot")).alias("doc_id")), docs, width).drop("checks")
    side = met.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("pivot"), F.col("items").alias("hub")), "pivot")
    side = side.select("pivot", "doc_id", "n", "component", F.size("hub").alias("hub_n"), F.concat(F.array_except("items", "hub"), F.array_except("hub", "items")).alias("items"))
    side = stored(side, "differences")
    common = side.select("pivot", F.explode("items").alias("item")).groupBy("pivot", "item").agg(F.count("*").alias("times")).where("times > 1")
    each = side.select("pivot", "doc_id", F.explode("items").alias("item")).join(common, ["pivot", "item"])
    each = each.groupBy("pivot", "doc_id").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("met"))
    side = side.withColumn("d", F.size("items")).drop("items").join(each, ["pivot", "doc_id"])
    # The largest difference of a link with a partner of any fitting size, and ranges of a size that suits the pivot's.
    share = (100 - percent) / (100 + percent) * (1 + 100 / percent)
    side = side.withColumns({"t": F.floor(F.col("n") * share + 1e-9), "step": F.greatest(F.lit(2), F.floor(F.col("hub_n") * share / 4)), "alone": F.col("d") - F.size("met")})
    large = side.withColumn("part", F.floor(F.col("d") / F.col("step")))
    need = F.greatest(F.lit(1), F.ceil((F.col("d") - F.col("t")) / 2), F.col("d") - F.col("t"))
    large = large.withColumn("listed", (F.col("d") - need + 1 - F.col("alone")).cast("int"))
    least = F.greatest(F.col("d"), F.col("part") * F.col("step"))
    small = side.withColumn("part", F.explode(F.sequence(F.floor(F.col("d") / F.col("step")), F.floor((F.col("d") + F.col("t")) / F.col("step")))))
    need = F.greatest(F.lit(1), F.ceil((F.col("d") + least - F.col("t")) / 2))
    small = small.withColumn("listed", (F.col("d") - need + 1 - F.col("alone")).cast("int"))

    def spread(rows: DataFrame, name: str) -> DataFrame:
        items = F.explode(F.slice("met", F.lit(1), F.col("listed")))
        return rows.where("listed > 0").select("pivot", "part", "doc_id", "n", "component", "d", items.alias("m")).select("pivot", "part", "doc_id", "n", "component", "d", F.col("m.item").alias("item")).alias(name)

    x, y = spread(small, "x"), spread(large, "y")
    fit = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    join = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.d") <= F.col("y.d")) & fit
    return x.join(y, join).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))


def _told_apart(all_sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """sets and texts with node, the number that stands for a text, and whether it is other than doc_id for some.

    It is the doc_id, unless that is null or has several texts of different sets; then it is a hash of it and of the text.
    """
    by_id = all_sets.where("doc_id is not null").groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("print_a", "print_b", "n") for f in (F.min, F.max)])
    several = stored(by_id.where("min_print_a <> max_print_a or min_print_b <> max_print_b or min_n <> max_n").select(F.col("doc_id").alias("_several")), "several")
    texts = documents(docs).withColumn("text_key", text_key())
    count = several.count()
    if not count and all_sets.where("doc_id is null").isEmpty():
        return all_sets.withColumn("node", F.col("doc_id")), texts.withColumn("node", F.col("doc_id")), False
    named = F.xxhash64(F.lit("node"), "doc_id", "text_key")

    def of(rows: DataFrame) -> DataFrame:
        known = rows.where("doc_id is not null")
        known = known.join(several, known["doc_id"] == several["_several"], "left").withColumn("node", F.when(F.col("_several").isNotNull(), named).otherwise(F.col("doc_id"))).drop("_several")
        return known.unionByName(rows.where("doc_id is null").withColumn("node", named))

    return stored(of(all_sets), "sketches"), of(texts), True


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, kept, text_key.

    Links join documents whose sets' intersection is at least percent per cent of their union; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id and text are one document. Texts that share a doc_id, or have none, are documents each: a component
    of null doc_ids alone has a null component_id, and one text of a component is kept, of several with its smallest
    doc_id that of the smallest text_key's node. text_key (common.text_key) tells such rows apart. Texts of any length
    are taken whole. Extra columns are ignored; an empty table gives no rows.
    """
    all_sets, docs, mixed_ids = _told_apart(stored(sketches(docs, width), "sketches"), docs)
    all_sets = all_sets.withColumnRenamed("doc_id", "own_id").withColumnRenamed("node", "doc_id")
    classes = all_sets.where("n > 0").groupBy("print_a", "print_b", "n").agg(F.min("doc_id").alias("class_id"))
    member = all_sets.drop("sketch").join(classes, ["print_a", "print_b", "n"], "left").select("doc_id", "own_id", "text_key", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
    member = stored(member, "members")
    reps = stored(all_sets.where("n > 0").drop("own_id", "text_key").join(member.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "representatives")
    lists = stored(_lists(reps, percent), "lists")

    tested = links = None
    for r in range(PIVOT_ROUNDS):
        order = F.struct(F.col("doc_id").alias("o"), "doc_id", "n") if r == 0 else F.struct(F.xxhash64("doc_id", F.lit(r)).alias("o"), "doc_id", "n")
        pivots = lists.groupBy("value").agg(F.min(order).alias("p"), F.count("*").alias("length")).where("length > 1").select("value", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("np"))
        pairs = lists.join(pivots, "value").select(
            F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b"),
            F.when(F.col("doc_id") < F.col("pivot"), F.col("n")).otherwise(F.col("np")).alias("na"),
            F.when(F.col("doc_id") < F.col("pivot"), F.col("np")).otherwise(F.col("n")).alias("nb"),
        )
        pairs = pairs.where(_fit(percent)).select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = _verified(pairs, reps, docs, width, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
    joined = components(links)

    # What is left: pairs of a list that lie in different components and were not held against each other.
    placed = lists.join(joined, lists["doc_id"] == joined["node"], "left").select("value", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    sizes = placed.groupBy("value", "component").agg(F.count("*").alias("size"))
    several = sizes.groupBy("value").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("size").alias("length")).where("kinds > 1")
    placed = stored(placed.join(several.select("value", F.col("top.component").alias("top"), "length"), "value"), "placed")
    short = placed.where(F.col("length") <= LONG_LIST)
    one, two = short.where("component <> top").alias("x"), short.alias("y")
    crossing = one.join(two, (F.col("x.value") == F.col("y.value")) & (F.col("x.component") != F.col("y.component")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent))
    rest = crossing.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
    rest = rest.unionByName(_crossing_long(placed.where(F.col("length") > LONG_LIST), docs, width, percent)).distinct().join(tested, ["a", "b"], "left_anti")
    rest = stored(rest, "pairs")
    if not rest.isEmpty():
        more = _verified(rest, reps, docs, width, percent)
        if not more.isEmpty():
            joined = components(links.unionByName(more))
    result = member.join(joined, member["class_id"] == joined["node"], "left").select("doc_id", "own_id", "text_key", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    if not mixed_ids:
        return result.select("doc_id", "n_shingles", "class_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_key")
    result = stored(result, "result")
    rank = F.struct(F.col("own_id").isNull().alias("none"), "own_id", "doc_id")
    first = {c: result.groupBy(c).agg(F.min(rank).alias("first")).select(F.col(c).alias(f"_{c}"), "first") for c in ("class_id", "component_id")}
    out = result
    for c, smallest in first.items():
        out = out.join(smallest.withColumnRenamed("first", f"_first_{c}"), F.col(c) == F.col(f"_{c}"))
    return out.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("_first_class_id.own_id").alias("class_id"), F.col("_first_component_id.own_id").alias("component_id"), (F.col("doc_id") == F.col("_first_component_id.doc_id")).alias("kept"), "text_key")
