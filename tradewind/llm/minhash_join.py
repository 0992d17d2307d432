"""MinHash near-duplicates by an inverted join of signature coordinates, each link checked on whole sets.

A document is the set of its shingles; documents with equal sets are one node. A signature has
COORDS minima of hashed shingles; each (coordinate, value) pair has the list of nodes that hold
it, and two nodes collide in a coordinate if they stand in its list together. Pairs with MATCHES
collisions or more are kept: at a similarity of 0.8 fewer happen with a chance of 1 in 690,000,
at 0.5 as many with one of 1 in 340.

Lists are merged by prefix and skip. Two nodes with MATCHES collisions collide in at least one of
their first COORDS - MATCHES + 1 coordinates, whatever order all nodes share; the order is by
length of the list, so only a node's shortest lists are merged, its longest are skipped, and a
node with enough values of its own is in no list at all. Of a list, nodes are first held against
its least one; what checked links have united isn't compared again, so a large group of near
copies costs a few pairs a node and list.

Of a list whose nodes are then still in FEW different groups, all pairs between groups are
compared. Lists of more groups hold texts that are alike without being linked, such as those of
a template, where estimates cannot tell 0.7 from 0.8 and pairs would be many. Their nodes are
joined by the same two rules, exactly, on whole sets: two sets with a link share one of their
rarest shingles, and the place of the first one they share bounds what they can share in all.

Whole sets are made of the nodes that a check needs, when it needs them, and only those of its
pairs are sent; rows that can't be among them are left out before, by a set of bits of hashed ids.

Whole sets are sent and compared as 32 bits of each shingle's 64-bit hash, with the exact sizes,
as they are most of what crosses the network: chance makes two sets of 500 shingles share one
that they don't have in common once in 17,000 pairs, which matters only to a pair that lacks
just one shingle of a link.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import forget, map_arrow, narrow, small_batches, stash
from tradewind.llm.components import stars

WORDS = 2
#: A link's least similarity, in hundredths.
LEAST = 80
COORDS, MATCHES = 64, 35
#: Groups of a list that are compared pair by pair.
FEW = 16
#: Shingles that are hashed at a time, so that they stay in a core's cache.
GROUP = 30_000
#: Words whose hashes a task keeps.
KNOWN = 200_000
#: Bits of the set of hashed ids by which rows that no join can need are left out before they are sent.
BITS = 1 << 24
_RANDOM = np.random.default_rng(42)
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, COORDS, np.uint64) << np.uint64(1) | np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


class Shingles:
    """Sets of shingles of k words (ASCII white space parts words, A-Z lower-cased) as ascending 64-bit hashes; the whole sequence if words are fewer."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, U)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U, len(words))
        k = min(self.k, len(h))
        total = np.full(len(h) - k + 1, k, U)
        for j in range(k):
            total += h[j : len(h) - k + 1 + j] * _PLACES[j % len(_PLACES)]
        return _mix(total)

    def of(self, text: str) -> np.ndarray:
        return np.unique(self.hashes(text))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDS) minima; the row of an empty set is all zeros."""
    out = np.zeros((len(sets), COORDS), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(some):
        group, held = [], 0
        while at < len(some) and (not group or held + len(sets[some[at]]) <= GROUP):
            group.append(some[at])
            held += len(sets[some[at]])
            at += 1
        flat = np.concatenate([sets[i] for i in group])
        starts = np.cumsum([0, *(len(sets[i]) for i in group[:-1])])
        for c, m in enumerate(_MULTIPLIERS):
            out[group, c] = np.minimum.reduceat(flat * m, starts) >> U(32)
    return out


def _lists(signed_sets: np.ndarray) -> pa.ListArray:
    n, coords = signed_sets.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, coords * n + 1, coords, dtype=np.int32)), pa.array(signed_sets.reshape(-1).view(np.int32)))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.astype("<u8").tobytes())


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, d0, d1, size, sig) of rows (doc_id, text): the 128-bit digest of a text's set, its size and signature."""
    small_batches(docs.sparkSession)

    def run(batches):
        forget()
        shingles = Shingles(words)
        for b in batches:
            if b.num_rows:
                sets = [shingles.of(t.as_py()) for t in b.column("text")]
                d = np.frombuffer(b"".join(map(_digest, sets)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id"), "d0": pa.array(d[:, 0]), "d1": pa.array(d[:, 1]), "size": pa.array([len(s) for s in sets], pa.int32()),
                    "sig": _lists(signatures(sets)),
                })

    return docs.mapInArrow(run, "doc_id long, d0 long, d1 long, size int, sig array<int>")


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node): the lists that nodes stand in, key being coordinate and value."""
    each = nodes.select("node", F.posexplode("sig").alias("at", "value"))
    return each.select(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), "node")


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """(key, node) of each node's first COORDS - MATCHES + 1 coordinates, the shortest lists first, of lists that two nodes or more share."""
    posted = postings(nodes)
    shared = stash(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-values")
    own = Window.partitionBy("node")
    ranked = posted.join(shared, "key").withColumns({"place": F.row_number().over(own.orderBy("n", "key")), "held": F.count(F.lit(1)).over(own)})
    # the COORDS - held values that no other node has come before all lists
    lists = stash(ranked.filter(F.col("place") <= F.col("held") - (MATCHES - 1)).select("key", "node"), "prefix-lists")
    merged = stash(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "merged-lists")
    return stash(lists.join(merged, "key", "left_semi"), "lists")


def possible(df: DataFrame, col: str, wanted: DataFrame) -> DataFrame:
    """df without most rows whose id in col isn't the column of wanted: of those that hash to no bit of a set of BITS bits."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    own = wanted.select(place(F.col(wanted.columns[0])).alias("__p"))
    bit = F.expr("shiftleft(1L, cast(__p % 64 as int))")
    held = own.groupBy(F.shiftright("__p", 6).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    met = df.withColumn("__p", place(F.col(col))).join(F.broadcast(held), F.shiftright("__p", 6) == F.col("__w"))
    return met.filter(F.col("__bits").bitwiseAND(bit) != 0).select(*df.columns)


def ends(pairs: DataFrame) -> DataFrame:
    """(node) of pairs (u, v), once each."""
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _near_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST


def colliding(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes with MATCHES collisions or more and sizes that allow a link."""
    side = lambda c: possible(nodes, "node", pairs.select(c)).select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sig").alias(f"{c}_sig"))
    met = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v").filter(_near_sizes("u_size", "v_size"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("u_sig", "v_sig"))
        return b.select(["u", "v"]).filter(pa.array((x == y).sum(1) >= MATCHES))

    return map_arrow(met.select("u", "v", "u_sig", "v_sig"), f, "u long, v long")


def node_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, size, shingles) of wanted nodes (node, first, d0, d1), from the text of a row that has the node's first id and digest."""
    met = possible(docs, "doc_id", wanted.select("first")).join(wanted.withColumnRenamed("first", "__first").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__first")))

    def run(batches):
        forget()
        shingles = Shingles(words)
        for b in batches:
            if b.num_rows:
                sets = [shingles.of(t.as_py()) for t in b.column("text")]
                d = np.frombuffer(b"".join(map(_digest, sets)), "<i8").reshape(-1, 2)
                ok = (d[:, 0] == b.column("d0").to_numpy()) & (d[:, 1] == b.column("d1").to_numpy())
                short = pa.array([np.unique(s >> U(32)).astype("<u4").tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_pydict({"node": b.column("node"), "size": pa.array([len(s) for s in sets], pa.int32()), "shingles": short}).filter(pa.array(ok))

    sets = stash(met.select("node", "d0", "d1", "text").mapInArrow(run, "node long, size int, shingles binary"), "node-sets")
    if sets.count() > wanted.count():  # an id that several rows have
        sets = stash(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")), "node-sets-once")
    return sets


def similar(a: np.ndarray, b: np.ndarray, sizes: int) -> bool:
    """Whether two ascending sets, whose sizes add up to that, have LEAST similarity at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LEAST * (sizes - both)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets are similar."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        xs, ys, sizes = (b.column(c).to_pylist() for c in ("us", "vs", "sizes"))
        ok = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), n) for x, y, n in zip(xs, ys, sizes, strict=True)]
        return b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: possible(sets, "node", pairs.select(c)).select(F.col("node").alias(c), F.col("size").alias(f"{c}n"), F.col("shingles").alias(f"{c}s"))
    met = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")
    return map_arrow(met.select("u", "v", "us", "vs", (F.col("un") + F.col("vn")).alias("sizes")), f, "u long, v long")


def grouped(lists: DataFrame, links: DataFrame) -> DataFrame:
    """lists with group, of lists whose nodes links haven't united."""
    star = stars(links)
    members = stash(lists.join(star.select(F.col("u").alias("node"), F.col("v").alias("up")), "node", "left").withColumn("group", F.coalesce("up", "node")).drop("up"), "grouped-lists")
    # aggregates are written before they are joined by their own key: Spark can then split a list with very many rows
    mixed = stash(members.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("key"), "mixed-lists")
    return stash(members.join(mixed, "key", "left_semi"), "open-lists")


def against_least(lists: DataFrame) -> DataFrame:
    """Pairs (u, v) of each node of a list and its least one."""
    ends = stash(lists.groupBy("key").agg(F.min("node").alias("v")), "list-ends")
    return lists.join(ends, "key").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def seed_pairs(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose first ids are a row of seeds (doc_id, component_id), a node for each id."""
    named = stash(nodes.filter("size > 0").groupBy("first").agg(F.min("node").alias("node")), "first-nodes")
    side = lambda c, n: named.select(F.col("first").alias(c), F.col("node").alias(n))
    met = seeds.select("doc_id", "component_id").filter("doc_id <> component_id").join(side("doc_id", "u"), "doc_id").join(side("component_id", "v"), "component_id")
    return met.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def few_groups(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (u, v) between the groups of lists with FEW groups at most, nodes of the other lists)."""
    groups = members.select("key", "group").distinct()
    counts = stash(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "list-groups")
    few = stash(members.join(counts.filter(F.col("n") <= FEW).select("key"), "key", "left_semi"), "few-groups")
    own = few.select("key", "group").distinct()
    apart = own.select("key", F.col("group").alias("g")).join(own.select("key", F.col("group").alias("h")), "key").filter("g < h")
    a, b = (few.select("key", F.col("group").alias(g), F.col("node").alias(u)) for g, u in (("g", "u"), ("h", "v")))
    met = apart.join(a, ["key", "g"]).join(b, ["key", "h"])
    many = members.join(counts.filter(F.col("n") > FEW).select("key"), "key", "left_semi").select("node").distinct()
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), many


def shingle_lists(sets: DataFrame) -> DataFrame:
    """(key, node, size, place, indexed): each set's rarest shingles of those that another set has too, as far as a link of the set needs them.

    place counts from 1 over all shingles of the set, the ones of its own first. Of a linked pair
    the larger set shares one of its first size - 0.8 size + 1 shingles with the first
    size - 8/9 size + 1 (indexed) of the smaller one.
    """

    def run(batches):
        for b in batches:
            for node, raw in zip(b.column("node").to_pylist(), b.column("shingles"), strict=True):
                s = np.frombuffer(raw.as_buffer(), "<u4")
                for at in range(0, len(s), GROUP):
                    part = s[at : at + GROUP]
                    yield pa.RecordBatch.from_pydict({"node": np.full(len(part), node, np.int64), "key": part.view(np.int32), "size": np.full(len(part), len(s), np.int32)})

    each = stash(sets.select("node", "shingles").mapInArrow(run, "node long, key int, size int"), "set-shingles")
    shared = stash(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-shingles")
    own = Window.partitionBy("node")
    x = each.join(shared, "key").withColumns({"place": F.row_number().over(own.orderBy("n", "key")), "held": F.count(F.lit(1)).over(own)})
    x = x.withColumn("place", F.col("place") + F.col("size") - F.col("held"))
    first = lambda share: F.col("size") - F.ceil(F.col("size") * share[0] / F.lit(share[1])) + 1
    x = x.filter(F.col("place") <= first((LEAST, 100)))
    return stash(x.select("key", "node", "size", "place", (F.col("place") <= first((2 * LEAST, 100 + LEAST))).alias("indexed")), "shingle-lists")


def between(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes in different groups that a list of shingles (with group) allows to be linked."""
    # what a group's best node could reach decides first, so that few pairs of groups are made
    bounds = lambda m, g: m.groupBy("key", F.col("group").alias(g)).agg(F.max(F.col("size") - F.col("place")).alias(f"{g}_rest"), F.min("size").alias(f"{g}_lo"), F.max("size").alias(f"{g}_hi"))
    reach = (100 + LEAST) * (1 + F.least("g_rest", "h_rest")) >= LEAST * (F.col("g_lo") + F.col("h_lo"))
    sizes = (F.col("g_hi") >= F.col("h_lo")) & (F.col("h_hi") * 100 >= F.col("g_lo") * LEAST)
    apart = bounds(members, "g").join(bounds(members.filter("indexed"), "h"), "key").filter((F.col("g") != F.col("h")) & reach & sizes).select("key", "g", "h")
    a = members.select("key", F.col("group").alias("g"), F.col("node").alias("u"), F.col("size").alias("u_size"), F.col("place").alias("u_place"))
    b = members.filter("indexed").select("key", F.col("group").alias("h"), F.col("node").alias("v"), F.col("size").alias("v_size"), F.col("place").alias("v_place"))
    smaller = F.struct("v_size", "v") < F.struct(F.col("u_size").alias("v_size"), F.col("u").alias("v"))
    most = 1 + F.least(F.col("u_size") - F.col("u_place"), F.col("v_size") - F.col("v_place"))
    met = apart.join(a, ["key", "g"]).join(b, ["key", "h"]).filter(smaller & _near_sizes("u_size", "v_size") & ((100 + LEAST) * most >= LEAST * (F.col("u_size") + F.col("v_size"))))
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def likely(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, common) those with the most shingles in common on lists, FEW for each u.

    In a large group of texts around the threshold they hold links enough to unite most of it,
    and what they have united needs no other comparison.
    """
    best = Window.partitionBy("u").orderBy(F.desc("common"), "v")
    return pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= FEW).select("u", "v")


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (u, v) that links haven't united."""
    star = stars(links)
    side = lambda c: star.select(F.col("u").alias(c), F.col("v").alias(f"{c}_up"))
    met = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return met.filter(F.coalesce("u_up", "u") != F.coalesce("v_up", "v")).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, empty_linked: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    component_id is the smallest id reachable over links between texts whose sets of shingles
    have LEAST similarity at least; kept says whether that is the row's own. A null or empty text
    has the empty set, linked with nothing (empty_linked: with other empty ones). Rows that repeat
    an id are rows of their own. A null id is in a component but never its id, unless all its ids
    are null; other columns are ignored; no rows in, no rows out. seeds: (doc_id, component_id) of
    groups found by other means; each text is checked against its group's least first, and lists
    whose nodes these links unite aren't merged. No result depends on them.
    """
    docs = narrow(docs, id_col, text_col)
    rows = stash(signed(docs, words), "signatures")
    alone = rows.groupBy("d0", "d1").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    nodes = stash(alone.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = prefix_lists(nodes.filter("size > 0"))
    fetched: list[DataFrame] = []

    def sets(wanted: DataFrame) -> DataFrame:
        """The sets of wanted nodes, and those made before."""
        own = wanted
        for x in fetched:
            own = own.join(x.select("node"), "node", "left_anti")
        own = stash(own, "wanted-nodes")
        named = possible(nodes.select("node", "first", "d0", "d1"), "node", own).join(own, "node", "left_semi")
        fetched.append(node_sets(docs, stash(named, "wanted"), words))
        return reduce(DataFrame.unionByName, fetched)

    if seeds is None:
        met = stash(colliding(stash(against_least(lists), "pairs"), nodes), "collisions")
        links = stash(checked(met, sets(ends(met))), "links")
    else:
        met = stash(seed_pairs(seeds, nodes), "seed-pairs")
        seeded = stash(checked(met, sets(ends(met))), "seed-links")
        rest = grouped(lists, seeded).select("key", "node")
        met = stash(colliding(stash(against_least(rest), "pairs"), nodes), "collisions")
        links = stash(seeded.unionByName(checked(met, sets(ends(met)))), "links")
    members = grouped(lists, links)
    met, many = few_groups(members)
    met = stash(colliding(stash(met.distinct(), "pairs"), nodes), "collisions")
    many = stash(many, "many-groups")
    whole = sets(ends(met).unionByName(many).distinct())
    rare = shingle_lists(possible(whole, "node", many).join(many, "node", "left_semi"))
    rest = between(rare.join(members.select("node", "group").distinct(), "node")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"))
    rest = stash(rest.join(met, ["u", "v"], "left_anti"), "rare-pairs")
    met = stash(met.unionByName(likely(rest)), "likely-pairs")
    links = stash(links.unionByName(checked(met, whole)), "links")
    rest = stash(apart(rest.join(met, ["u", "v"], "left_anti"), links), "pairs")
    links = stash(links.unionByName(checked(rest, whole)), "links")
    root = nodes.join(stars(links).select(F.col("u").alias("node"), F.col("v").alias("up")), "node", "left").select("node", "d0", "d1", "first", F.coalesce("up", "node").alias("root"))
    root = stash(root, "roots")
    component = root.join(stash(root.groupBy("root").agg(F.min("first").alias("component_id")), "least-members"), "root").select("d0", "d1", "component_id")
    out = rows.select("doc_id", "d0", "d1", "size").join(stash(component, "components"), ["d0", "d1"])
    own = F.lit(not empty_linked) & (F.col("size") == 0)
    out = out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
