"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits; a bit is set if over half of its word shingles' hashes have it. Equal fingerprints are
collapsed first, so a group of copies of any size is one node. The distinct fingerprints are dealt into shards, and each
shard is searched by a BK-tree, whose children are keyed by integer Hamming distance to the parent and of which a search
follows only edges within the radius. A task keeps a spanning forest of the links it finds, never all pairs. Components
of the forests' union are the groups.

Shards, by radius:

* up to 2: the fingerprint is cut into three blocks. Fingerprints that differ in two bits agree in at least one of them, so
  the first bits of the three blocks are shard keys, as many bits as bring shards to ``SHARD`` members on average, and no
  link is lost for any number of bits. All that separates the members of a shard is up to its tree. A shard of more than
  ``TILE`` members is cut into tiles by hash, and each pair of tiles is a task: one tile's tree, searched by the other's.
* beyond, for similar word sets: nodes are the distinct shingle sets, and shard keys are ``BANDS`` bands of ``ROWS`` minima
  of independent hashes over the shingles. Two sets of Jaccard similarity s share a key but for a chance of
  (1 - s ** 3) ** 18, which is 3 in a million at 0.8, whatever their fingerprints. Shards of equal members are searched
  once. No Hamming distance bounds the similarity, so the tree only finds links early; what it leaves apart is counted by
  shared shingles. Every pair is decided by its two whole sets.

A set can only be linked if the least similarity's share of its shingles occurs in another set of the shard. Sets that fall
short are dropped before any pair is looked at, and again while that makes others fall short: of a shard of unlike
documents with one passage in common nothing is left. Small shards go to tasks by the thousand. A shard of more than
``WEIGHT`` shingles is first thinned in the same way by joins, and its sets are held against the one that has most in
common with the others; those linked to it need not be compared with one another. Only the sets not linked to it meet each
other and the linked ones, by pairs of tiles. So no shard has to fit a task, and none is capped.

Defined cases: a null, empty or blank text has fingerprint 0 and links like any other; fewer words than a shingle has
make one shingle; ids may repeat or be null (a null id is never the smallest); an empty table gives no rows; of other
columns only :func:`deduplicate` returns any, all as they are, whatever their names but those that start with ``dedup_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, per_batch, stored
from .graph import Forest, components

#: Members of a shard on average, and the most that one tree holds, of fingerprints within 2 bits.
SHARD, TILE = 500, 2000
BLOCKS = ((0, 22), (22, 21), (43, 21))
BANDS, ROWS = 18, 3
#: Shingles, of 4 bytes each, that one task takes of a large shard, and those of small shards that go together.
WEIGHT, LANE = 4_000_000, 250_000
#: Hamming distance within which the tree finds similar sets early: at similarity 0.8 some 10 of 64 bits differ. Not a limit.
RADIUS = 8
#: Odd factors of the minima's hashes: the shingles' own hashes are uniform, and a product with an odd number permutes them.
FACTORS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 1) | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle of the lower-cased text (A-Z only), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - k]).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def sets(hashes: np.ndarray) -> tuple[int, int, list[int], np.ndarray]:
    """Of the distinct shingles: their fingerprint, an id of the set, its bands, and the 31-bit hashes in order."""
    own = np.unique(hashes)
    node = xxhash.xxh64_intdigest(own.astype("<u8").tobytes()) - (1 << 63)
    if not len(own):
        return 0, node, [], np.empty(0, np.int32)
    least = np.full(len(FACTORS), (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 8192):
            least = np.minimum(least, (own[at : at + 8192, None] * FACTORS).min(axis=0))
        mixed = (own ^ (own >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    rows = least.reshape(BANDS, ROWS)
    bands = [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]
    return fingerprint(own), node, bands, np.unique((mixed >> np.uint64(33)).astype(np.int32))


class Tree:
    """A BK-tree over 64-bit integers under Hamming distance, built and searched by levels, for many values at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.looked = 0
        item = np.arange(1, len(values))
        at, parents, distances, children = np.zeros(len(item), np.int64), [], [], []
        while len(item):
            key = at * 65 + np.bitwise_count(values[item] ^ values[at])
            found, first, of = np.unique(key, return_index=True, return_inverse=True)  # the first to come is the child
            parents.append(found // 65)
            distances.append(found % 65)
            children.append(item[first])
            at = item[first][of]
            rest = at != item
            item, at = item[rest], at[rest]
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        order = np.argsort(parent, kind="stable")
        self.distance = np.concatenate(distances)[order] if parents else parent
        self.child = np.concatenate(children)[order] if parents else parent
        self.start = np.searchsorted(parent[order], np.arange(len(values) + 1))

    def near(self, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the values wanted, of the tree's values within the radius, and their distances.

        From a node at distance d only the edges from d - radius to d + radius are followed. ``looked`` counts the distances.
        """
        out = []
        for begin in range(0, len(wanted) if len(self.values) else 0, 256):
            who = np.arange(begin, min(begin + 256, len(wanted)))
            node = np.zeros(len(who), np.int64)
            while len(who):
                self.looked += len(who)
                d = np.bitwise_count(wanted[who] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                out.append((who[hit], node[hit], d[hit]))
                counts = self.start[node + 1] - self.start[node]
                edge = np.repeat(self.start[node] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                who, d = np.repeat(who, counts), np.repeat(d, counts)
                on = np.abs(self.distance[edge] - d) <= radius
                who, node = who[on], self.child[edge[on]]
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty)


def near_links(group: pd.DataFrame, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius of one shard, or between two tiles of one."""
    values, nodes, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["node"].tolist(), group["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side)
    two = bool(len(left) and len(right))
    if not two:
        left = right = np.arange(len(side))
    tree, forest, out = Tree(values[left]), Forest(len(nodes)), []
    for begin in range(0, len(right), 256):  # so that a group of near copies never has all its pairs in memory
        who, at, _ = tree.near(values[right[begin : begin + 256]], radius)
        i, j = right[begin + who], left[at]
        on = slice(None) if two else i > j
        for a, b in zip(i[on].tolist(), j[on].tolist(), strict=True):
            if forest.join(a, b):
                out.append((nodes[a], nodes[b]))
    return out


def peeled(grams: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets that can be linked at all, and the shingles that at least two of them hold, as (owner, shingle) in order of owner.

    Similar sets share the least similarity's part of either, so a set that has less of it in common with all others has no
    link; without it others may fall short.
    """
    sizes = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(grams)), sizes)
    _, what, counts = np.unique(np.concatenate(grams) if len(owner) else np.empty(0, np.int32), return_inverse=True, return_counts=True)
    needed, alive = least * sizes - 1e-9, np.ones(len(grams), bool)
    while True:
        on = counts[what] > 1
        owner, what = owner[on], what[on]
        keep = np.bincount(owner, minlength=len(grams)) >= needed
        gone = alive & ~keep
        if not gone.any():
            return np.flatnonzero(alive), owner, what
        alive &= keep
        on = alive[owner]
        counts = counts - np.bincount(what[~on], minlength=len(counts))
        owner, what = owner[on], what[on]


def similar_links(nodes: list[int], fps: np.ndarray, grams: list[np.ndarray], least: float, radius: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose similarity is at least ``least``.

    ``joined`` marks sets that are known to be connected with one another.
    """
    sizes, out = np.array([len(g) for g in grams]), []

    def linked(i: int, j: int) -> bool:
        n, m = sizes[i], sizes[j]
        if min(n, m) < least * max(n, m) - 1e-9:
            return False
        both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
        return both >= least * (n + m - both) - 1e-9

    if len(nodes) == 2:
        return [(nodes[0], nodes[1])] if linked(0, 1) else []
    alive, owner, what = peeled(grams, least)
    if len(alive) < 2:
        return out
    forest = Forest(len(nodes))
    if joined is not None and joined.any():
        first, *rest = np.flatnonzero(joined).tolist()
        for i in rest:
            forest.join(first, i)

    def settle(i: int, j: int) -> None:
        if forest.find(i) != forest.find(j) and linked(i, j) and forest.join(i, j):
            out.append((nodes[i], nodes[j]))

    def apart() -> np.ndarray:
        """The sets outside the largest component, whose own pairs need no look."""
        root = np.array([forest.find(x) for x in alive.tolist()])
        found, counts = np.unique(root, return_counts=True)
        return alive[root != found[counts.argmax()]]

    tree = Tree(fps[alive])
    for begin in range(0, len(alive), 256):  # nearest first: they connect most, and what is connected is not looked at
        rest = alive[begin : begin + 256]
        who, at, d = tree.near(fps[rest], radius)
        order = np.argsort(d, kind="stable")
        for i, j in zip(rest[who][order].tolist(), alive[at][order].tolist(), strict=True):
            settle(i, j)
    by_owner = np.searchsorted(owner, np.arange(len(nodes) + 1))
    order = np.argsort(what, kind="stable")
    holder = owner[order]
    start = np.searchsorted(what[order], np.arange(what.max() + 2))
    todo = apart()
    lengths = (start[what + 1] - start[what]).astype(np.int64)
    work = np.concatenate([[0], np.cumsum(lengths)])
    place = np.full(len(nodes), -1)
    place[alive] = np.arange(len(alive))
    at = 0
    while at < len(todo):  # queries in blocks of bounded work and memory
        end, load = at, 0
        while end < len(todo) and (end == at or load < 4_000_000) and (end - at + 1) * len(alive) <= 8_000_000 + len(alive):
            load += int(work[by_owner[todo[end] + 1]] - work[by_owner[todo[end]]])
            end += 1
        who = todo[at:end]
        at = end
        spans = np.concatenate([np.arange(by_owner[x], by_owner[x + 1]) for x in who.tolist()])
        of = np.repeat(np.arange(len(who)), by_owner[who + 1] - by_owner[who])
        n = lengths[spans]
        hits = np.repeat(start[what[spans]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(np.repeat(of, n) * len(alive) + place[holder[hits]], minlength=len(who) * len(alive)).reshape(len(who), len(alive))
        i, j = np.nonzero(shared >= least / (1 + least) * (sizes[who][:, None] + sizes[alive][None]) - 1e-9)
        for a, b in zip(who[i].tolist(), alive[j].tolist(), strict=True):  # the counts are of whole sets, and so decide
            if forest.join(a, b):
                out.append((nodes[a], nodes[b]))
    return out


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """``(key, fp, node)`` of every document, and with ``similar`` also bands, all shingles' hashes and the text's hash ``seen``.

    With ``similar`` the fingerprint is of the distinct shingles, as the similarity is.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"key": batch["key"]})
        if similar:
            found = [sets(shingle_hashes(t, k)) for t in batch["text"]]
            out["fp"] = np.array([f for f, *_ in found], np.uint64).astype(np.int64)
            out["node"], out["bands"], out["grams"] = ([f[i] for f in found] for i in (1, 2, 3))
            return out.assign(size=[len(f[3]) for f in found], seen=batch["seen"])
        return out.assign(fp=np.array([fingerprint(shingle_hashes(t, k)) for t in batch["text"]], np.uint64).astype(np.int64))

    kind = docs.schema[key].dataType.simpleString()
    schema = "key string, fp long" + ", node long, bands array<long>, grams array<int>, size int, seen long" * similar
    seen = [F.xxhash64(text).alias("seen")] * similar
    rows = per_batch(run, docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), *seen), schema).withColumn("key", F.col("key").cast(kind))
    return rows if similar else rows.withColumn("node", F.col("fp"))


def within(nodes: DataFrame, radius: int) -> DataFrame:
    """``(u, v)``: forests of the fingerprints ``node`` that differ in ``radius`` bits, 2 at most."""
    bits = max(0, min(21, int(np.log2(max(1, nodes.count() / SHARD)))))
    keys = [F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("node", at + wide - bits).bitwiseAND((1 << bits) - 1).alias("value")) for p, (at, wide) in enumerate(BLOCKS)]
    dealt = nodes.select("node", F.explode(F.array(*keys)).alias("s")).select("node", "s.part", "s.value")
    shards = stored(dealt.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    dealt = dealt.join(shards, ["part", "value"])  # small shards' sizes are broadcast by the planner, a large shard's rows can be split
    dealt = dealt.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # in the pair (t, t) all are on side 0; in (a, b) tile a is on side 0 and tile b on side 1
    dealt = dealt.select("part", "value", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.col("node").alias("fp"), "node", (F.col("tile") > F.col("other")).cast("int").alias("side"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(near_links(group, radius), columns=["u", "v"], dtype="int64")

    return dealt.groupBy("part", "value", "a", "b").applyInPandas(run, "u long, v long")


def alike(rows: DataFrame, chosen: DataFrame, radius: int, least: float) -> DataFrame:
    """``(u, v)``: forests of the sets whose similarity is at least ``least``; of the stored ``rows`` those that ``chosen`` names."""
    dealt = rows.select("row", "node", "size", "bands").join(chosen, "row").select("row", "node", "size", F.posexplode("bands").alias("part", "value"))
    shards = dealt.groupBy("part", "value").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    shards = stored(shards.groupBy("n", "weight", "who").agg(F.min(F.struct("part", "value")).alias("s")).select("s.part", "s.value", "weight"), "shards")
    lanes = int((shards.where(F.col("weight") <= WEIGHT).agg(F.sum("weight")).first()[0] or 0) // LANE + 1)
    dealt = stored(dealt.select("row", "node", "part", "value").join(shards, ["part", "value"]), "dealt")
    whole = rows.select("row", "fp", "grams")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, shard in group.groupby(["part", "value"], sort=False):
            out += similar_links(shard["node"].tolist(), shard["fp"].to_numpy(np.int64).view(np.uint64), shard["grams"].tolist(), least, radius, shard["joined"].to_numpy() if "joined" in shard else None)
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    small = dealt.where(F.col("weight") <= WEIGHT).withColumn("lane", F.pmod(F.xxhash64("part", "value"), F.lit(lanes)))
    found = small.select("lane", "part", "value", "row", "node").join(whole, "row").groupBy("lane").applyInPandas(run, "u long, v long")
    if shards.where(F.col("weight") > WEIGHT).isEmpty():
        return found
    return found.union(alike_in_large(stored(dealt.where(F.col("weight") > WEIGHT).select("part", "value", "row", "node").join(whole, "row").drop("row"), "large-shards"), run, least))


def alike_in_large(rows: DataFrame, run, least: float, rounds: int = 3) -> DataFrame:
    """The links of shards that no task can hold: ``rows`` are ``(part, value, node, fp, grams)``."""
    shard = ["part", "value"]
    for _ in range(rounds):  # sets that share too little with all others of the shard have no link
        held = rows.select(*shard, "node", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
        often = stored(held.groupBy(*shard, "gram").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "large-often")  # so that a frequent shingle's rows can be split
        shared = held.join(often, [*shard, "gram"]).groupBy(*shard, "node").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
        shared = stored(shared.where(F.col("shared") >= F.col("size") * least - 1e-9), "large-shared")
        rows = stored(rows.drop("shared").join(shared.drop("size"), [*shard, "node"]), "large-peeled")
    middle = rows.groupBy(*shard).agg(F.max_by("node", F.struct(F.col("shared") / F.size("grams"), "node")).alias("middle"))
    middle = stored(rows.join(middle, [*shard]).where("node = middle").select(*shard, "middle", F.col("grams").alias("its")), "large-middles")
    both = F.size(F.array_intersect("grams", "its"))
    rows = rows.join(middle, shard).withColumn("joined", both >= (F.size("grams") + F.size("its") - both) * least - 1e-9).drop("its", "shared")
    rows = stored(rows, "large-joined")
    tiles = rows.groupBy(*shard).agg(*[F.ceil(F.sum(F.when(F.col("joined") == j, F.size("grams")).otherwise(0)) / (WEIGHT / 2)).cast("int").alias(n) for n, j in (("on", True), ("off", False))])
    rows = rows.join(stored(tiles, "large-tiles"), shard)
    tile = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("joined"), F.col("on")).otherwise(F.col("off")), F.lit(1))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    # linked sets meet the tiles of those that are not, and those meet one another too
    met = F.when(F.col("joined"), F.transform(upto("off"), lambda o: F.struct(o.alias("a"), (-1 - tile).alias("b")))).otherwise(
        F.concat(F.transform(upto("on"), lambda o: F.struct(tile.alias("a"), (-1 - o).alias("b"))), F.transform(upto("off"), lambda o: F.struct(F.least(tile, o).alias("a"), F.greatest(tile, o).alias("b"))))
    )
    dealt = rows.select(*shard, "node", "fp", "grams", "joined", F.explode(met).alias("m")).select("*", "m.a", "m.b").drop("m")
    found = dealt.groupBy(*shard, "a", "b").applyInPandas(run, "u long, v long")
    return found.union(rows.where("joined and node <> middle").select(F.col("middle").alias("u"), F.col("node").alias("v")))


def _grouped(docs: DataFrame, k: int, radius: int, least: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fingerprints``, stored, and ``(node, first)``, stored: the first row of the node's group.

    That is its smallest key; with ``least`` a struct of the smallest key, null last, and the smallest ``seen`` under it.
    """
    rows = fingerprints(docs, k, key, text, bool(least))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()) if least else rows, "fingerprints")
    head = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "seen")) if least else F.min("key")
    nodes = stored(rows.groupBy("node").agg(head.alias("first"), *([F.min("row").alias("row")] if least else [])), "distinct-fingerprints")
    if least:  # one row of each set, known by its number: equal sets of many rows meet nowhere
        found = alike(rows, nodes.select("row"), radius, least)
    else:
        found = within(nodes, radius)
    found = stored(components(found).join(nodes.select("node", "first"), "node"), "linked")
    firsts = stored(found.groupBy("root").agg(F.min("first").alias("of_all")), "group-firsts")
    linked = found.select("node", "root").join(firsts, "root").select("node", "of_all")
    known = nodes.select("node", "first").join(linked, "node", "left").select("node", F.coalesce("of_all", "first").alias("first"))
    return rows, stored(known, "firsts")


def near_groups(docs: DataFrame, k: int = 3, radius: int = 2, least: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, component_id)`` of every document; component_id is the smallest key of its group.

    With ``least`` (a Jaccard similarity of the shingle sets) any radius goes and links are verified; without it the
    radius may be 2 at most, and the result is exact.
    """
    if radius > 2 and not least:
        raise ValueError("a radius over 2 needs a least similarity")
    rows, nodes = _grouped(docs, k, radius, least, key, text)
    nodes = nodes.select("node", F.col("first.key" if least else "first").alias("component_id"))
    return rows.select("key", "fp", "node").join(nodes, "node").select(F.col("key").alias(key), "fp", "component_id")


def deduplicate(docs: DataFrame, k: int = 5, radius: int = RADIUS, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all its columns: of the smallest key, and of that key's texts in the group one.

    A row is known by key and text, so unlike texts under one key are rows of their own. A row without a key stays where
    its group has no key, and beside that one row that has neither key nor words.
    """
    rows, nodes = _grouped(docs, k, radius, least, key, text)
    keep = nodes.select("first.key", "first.seen").distinct()
    blank = rows.where(F.col("key").isNull() & (F.size("grams") == 0)).agg(F.min("seen").alias("seen")).where("seen is not null")
    keep = keep.union(blank.select(F.lit(None).cast(docs.schema[key].dataType), "seen"))
    known = lambda c, seen: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("dedup_key"), F.col(c).isNull().alias("dedup_none"), seen.alias("dedup_seen")]
    names = ["dedup_key", "dedup_none", "dedup_seen"]
    keep = stored(keep.select(*known("key", F.col("seen"))).distinct(), "kept-rows")
    return docs.select("*", *known(key, F.xxhash64(text))).join(keep, names).dropDuplicates(names).select(*docs.columns)


by_value(__name__)
