"""Embedding near-dedup by PCA-ordered, tiled comparison.

Vectors are scaled to length 1 and turned to their ``LEAD`` leading principal components, largest first. Tiles of vectors
are compared pairwise; a comparison accumulates the leading dimensions first, adds the product of the suffixes' norms as
an upper bound of the rest, and drops the pairs that cannot reach the threshold. What is left is computed exactly, in
double precision, from the vectors as given. The components come from two passes of sums over all vectors (a random sketch
of the second moments, and the moments within its range); any orthonormal axes give the same links.

Equal vectors of a label are collapsed first and counted. Two unit vectors of cosine c lie within sqrt(2 - 2c) of each
other along the first component, so labels are cut into cells of that width along it, and only a cell's own and its next
neighbour's vectors meet. Cells of more than ``TILE`` vectors are cut into tiles by hash; each pair of tiles is a task of
bounded size. A task gives link counts and a spanning forest, never its pairs. The work is quadratic in a cell's distinct
vectors, as the method is; no partner is capped.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths never link; ids may repeat or be null (a null id is never the smallest); an
empty table gives no rows. Columns beside key, vector and label are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, stored
from .graph import Forest, components

TILE = 8000
BLOCK = 1000
STEP = 16
LEAD = 64


def unit_vectors(batch: pd.DataFrame):
    """The unit vectors of a batch, by number of dimensions."""
    for d, part in batch.groupby("d"):
        x = np.stack(part["vector"].to_numpy()).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        yield int(d), x / np.linalg.norm(x, axis=1, keepdims=True)


def summed(classes: DataFrame, product) -> dict[int, np.ndarray]:
    """The sum of ``product(d, unit vectors)``, a matrix, over all vectors of each number of dimensions."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in unit_vectors(batch):
                sums[d] = sums.get(d, 0) + product(d, x)
        for d, s in sums.items():
            i, j = np.divmod(np.arange(s.size), s.shape[1])
            yield pd.DataFrame({"d": d, "i": i, "j": j, "x": s.ravel()})

    rows = classes.select(F.size("vector").alias("d"), "vector").mapInPandas(run, "d int, i int, j int, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for d, part in rows.groupby("d"):
        out[int(d)] = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        out[int(d)][part["i"], part["j"]] = part["x"]
    return out


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes as columns, by number of dimensions; the driver gets ``LEAD`` sums a dimension, whatever the rows."""
    wide = lambda d: min(d, LEAD)
    random = lambda d: np.random.default_rng(d).normal(size=(d, wide(d)))
    span = {d: np.linalg.qr(s)[0] for d, s in summed(classes, lambda d, x: x.T @ (x @ random(d))).items()}
    inside = summed(classes, lambda d, x: (x @ span[d]).T @ (x @ span[d]))
    return {d: span[d] @ np.linalg.eigh((s + s.T) / 2)[1][:, ::-1] for d, s in inside.items()}


def compare(a: np.ndarray, b: np.ndarray, basis: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``a`` and ``b`` of cosine at least ``least``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    pa, pb = a / na[:, None] @ basis, b / nb[:, None] @ basis
    rest_a, rest_b = (np.sqrt(np.maximum(0, 1 - np.cumsum(p * p, axis=1))) for p in (pa, pb))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for begin in range(0, len(a), BLOCK):
        own, left, to, wide = slice(begin, begin + BLOCK), rest_a[begin : begin + BLOCK], min(STEP, basis.shape[1]), basis.shape[1]
        sums = pa[own, :to] @ pb[:, :to].T
        i, j = np.nonzero(sums + np.outer(left[:, to - 1], rest_b[:, to - 1]) >= least - 1e-7)
        sums, i = sums[i, j], i + begin
        while to < wide and len(i):
            end = min(2 * to, wide)
            sums = sums + np.concatenate([np.einsum("ij,ij->i", pa[i[k : k + 65536], to:end], pb[j[k : k + 65536], to:end]) for k in range(0, len(i), 65536)])
            on = sums + rest_a[i, end - 1] * rest_b[j, end - 1] >= least - 1e-7
            i, j, sums, to = i[on], j[on], sums[on], end
        for k in range(0, len(i), 65536):
            x, y = i[k : k + 65536], j[k : k + 65536]
            hit = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= least
            found.append((x[hit], y[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_vectors(
    table: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """n_links (other vectors linked directly), component_id (smallest key reachable) and kept for every vector."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    sound = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(sound, F.xxhash64("label", "vector")))
    classes = rows.where("node is not null").groupBy("node", "label", "vector").agg(F.min("key").alias("least_key"), F.count("*").alias("n"))
    classes = stored(classes, "vector-classes")
    basis = bases(classes)
    width = float(np.sqrt(2 - 2 * least)) + 1e-9

    def first(batches):
        for batch in batches:
            at = [float(np.asarray(v, float) @ basis[len(v)][:, 0] / np.linalg.norm(np.asarray(v, float))) for v in batch["vector"]]
            yield pd.DataFrame({"node": batch["node"], "label": batch["label"], "cell": np.floor(np.array(at, float) / width).astype(int), "n": batch["n"], "vector": batch["vector"]})

    kinds = dict(classes.dtypes)
    placed = classes.select("node", "label", "n", "vector").mapInPandas(first, f"node long, label {kinds['label']}, cell int, n long, vector {kinds['vector']}").withColumn("d", F.size("vector"))
    placed = stored(placed, "vector-cells")
    cells = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    for by, into in ((0, "own"), (1, "before"), (-1, "after")):
        near = cells.select("label", "d", (F.col("cell") + by).alias("cell"), F.col("tiles").alias(into))
        placed = placed.join(near, ["label", "d", "cell"], "left")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda c, a, e, b, side: F.struct(c.alias("c"), a.alias("a"), e.alias("e"), b.alias("b"), side.alias("side"))
    cell, tile, one, zero = F.col("cell"), F.col("tile"), F.lit(1), F.lit(0)
    met = F.concat(
        F.transform(upto("own"), lambda o: pair(cell, F.least(tile, o), cell, F.greatest(tile, o), (tile > o).cast("int"))),
        F.transform(upto("after"), lambda o: pair(cell, tile, cell + 1, o, zero)),
        F.transform(upto("before"), lambda o: pair(cell - 1, o, cell, tile, one)),
    )
    dealt = placed.select("node", "label", "d", "n", "vector", F.explode(met).alias("m")).select("node", "label", "d", "n", "vector", "m.*")

    def task(group: pd.DataFrame) -> pd.DataFrame:
        alone = (group["c"].iloc[0], group["a"].iloc[0]) == (group["e"].iloc[0], group["b"].iloc[0])
        sides = [group] if alone else [group[group["side"] == s] for s in (0, 1)]
        if not all(map(len, sides)):
            return pd.DataFrame({"node": [], "other": [], "n": []}).astype({"node": "int64", "other": "int64", "n": "int64"})
        axes = basis[int(group["d"].iloc[0])]
        x = [np.stack(s["vector"].to_numpy()).astype(float) for s in sides]
        i, j = compare(x[0], x[-1], axes, least)
        if alone:
            i, j = i[i < j], j[i < j]
        ids = [s["node"].to_numpy(np.int64) for s in sides]
        ns = [s["n"].to_numpy(np.int64) for s in sides]
        count = [np.zeros(len(s), np.int64) for s in sides]
        np.add.at(count[0], i, ns[-1][j])
        np.add.at(count[-1], j, ns[0][i])
        forest, shift, edges = Forest(sum(map(len, sides))), 0 if alone else len(sides[0]), []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(a, b + shift):
                edges.append((ids[0][a], ids[-1][b], 0))
        out = [pd.DataFrame({"node": k[c > 0], "other": k[c > 0], "n": c[c > 0]}) for k, c in zip(ids, count, strict=True)]
        return pd.concat([*out, pd.DataFrame(edges, columns=["node", "other", "n"], dtype="int64")])

    found = stored(dealt.groupBy("label", "d", "c", "a", "e", "b").applyInPandas(task, "node long, other long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("more"))
    roots = components(found.where("n = 0").select(F.col("node").alias("u"), F.col("other").alias("v")))
    own = classes.select("node", "least_key", "n")
    least_of = roots.join(own, "node").groupBy("root").agg(F.min("least_key").alias("reached"))
    linked = roots.join(least_of, "root").select("node", "reached")
    known = own.join(counts, "node", "left").join(linked, "node", "left")
    known = known.select("node", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("reached", "least_key").alias("component_id"))
    known = stored(known, "vector-known")
    sound_rows = rows.where("node is not null").select("key", "node").join(known, "node").select("key", "n_links", "component_id")
    out = sound_rows.union(rows.where("node is null").select("key", F.lit(0).cast("long"), "key"))
    return out.select(F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


by_value(__name__)
