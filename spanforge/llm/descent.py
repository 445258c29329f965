"""Embedding near-dedup by NN-descent.

1. Equal vectors are one class. Each class starts with its nearest neighbours inside blocks of several random
   orderings of all vectors (a forest of random hyperplanes, sorted and cut into blocks of BLOCK rows).
2. Rounds of NN-descent: around every vector its neighbours and those that list it meet, each compares with the
   neighbours (neighbours of neighbours), and every list keeps the best it has seen. A vector that many others list
   meets them in portions, so the rows stay proportional to the links.
3. A list whose every entry is within the threshold is saturated and may lack links. Saturated vectors look on, in
   further orderings, for neighbours outside their component, which their own group can't push out, until a search
   joins no more components. Then such a list is enlarged to all members of its component, counted block against
   block; only counts leave a block.
4. The recall is audited: a fixed number of vectors, and as many that have links, are compared with all rows, and
   further orderings and rounds run until the recall found reaches RECALL. If it no longer rises, what is found
   counts if that recall is LEAST_RECALL or more, and else that is an error. The recall is part of the result.

Only links at the threshold or above are kept. Everything is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .session import cut, settled

THRESHOLD = 0.9
NEIGHBOURS = 8
TREES = 4
ROUNDS = 2
BLOCK = 512
AUDITED = 200
RECALL = 0.98
LEAST_RECALL = 0.9
MOST_PASSES = 3


def _packed(x: np.ndarray) -> bytes:
    """A vector as bytes: the size of an item, then the items, four bytes each where that loses nothing, else eight."""
    short = x.astype(np.float32)
    kept = short if (short == x).all() else x
    return bytes([kept.itemsize]) + kept.tobytes()


def _unit(rows: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of one length as unit rows of doubles."""
    x = np.empty((len(rows), dim))
    for size in (4, 8):
        mine = [i for i, r in enumerate(rows) if r[0] == size]
        if mine:
            x[mine] = np.frombuffer(b"".join(rows[i] for i in mine), np.dtype([("size", "u1"), ("x", f"<f{size}", dim)]))["x"]
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dim(row: bytes) -> int:
    return (len(row) - 1) // row[0]


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, dim, vec): the usable vectors as _packed() bytes, scaled by a power of two to a largest component of 0.5 to 1."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            flat = np.where(np.isfinite(flat), flat, np.inf)
            at = np.cumsum(n) - n
            keep, vec, dims = [], [], []
            for i in np.flatnonzero(n).tolist():
                x = flat[at[i] : at[i] + n[i]]
                top = np.abs(x).max()
                if 0 < top < np.inf:
                    keep.append(i)
                    vec.append(_packed(np.ldexp(x, -np.frexp(top)[1]) + 0.0))
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(vec, pa.binary())], names=["id", "dim", "vec"])

    return table.select(table[vec_id].cast("long").alias("id"), table[embedding].cast("array<double>").alias("e")).where(F.col("id").isNotNull()).mapInArrow(go, "id long, dim int, vec binary")


def _planes(dim: int, tree: int, bits: int) -> np.ndarray:
    return np.random.default_rng(1000 * tree + dim).standard_normal((dim, bits))


def _ordered(classes: DataFrame, tree: int, bits: int) -> DataFrame:
    """The classes with their code under the tree's hyperplanes and a last projection, to sort by."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(1).to_numpy()
            code, side = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            vec = batch.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                p = _unit([vec[i] for i in mine], d) @ _planes(d, tree, bits + 1)
                code[mine] = ((p[:, :bits] > 0) @ (1 << np.arange(bits))) + (d << 32)
                side[mine] = p[:, bits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(side)], names=["id", "dim", "vec", "code", "side"])

    return classes.mapInArrow(go, "id long, dim int, vec binary, code long, side double")


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries of each row that aren't -inf."""
    k = min(k, sims.shape[1])
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(sims)), k)
    cols = top.ravel()
    good = sims[rows, cols] > -np.inf
    return rows[good], cols[good]


def _in_blocks(k: int, block: int):
    """The k nearest rows of another home, of rows (id, dim, vec, home), within each block."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, dims, homes = [], [], [], []

        def out():
            for d in set(dims):
                mine = [i for i in range(len(dims)) if dims[i] == d]
                x = _unit([vecs[i] for i in mine], d)
                sims = x @ x.T
                home = np.array([homes[i] for i in mine], np.int64)
                sims[home[:, None] == home[None, :]] = -np.inf
                np.fill_diagonal(sims, -np.inf)
                u, v = _best(sims, k)
                at = np.array([ids[i] for i in mine], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at[u]), pa.array(at[v]), pa.array(sims[u, v])], names=["u", "v", "sim"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            dims += batch.column(1).to_pylist()
            vecs += batch.column(2).to_pylist()
            homes += batch.column(3).to_pylist()
            while len(ids) >= 2 * block:
                rest = ids[block:], vecs[block:], dims[block:], homes[block:]
                ids, vecs, dims, homes = ids[:block], vecs[:block], dims[:block], homes[:block]
                yield from out()
                ids, vecs, dims, homes = rest
        if ids:
            yield from out()

    return go


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of every vector. A vector has a bounded number of offers: k or so from each source."""
    held = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).groupBy("u").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("sim", "v")))), 1, k).alias("near"))
    return cut(held.select("u", F.explode("near").alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.sim").alias("sim")))


def _meeting(k: int, portion: int = 256):
    """Rows (centre, side, id, vec) by centre: side 0 is listed by the centre, side 1 lists it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, listed, coming = None, [], []

        def out():
            if listed and (len(listed) > 1 or coming):
                ids = np.array([x[0] for x in listed] + [x[0] for x in coming], np.int64)
                x = _unit([x[1] for x in listed] + [x[1] for x in coming], _dim(listed[0][1]))
                sims = x @ x[: len(listed)].T
                sims[ids[:, None] == ids[None, : len(listed)]] = -np.inf
                u, v = _best(sims, 4)
                a, b, s = ids[u], ids[v], sims[u, v]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([s, s]))], names=["u", "v", "sim"])

        for batch in batches:
            for c, side, i, v in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if c != centre:
                    yield from out()
                    centre, listed, coming = c, [], []
                (coming if side else listed).append((i, v))
                if len(coming) >= portion:
                    yield from out()
                    coming = []
        yield from out()

    return go


def _descend(classes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    vec = classes.select(F.col("id").alias("vid"), "vec")
    listed = edges.join(vec, edges["v"] == vec["vid"]).select(F.col("u").alias("centre"), F.lit(0).alias("side"), F.col("v").alias("id"), "vec")
    coming = edges.join(vec, edges["u"] == vec["vid"]).select(F.col("v").alias("centre"), F.lit(1).alias("side"), F.col("u").alias("id"), "vec")
    # A hub's coming rows are dealt over portions; its own list (k rows) goes to each of them.
    sizes = edges.groupBy(F.col("v").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / 2048).cast("int").alias("parts"))
    coming = coming.join(sizes, coming["centre"] == sizes["hub"]).select("centre", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "side", "id", "vec")
    listed = listed.join(sizes, listed["centre"] == sizes["hub"], "left").select("centre", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"), "side", "id", "vec")
    met = listed.unionByName(coming).repartition("centre", "part").sortWithinPartitions("centre", "part", "side", "id")
    key = F.xxhash64("centre", "part")
    offers = met.select(key.alias("centre"), "side", "id", "vec").mapInArrow(_meeting(k), "u long, v long, sim double")
    return _lists(edges.unionByName(offers), k)


def _outside(classes: DataFrame, homes: DataFrame, trees: range, k: int, bits: int, threshold: float) -> DataFrame:
    """(a, b): links to the nearest vectors of other components. homes: id, component of the vectors that look."""
    home = homes.select(F.col("id").alias("hid"), "component")
    looking = cut(classes.join(home, classes["id"] == home["hid"], "left_semi").select("id", "dim", "vec"))
    found = None
    for tree in trees:
        # _ordered keeps three columns; the component comes back by the id.
        ordered = _ordered(looking, tree, bits).join(home, F.col("id") == F.col("hid"))
        sorted_rows = ordered.repartitionByRange("code", "side", "id").sortWithinPartitions("code", "side", "id")
        offers = sorted_rows.select("id", "dim", "vec", "component").mapInArrow(_in_blocks(k, BLOCK), "u long, v long, sim double")
        found = offers if found is None else found.unionByName(offers)
    return cut(found.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())


def _grow(classes: DataFrame, edges: DataFrame | None, trees: range, k: int, rounds: int, bits: int) -> DataFrame:
    for tree in trees:
        sorted_rows = _ordered(classes, tree, bits).repartitionByRange("code", "side", "id").sortWithinPartitions("code", "side", "id")
        offers = sorted_rows.select("id", "dim", "vec", F.col("id").alias("home")).mapInArrow(_in_blocks(k, BLOCK), "u long, v long, sim double")
        edges = offers if edges is None else edges.unionByName(offers)
    edges = _lists(edges, k)
    for _ in range(rounds):
        edges = _descend(classes, edges, k)
    return edges


def _counted(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(id, n): linked other classes' copies of each member, components compared block against block.

    members: id, component. A block pair is a group of at most two blocks of rows; it gives one count a row.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select(F.col("component").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = settled(sizes)  # so that the join on the component is a plain one, which splits a large component
    rows = members.join(sizes, members["component"] == sizes["of"]).join(classes.select(F.col("id").alias("vid"), "vec", "copies"), F.col("id") == F.col("vid"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.select("component", "id", "vec", "copies", own.alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).alias("pair"))
    rows = rows.select(F.xxhash64("component", "pair").alias("group"), (F.col("pair.i") == F.col("pair.j")).alias("alone"), F.col("own").alias("block"), "id", "copies", "vec")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def out():
            if len(held) < 2:
                return
            x = _unit([h[4] for h in held], _dim(held[0][4]))
            ids, copies = np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)
            block = np.array([h[1] for h in held])
            linked = (x @ x.T) >= threshold
            np.fill_diagonal(linked, False)
            if not held[0][0]:
                linked &= block[:, None] != block[None, :]
            n = linked @ copies
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some])], names=["id", "n"])

        for batch in batches:
            for row in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                if row[0] != group:
                    yield from out()
                    group, held = row[0], []
                held.append(row[1:])
        yield from out()

    dealt = rows.repartition("group").sortWithinPartitions("group", "block", "id")
    return dealt.mapInArrow(go, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _audit(classes: DataFrame, found: DataFrame, threshold: float, audited: int) -> float:
    """The share of the links of `audited` classes, and of as many that `found` (id, n) gives links, that it holds.

    They are compared with all rows.
    """
    some = classes.orderBy(F.xxhash64("id")).limit(audited).select("id", "vec")
    linked = found.where("n > 0").select(F.col("id").alias("lid")).orderBy(F.xxhash64(F.lit("linked"), "lid")).limit(audited)
    picked = some.union(classes.join(linked, classes["id"] == linked["lid"], "left_semi").select("id", "vec")).distinct().toArrow()
    ids, vec = picked.column("id").to_numpy(), picked.column("vec").to_pylist()
    if not len(ids):
        return 1.0
    shared = classes.sparkSession.sparkContext.broadcast((ids, vec))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = shared.value
        for batch in batches:
            rows, mine, copies = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(3).to_numpy()
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                q, r = [i for i, v in enumerate(asked) if _dim(v) == d], np.flatnonzero(dims == d).tolist()
                if q:
                    linked = _unit([asked[i] for i in q], d) @ _unit([rows[i] for i in r], d).T >= threshold
                    linked &= at[q][:, None] != mine[r][None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(at[q]), pa.array(linked @ copies[r])], names=["id", "n"])

    true = classes.select("id", "dim", "vec", "copies").mapInArrow(go, "id long, n long").groupBy("id").agg(F.sum("n").alias("true"))
    both = true.join(found.select(F.col("id").alias("fid"), "n"), F.col("id") == F.col("fid"), "left")
    row = both.agg(F.sum("true").alias("t"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("true"))).alias("f")).first()
    return row["f"] / row["t"] if row["t"] else 1.0


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row with a vec_id; recall is that of the audit.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths with each other. Rows with equal vectors link with one another; rows that share a vec_id are
    rows of their own in n_links and share a component. A row with a null vec_id has no id to report and is left out.
    An empty table gives no rows; further columns are ignored.
    """
    usable = cut(vectors(table, vec_id, embedding))
    classes = cut(usable.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "dim", "vec", "copies"))
    # Two classes can't share an id unless rows share one; the smallest vector then stands for the id in the graph.
    graph = classes
    n = graph.count()
    bits = int(min(20, max(1, np.ceil(np.log2(max(2, n / BLOCK))) + 2)))
    rows = graph.select("id", "dim", "vec")
    edges, beyond, trees, passes, recall = None, None, 0, 0, -1.0
    while True:
        edges = _grow(rows, edges, range(trees, trees + TREES), k, ROUNDS, bits)
        trees += TREES
        links = edges.where((F.col("sim") >= threshold) & (F.col("u") != F.col("v"))).select(F.col("u").alias("a"), F.col("v").alias("b"))
        links = links if beyond is None else links.union(beyond).distinct()
        groups = cut(components(links))
        saturated = cut(edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).where((F.col("n") >= k) & (F.col("low") >= threshold)).select(F.col("u").alias("full")))
        # Each search that finds a link joins components, so this ends.
        while saturated.limit(1).count():
            looking = groups.join(saturated, groups["node"] == saturated["full"], "left_semi").select(F.col("node").alias("id"), "component")
            more = _outside(rows, looking, range(trees, trees + TREES), k, bits, threshold)
            trees += TREES
            if not more.limit(1).count():
                break
            beyond = more if beyond is None else cut(beyond.union(more).distinct())
            links = links.union(more).distinct()
            groups = cut(components(links))
        full = settled(groups.join(saturated, groups["node"] == saturated["full"], "left_semi").select(F.col("component").alias("dense")).distinct())
        dense = groups.join(full, groups["component"] == full["dense"], "left_semi").select(F.col("node").alias("id"), "component")
        counted = _counted(graph, dense, threshold)
        both = links.union(links.select("b", "a")).distinct()
        thin = groups.join(full, groups["component"] == full["dense"], "left_anti").select(F.col("node").alias("id"))
        size = graph.select(F.col("id").alias("vid"), "copies")
        plain = both.join(thin, both["a"] == thin["id"], "left_semi").join(size, both["b"] == size["vid"]).groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("n"))
        found = cut(counted.unionByName(plain))
        before, recall, passes = recall, _audit(graph, found, threshold, AUDITED), passes + 1
        if recall >= RECALL:
            break
        if passes >= MOST_PASSES and recall <= before:
            if recall >= LEAST_RECALL:
                break
            raise RuntimeError(f"the recall found stays at {recall:.3f} after {passes} passes")
    other = found.select(F.col("id").alias("fid"), F.col("n").alias("others"))
    group = groups.select(F.col("node").alias("gid"), "component")
    home = classes.join(other, classes["id"] == other["fid"], "left").join(group, classes["id"] == group["gid"], "left")
    home = home.select(F.col("dim").alias("hdim"), F.col("vec").alias("hvec"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = usable.join(home, (usable["dim"] == home["hdim"]) & (usable["vec"] == home["hvec"])).select("id", "n_links", "component_id")
    bad = table.where(table[vec_id].isNotNull()).select(table[vec_id].cast("long").alias("id")).exceptAll(usable.select("id")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(bad)
    return out.select(F.col("id").cast(table.schema[vec_id].dataType).alias("vec_id"), "n_links", F.col("component_id").cast(table.schema[vec_id].dataType).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"))
