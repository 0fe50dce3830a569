"""Near-duplicate vectors by collision-counting projections.

Unit vectors within cosine c differ by at most r = sqrt(2 - 2c), so each of many one-dimensional
projections places them within a narrow window of each other, whereas unrelated vectors spread over
the whole line. Each of L tables sorts the vectors by K projections, cut into runs of width W at a
random offset: vectors that share all K runs share a cell. In a cell, COUNTED more projections count, for
each pair, how often one lies in the window centred on the other; a pair with at least ``needed``
collisions, and no other, is verified by its cosine in double precision.

The cells are there because windows on single projections can't be narrow for large N: a window that keeps
pairs at the threshold holds about a third of all vectors, so counting without cells grows with N squared.

K follows from the number of vectors (few strangers share a cell), L and ``needed`` from the recall
wanted at the threshold itself; closer pairs are found more surely. Pairs are never emitted: a pair
counts in the first table where both share a cell, each cell returns a count of links for each of its
vectors and one edge for each vector to the least one it is linked with in the cell's own components.

Equal vectors are folded into one before anything is dealt out. A cell of more than BLOCK vectors is
cut into blocks, and each pair of blocks is a task's work of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.util import checkpointed, connected_components

WIDTH, COUNTED, BLOCK, SMALL, STRANGERS = 2.0, 16, 1024, 48, 8.0


def _cell_rate(distance: float) -> float:
    """Probability that two points at this distance fall into one run of a projection."""
    c = WIDTH / distance
    tail = math.erfc(c / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int, float, int]:
    """(K, L, window, needed) for n distinct vectors."""
    r = math.sqrt(2 - 2 * cosine)
    k = max(1, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(_cell_rate(math.sqrt(2)))))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - _cell_rate(r) ** k)))
    window = 2 * r
    p = math.erf(window / r / math.sqrt(2))
    needed, lost = 0, 0.0
    while True:  # the largest count that a pair at the threshold misses with a chance under 0.5 %
        lost += math.comb(COUNTED, needed) * p**needed * (1 - p) ** (COUNTED - needed)
        if lost > 0.005:
            return k, tables, window, needed
        needed += 1


def _packed(x: list[float]) -> bytes:
    """A vector's bytes: single precision where that loses nothing."""
    v = np.asarray(x, dtype=np.float64)
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return b"f" + short.tobytes() if (short == v).all() else b"d" + v.tobytes()


def _units(rows: list[bytes]) -> np.ndarray:
    """Packed vectors of one dimension as unit vectors in double precision."""
    kinds = {"f": np.float32, "d": np.float64}
    if len({(x[:1], len(x)) for x in rows}) == 1:
        v = np.frombuffer(b"".join(x[1:] for x in rows), dtype=kinds[rows[0][:1].decode()]).astype(np.float64).reshape(len(rows), -1)
    else:
        v = np.stack([np.frombuffer(x[1:], dtype=kinds[x[:1].decode()]).astype(np.float64) for x in rows])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _folded(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, key and v: the packed vector and a digest of it; null where nothing can link."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            keys, values = [], []
            for x in batch.column(1).to_pylist():
                key = value = None
                if x and None not in x and np.isfinite(x).all() and any(x):
                    key, value = blake2b(np.asarray(x, dtype=np.float64).tobytes(), digest_size=16).digest(), _packed(x)
                keys.append(key)
                values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["vec_id", "key", "v"])

    return vectors.select(F.col(vec_id).cast("bigint"), F.col(embedding)).mapInArrow(fold, "vec_id bigint, key binary, v binary")


def _name(least_id, key) -> F.Column:
    """A vector's name: its least id, in an order that bytes keep (null last), then its digest."""
    big = F.unhex(F.lpad(F.hex(F.col(least_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(F.col(least_id).isNull(), F.unhex(F.lit("01" + "00" * 8))).otherwise(F.concat(F.unhex(F.lit("00")), big)), F.col(key))


def _id_of(name) -> F.Column:
    big = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), big)


def _dealt(distinct: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """rep, w, v and the cells of all tables."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed + 1).integers(1, 2**63, size=(tables, k), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            rows = batch.column(batch.schema.get_field_index("v")).to_pylist()
            for i, x in enumerate(rows):
                by_size.setdefault((len(x) - 1) // (4 if x[:1] == b"f" else 8), []).append(i)
            for dim, own in by_size.items():
                if dim not in lines:
                    rng = np.random.default_rng([seed, dim])
                    lines[dim] = rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)
                at, offset = lines[dim]
                runs = np.floor((_units([rows[i] for i in own]) @ at + offset) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(own), tables, k)
                cells = ((runs + np.uint64(7)) * mix).sum(axis=2, dtype=np.uint64)
                cells ^= cells >> np.uint64(29)
                cells = cells * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
                picked = batch.take(pa.array(own, pa.int64()))
                every = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * tables + 1, tables, dtype=np.int32)), pa.array(cells.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(picked.column(picked.schema.get_field_index(c)) for c in ("rep", "w", "v")), every], names=["rep", "w", "v", "cells"])

    return distinct.mapInArrow(deal, "rep binary, w bigint, v binary, cells array<bigint>")


def _links(dealt: DataFrame, cosine: float, window: float, needed: int, seed: int) -> DataFrame:
    """(rep, other, n): n vectors linked with rep that were first met here, other in its component.

    Names alone are dealt out to find the cells with company; only for these are the vectors sent.
    """
    cells = dealt.select("rep", F.posexplode("cells").alias("t", "cell"))
    sizes = cells.groupBy("t", "cell").agg(F.count("*").alias("_size"))
    shared = cells.join(sizes.where("_size > 1"), ["t", "cell"])
    parts = F.ceil(F.col("_size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    shared = shared.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    shared = shared.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")})
    shared = shared.select("t", "cell", "_a", "_b", "_own", "rep").join(dealt, "rep").withColumn("cells", F.expr("slice(cells, 1, t)"))  # those of the tables before
    shared = shared.repartition("t", "cell", "_a", "_b").sortWithinPartitions("t", "cell", "_a", "_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}

        def small_pairs(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """All pairs within cells of at most SMALL vectors."""
            i, j = [], []
            for n in np.unique(sizes).tolist():
                x, y = np.triu_indices(n, 1)
                at = first[sizes == n][:, None]
                i.append((at + x).reshape(-1))
                j.append((at + y).reshape(-1))
            return np.concatenate(i), np.concatenate(j)

        def window_pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of one cell with enough collisions, counted by a window that moves along each sorted line."""
            n = len(at)
            met = np.zeros((n, n), dtype=np.uint8)
            for m in range(COUNTED):
                order = np.argsort(at[:, m], kind="stable")
                line = at[order, m]
                high = np.searchsorted(line, line + window, side="right")
                for q in range(n):  # the upper half of each window; the lower one is another query's upper half
                    met[order[q], order[q + 1 : high[q]]] += 1
            return np.nonzero(np.triu(met + met.T >= needed, 1))

        def linked(run: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            """Links within each cell; cuts: where cells begin, and the end."""
            sizes = np.diff(cuts)
            rows, out = run.column("v").to_pylist(), []
            dims = np.array([(len(x) - 1) // (4 if x[:1] == b"f" else 8) for x in rows])
            whole, at = [None] * len(rows), np.zeros((len(rows), COUNTED))
            for dim in np.unique(dims).tolist():
                own = np.nonzero(dims == dim)[0]
                if dim not in lines:
                    lines[dim] = np.random.default_rng([seed, dim, 2]).standard_normal((dim, COUNTED))
                units = _units([rows[k] for k in own.tolist()])
                at[own] = units @ lines[dim]
                for k, u in zip(own.tolist(), units):
                    whole[k] = u
            few = (sizes > 1) & (sizes <= SMALL)
            pairs = [small_pairs(cuts[:-1][few], sizes[few])] if few.any() else []
            if pairs:
                i, j = pairs[0]
                hits = np.zeros(len(i), dtype=np.int64)
                for m in range(COUNTED):
                    hits += np.abs(at[i, m] - at[j, m]) <= window
                pairs = [(i[hits >= needed], j[hits >= needed])]
            for k in np.nonzero(sizes > SMALL)[0].tolist():
                i, j = window_pairs(at[cuts[k] : cuts[k + 1]])
                pairs.append((i + cuts[k], j + cuts[k]))
            if pairs:
                i, j = (np.concatenate([p[k] for p in pairs]).astype(np.int64) for k in (0, 1))
                t, a, b, own, w = (np.asarray(run.column(c)) for c in ("t", "_a", "_b", "_own", "w"))
                ok = (a[i] == b[i]) | (own[i] != own[j])  # of two blocks, pairs across
                i, j = i[ok], j[ok]
                cells = run.column("cells").combine_chunks()
                offsets, flat = np.asarray(cells.offsets), np.asarray(cells.values if not cells.offset else cells.flatten())
                offsets = offsets - (offsets[0] if cells.offset else 0)
                ok = np.ones(len(i), dtype=bool)
                for s in range(int(t.max())):  # met before
                    later = np.nonzero(t[i] > s)[0]
                    ok[later] &= flat[offsets[i[later]] + s] != flat[offsets[j[later]] + s]
                i, j = i[ok], j[ok]
                close = np.zeros(len(i), dtype=bool)
                for k in range(0, len(i), 8192):
                    x, y = (np.stack([whole[q] for q in z[k : k + 8192].tolist()]) for z in (i, j))
                    close[k : k + 8192] = np.einsum("ij,ij->i", x, y) >= cosine
                i, j = i[close], j[close]
                n_links = np.bincount(i, w[j], len(rows)) + np.bincount(j, w[i], len(rows))
                rep = run.column("rep").to_pylist()
                rank = np.empty(len(rep), dtype=np.int64)
                order = sorted(range(len(rep)), key=rep.__getitem__)
                rank[order] = np.arange(len(rep))
                least, before = rank.copy(), None
                while before is None or (least != before).any():  # the least name that links in the cell reach
                    before = least.copy()
                    np.minimum.at(least, i, before[j])
                    np.minimum.at(least, j, before[i])
                out = [(rep[x], rep[order[least[x]]], int(n_links[x])) for x in np.nonzero(n_links)[0].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["rep", "other", "n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            keys = np.stack([np.asarray(table.column(c), dtype=np.int64) for c in ("t", "cell", "_a", "_b")], axis=1)
            cuts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1])
            if len(cuts) > 1:
                yield linked(table.slice(0, int(cuts[-1])), cuts)
            held = table.slice(int(cuts[-1])).combine_chunks().to_batches()
        if n := sum(x.num_rows for x in held):
            yield linked(pa.Table.from_batches(held), np.array([0, n]))

    return shared.mapInArrow(count, "rep binary, other binary, n bigint")


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95, recall: float = 0.97, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``.

    A link joins two rows whose cosine is at least ``cosine``; found links are exact, and one at the
    threshold is found with a chance of ``recall``. Ids are integers. Other columns are ignored. Vectors that are null, empty, zero or
    hold null or non-finite components, and vectors of unequal length, have no link. Rows with equal vectors
    are linked with each other, also where their ids are equal. component_id is the least id reachable; rows
    with a null id are never the least and have a null component.
    """
    base = checkpointed(_folded(vectors, vec_id, embedding))
    distinct = base.where("key is not null").groupBy("key").agg(F.count("*").alias("w"), F.min("vec_id").alias("least_id"), F.first("v").alias("v"))
    distinct = checkpointed(distinct.select("key", _name("least_id", "key").alias("rep"), "w", "v"))
    k, tables, window, needed = plan(distinct.count(), cosine, recall)
    dealt = checkpointed(_dealt(distinct.select("rep", "w", "v"), k, tables, seed))
    links = checkpointed(_links(dealt, cosine, window, needed, seed).groupBy("rep", "other").agg(F.sum("n").alias("n")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    # names sort by id, so that the root of a component names its least id
    roots = connected_components(links.select(F.col("rep").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("rep"), "root")
    known = distinct.select("key", "rep", "w").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), _id_of(F.coalesce("root", "rep")).alias("component"))
    out = base.select("vec_id", "key").join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
