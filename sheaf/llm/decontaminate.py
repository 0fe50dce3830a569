"""Benchmark items inside long documents: containment search with MinHash, items parted by size.

The minimum of an item's shingles under a hash function is a shingle of a document with exactly the
probability of the item's containment in it, however long the document is, so the short side is
sketched and the long side is only asked for membership. Items are parted by their number of
shingles; each part has its own number of hash functions. A document is a candidate for an item if so many of the
item's minima are among its shingles:

* An item of n shingles that is contained at the threshold lacks at most (1 - threshold) * n of them. At worst these are the
  minima of most functions; the others must hit. Where that leaves at least one, no contained item is ever missed.
* For longer items that bound is void. The number of hits is then the greatest that a contained item misses with a
  chance under 1e-9.

A candidate is verified by its exact containment, on the shingles themselves.

Documents are read once for each block of items and never shuffled. A block holds a bounded number of
item characters and is broadcast; a larger benchmark is searched in several blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.util import kept, map_arrow, slices, with_fields

WORDS, THRESHOLD, BLOCK_CHARS = 5, 0.8, 16 << 20
#: Size parts: items of up to so many shingles, and the hash functions that sketch them.
PARTS = ((8, 24), (32, 48), (128, 96), (math.inf, 128))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes]) -> set[bytes]:
    """Shingles of five words; fewer words make one shingle, none make none."""
    if len(words) < WORDS:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(WORDS)))))


def rolling(word_hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each five successive words."""
    n = len(word_hashes) - WORDS + 1
    h = word_hashes[:n].copy()
    for k in range(1, WORDS):
        h *= _M1
        h ^= h >> np.uint64(31)
        h += word_hashes[k : k + n]
    h *= _M2
    return h ^ (h >> np.uint64(29))


def missed(size: int, functions: int, hits: int, threshold: float) -> float:
    """Chance that fewer than ``hits`` of the minima are contained."""
    return sum(math.comb(functions, k) * threshold**k * (1 - threshold) ** (functions - k) for k in range(hits))


def needed_hits(weights: np.ndarray, size: int, functions: int, threshold: float) -> int:
    """Functions whose minima must be in a document that may contain an item of ``size`` shingles.

    weights: how many functions each distinct minimum is the minimum of.
    """
    lacking = size - math.ceil(threshold * size - 1e-9)
    sure = functions - int(np.sort(weights)[::-1][:lacking].sum())
    return sure if sure > 0 else max([h for h in range(1, functions) if missed(size, functions, h, threshold) < 1e-9], default=1)


class ItemIndex:
    """Sketches of a block of items, and the items' shingles for the exact check."""

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items, self.short = [], {}
        mults = np.random.default_rng(11).integers(1, 2**63, max(f for _, f in PARTS), dtype=np.uint64) | np.uint64(1)
        sketch: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            if len(words) < WORDS:
                self.short.setdefault(len(words), {}).setdefault(b" ".join(words), []).append(item_id)
                continue
            hashes = np.unique(rolling(hashed(words)))
            functions = next(f for most, f in PARTS if len(hashes) <= most)
            minima = np.empty(functions, dtype=np.uint64)
            for k in range(functions):
                mixed = hashes * mults[k]
                mixed ^= mixed >> np.uint64(32)
                minima[k] = hashes[(mixed * mults[k]).argmin()]
            kept, weights = np.unique(minima, return_counts=True)
            at = len(self.items)
            self.items.append((item_id, shingles_of(words), needed_hits(weights, len(hashes), functions, threshold)))
            for h, w in zip(kept.tolist(), weights.tolist()):
                sketch.setdefault(h, []).append((at, w))
        self.keys = np.array(sorted(sketch), dtype=np.uint64)
        self.owners = [np.array(sketch[h], dtype=np.int64) for h in self.keys.tolist()]
        self.bits = max(16, min(24, len(self.keys).bit_length() + 6))
        self.gate = np.zeros(1 << self.bits, dtype=bool)
        self.gate[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items with enough sketch hits among the (hot) hashes of one document."""
        met = np.unique(hashes)
        at = np.searchsorted(self.keys, met)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == met)]
        if not len(at):
            return []
        pairs = np.concatenate([self.owners[k] for k in at.tolist()])
        owners, place = np.unique(pairs[:, 0], return_inverse=True)
        hits = np.bincount(place, pairs[:, 1])
        return [o for o, c in zip(owners.tolist(), hits.tolist()) if c >= self.items[o][2]]

    def search(self, texts: list[str | None]) -> list[list[tuple[object, float]]]:
        """(item, containment) for each text of a slice."""
        found: list[list[tuple[object, float]]] = [[] for _ in texts]
        words = [words_of(x) for x in texts]
        sizes = np.array([len(w) for w in words])
        if len(self.keys) and (flat := [w for ws in words for w in ws]) and len(flat) >= WORDS:
            starts = np.concatenate([[0], np.cumsum(sizes)])
            h = rolling(hashed(flat))
            hot = np.nonzero(self.gate[(h >> np.uint64(64 - self.bits)).astype(np.int64)])[0]
            owner = np.searchsorted(starts, hot, side="right") - 1
            inside = hot + WORDS <= starts[owner + 1]  # no shingle spans two documents
            hot, owner = hot[inside], owner[inside]
            at = np.searchsorted(self.keys, h[hot])
            real = self.keys[np.minimum(at, len(self.keys) - 1)] == h[hot]
            hot, owner = hot[real], owner[real]
            for d in np.unique(owner).tolist():
                if items := self.candidates(h[hot[owner == d]]):
                    own = shingles_of(words[d])
                    for k in items:
                        item_id, exact, _ = self.items[k]
                        c = len(exact & own) / len(exact)
                        if c >= self.threshold:
                            found[d].append((item_id, c))
        for n, known in self.short.items():
            for d, ws in enumerate(words):
                for x in known.keys() & set(map(b" ".join, zip(*(ws[k:] for k in range(n))))):
                    found[d] += [(i, 1.0) for i in known[x]]
        return found


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def blocks_of(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size."""
    block, held = [], 0
    rows = benchmark.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).distinct()
    for i, x in rows.toLocalIterator():
        if block and held + len(x) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((i, x))
        held += len(x)
    if block:
        yield block


def contained_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` but for clashing ones, and matches: array of (item_id, containment), maybe empty.

    Containment is the share of the item's distinct five-word shingles that the document holds. An item of
    fewer than five words has its whole word sequence as its only shingle; any document that holds these words
    in a row contains it. Null or empty texts and null item ids match
    nothing; repeated items of different ids all match, repeated rows stay, equal items are one.
    """
    spark = docs.sparkSession
    docs = docs.drop("matches")
    item_type = benchmark.schema[item_id].dataType
    inner = f"struct<item_id:{item_type.simpleString()},containment:double>"
    schema = with_fields(docs, f"matches array<{inner}>")
    found = docs.withColumn("matches", F.expr(f"cast(array() as array<{inner}>)"))
    for block in blocks_of(benchmark, item_id, item_text):
        shared, key = spark.sparkContext.broadcast(block), ("items", uuid.uuid4().hex)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            index = kept(key, lambda: ItemIndex(shared.value, threshold))
            for batch in batches:
                texts, matches = batch.column(batch.schema.get_field_index(text)).to_pylist(), []
                for x, y in slices(texts):
                    matches += index.search(texts[x:y])
                at = batch.schema.get_field_index("matches")
                kind = batch.schema.field(at).type
                had = batch.column(at).to_pylist()
                both = [sorted([*h, *({"item_id": i, "containment": c} for i, c in m)], key=lambda z: z["item_id"]) for h, m in zip(had, matches)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(both, kind))

        found = map_arrow(found, search, schema, keeps=key)
    return found


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, containment) of every benchmark item that a document contains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.round("m.containment", 6).alias("containment"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(len(ws), 5) AS n, unnest(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM b
), ds AS (
  SELECT DISTINCT doc_id, z.n, unnest(list_transform(range(1, len(ws) - z.n + 2), lambda i: array_to_string(ws[i:i + z.n - 1], ' '))) AS s FROM w, (SELECT DISTINCT n FROM bs) z WHERE len(ws) >= z.n
), n AS (SELECT item_id, count(*) AS k FROM bs GROUP BY item_id)
SELECT doc_id, item_id, round(count(*)::DOUBLE / max(k), 6) AS containment
FROM ds JOIN bs USING (n, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*)::DOUBLE / max(k) >= 0.8
"""
