"""Toxicity from the nearest labelled examples.

The examples are a sample of at most SAMPLE labelled documents of the training folds, by a hash of the
id. Near copies among them count once. Examples and documents are TF-IDF vectors, with document frequencies counted over all
documents, and the nearest are found by exact cosine with a block-max inverted index: a block of examples is read only
if the sum of its terms' maxima can still reach the k-th best similarity. Distance-weighted votes are
calibrated by isotonic regression on leave-one-out votes of the examples; an example is never its own neighbour.

The space has the terms that tell of the label, for or against it, as a G-test finds them: its threshold allows for as many
tests as there are terms that could pass it (Tarone's bound). In the space of all terms the few words that make a long document
toxic drown among those that tell nothing; the README has figures. A document without any such term has no neighbour, and
scores the rate of such examples.

Everything that is broadcast is bounded by SAMPLE. Documents are read twice, once for the frequencies, and not shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.util import checkpointed, fold_of, map_arrow, with_fields

SAMPLE, NEIGHBOURS, BLOCK = 20_000, 15, 64
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class BlockMaxIndex:
    """Examples as unit vectors, in blocks of BLOCK; exact search for the most similar ones."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        # similar examples share blocks: sort by their strongest terms
        order = sorted(range(len(vectors)), key=lambda i: (sorted(vectors[i], key=lambda t: (-vectors[i][t], t)), i))
        self.order = np.array(order, dtype=np.int64)
        self.n, self.blocks = len(order), -(-len(order) // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for place, i in enumerate(order):
            for t, w in vectors[i].items():
                postings[t].append((place, w))
        self.places = [np.array([p for p, _ in x], dtype=np.int64) for x in postings]
        self.weights = [np.array([w for _, w in x]) for x in postings]
        self.heads, self.maxima = [], []
        for places, weights in zip(self.places, self.weights):
            blocks, first = np.unique(places // BLOCK, return_index=True)
            self.heads.append((blocks, np.append(first, len(places))))
            self.maxima.append(np.maximum.reduceat(weights, first) if len(first) else weights)

    def search(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[int, float]]:
        """The k most similar examples with a similarity over zero, ties by place; skip: an example left out."""
        bound = np.zeros(self.blocks)
        for t, q in query.items():
            bound[self.heads[t][0]] += q * self.maxima[t]
        candidates = np.nonzero(bound)[0]
        candidates = candidates[np.argsort(-bound[candidates], kind="stable")]
        places, sims, kth, at, step = np.empty(0, np.int64), np.empty(0), 0.0, 0, 4
        while at < len(candidates) and (len(sims) < k or bound[candidates[at]] >= kth - 1e-12):
            chosen = np.sort(candidates[at : at + step])
            at, step = at + step, step * 2
            scores = np.zeros((len(chosen), BLOCK))
            for t, q in query.items():
                blocks, first = self.heads[t]
                where = np.searchsorted(blocks, chosen)
                ok = (where < len(blocks)) & (blocks[np.minimum(where, len(blocks) - 1)] == chosen) if len(blocks) else np.zeros(len(chosen), bool)
                for row, b in zip(np.nonzero(ok)[0].tolist(), where[ok].tolist()):
                    s = slice(first[b], first[b + 1])
                    scores[row, self.places[t][s] % BLOCK] += q * self.weights[t][s]
            row, column = np.nonzero(scores)
            new = chosen[row] * BLOCK + column
            places, sims = np.concatenate([places, new]), np.concatenate([sims, scores[row, column]])
            if skip >= 0:
                ok = self.order[places] != skip
                places, sims = places[ok], sims[ok]
            best = np.lexsort((places, -np.round(sims, 12)))[:k]
            places, sims = places[best], sims[best]
            kth = sims[-1] if len(sims) >= k else 0.0
        return list(zip(self.order[places].tolist(), np.minimum(sims, 1.0).tolist()))


class NearestExamples:
    """A fitted model; ``calibrate`` completes it with the leave-one-out votes of its examples."""

    def __init__(self, terms: list[str], idf: list[float], examples: list[tuple[int, list[int], list[int], list]]):
        """examples: (label, numbers of terms, their counts, ids of the documents that it stands for)"""
        self.terms, self.idf = {t: k for k, t in enumerate(terms)}, np.array(idf)
        n = len(examples)
        self.labels = np.array([y for y, *_ in examples], dtype=float)
        self.ids = [ids for *_, ids in examples]
        self.own = {i: k for k, ids in enumerate(self.ids) for i in ids}
        self.prior = (self.labels.sum() + 0.1) / (n + 10)  # few examples say little, none that nothing is toxic
        self.vectors = [self.vector(dict(zip(ts, fs))) for _, ts, fs, _ in examples]
        blank = [y for (y, ts, *_) in examples if not ts]
        self.blank = (sum(blank) + 10 * self.prior) / (len(blank) + 10)
        self.index = BlockMaxIndex(self.vectors, len(terms))
        self.known: dict[tuple, float] = {}

    def left_out(self, k: int) -> float:
        """The vote on an example of all others."""
        return self.vote(self.index.search(self.vectors[k], NEIGHBOURS, skip=k))

    def calibrate(self, votes: dict[int, float]) -> NearestExamples:
        self.curve = self.isotonic([(x, self.labels[k]) for k, x in sorted(votes.items())])
        return self

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(c)) * self.idf[t] for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def vote(self, near: list[tuple[int, float]]) -> float:
        weights = [s**2 for _, s in near]
        return (sum(w * self.labels[i] for w, (i, _) in zip(weights, near)) + self.prior) / (sum(weights) + 1)

    @staticmethod
    def isotonic(raw: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Pooled adjacent violators, each pool's mean drawn in by one example of either label."""
        pools: list[list[float]] = []  # sum of votes, of labels, size
        for x, y in sorted(raw):
            pools.append([x, y, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                x2, y2, n2 = pools.pop()
                pools[-1] = [pools[-1][0] + x2, pools[-1][1] + y2, pools[-1][2] + n2]
        xs, ys = [0.0], [0.0]
        for x, y, n in pools:
            xs.append(x / n)
            ys.append((y + 0.5) / (n + 1))
        return np.array([*xs, 1.0]), np.maximum.accumulate(np.array([*ys, max(ys[-1], 0.5)]))

    def score(self, words: list[str], own: int = -1, evidence: bool = True) -> tuple[float, list[tuple[int, float]]]:
        """The calibrated score and, if asked for, the evidence: nearest examples with their similarity. own: an example left out."""
        get = self.terms.get
        counts = Counter(k for w in words if (k := get(w)) is not None)
        if not counts:
            return self.blank, []
        key = (own, *sorted(counts.items()))
        if not evidence and (known := self.known.get(key)) is not None:
            return known, []
        near = self.index.search(self.vector(counts), NEIGHBOURS, skip=own)
        found = float(np.interp(self.vote(near) if near else self.prior, *self.curve))
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[key] = found
        return found, near


def _terms(sample: DataFrame) -> DataFrame:
    """(id, signature, toxic, terms, counts); near copies mostly share the signature, three least shingle hashes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for k, (toxic, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                words = words_of(x.as_py())
                shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
                least = sorted(xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) for s in shingles)[:3]
                counts = Counter(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([" ".join(map(str, least))], pa.string()), pa.array([toxic], pa.int32()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int32()))],
                    names=["id", "signature", "toxic", "terms", "counts"],
                )

    kind = sample.schema["id"].dataType.simpleString()
    return map_arrow(sample.select("id", "toxic", "text"), split, f"id {kind}, signature string, toxic int, terms array<string>, counts array<int>")


def _g(df, k, n: int, pos: int):
    """G statistic of a term in df of n examples, k of them among the pos toxic ones."""
    df, k = np.asarray(df, dtype=float), np.asarray(k, dtype=float)
    total = np.zeros(len(df))
    for seen, expected in ((k, df * pos / n), (df - k, df * (n - pos) / n), (pos - k, (n - df) * pos / n), (n - pos - df + k, (n - df) * (n - pos) / n)):
        some = (seen > 0) & (expected > 0)
        total[some] += seen[some] * np.log(seen[some] / expected[some])
    return 2 * total


def _threshold(sizes: list[tuple[int, int]], n: int, pos: int) -> float:
    """The least G that allows for as many tests as terms can reach it; sizes: (df, number of terms)."""
    df, many = np.array([x for x, _ in sizes]), np.array([m for _, m in sizes])
    most = np.maximum(_g(df, np.minimum(df, pos), n, pos), _g(df, np.maximum(0, df - (n - pos)), n, pos))
    t = 2.0
    while t < 2 * math.log(max(1, many[most >= t].sum())) + 2:
        t += 0.25
    return t


def document_frequencies(docs: DataFrame, terms: list[str], text: str) -> tuple[int, dict[str, int]]:
    """The number of all documents, and of those that hold each of the terms."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, wanted = Counter(), 0, shared.value
        for batch in batches:
            n += batch.num_rows
            for x in batch.column(0):
                total.update(wanted.intersection(words_of(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([*total, None], pa.string()), pa.array([*total.values(), n], pa.int64())], names=["term", "n"])

    found = {r["term"]: r["n"] for r in map_arrow(docs.select(text), count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(None, 0), found


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 0) -> NearestExamples:
    """Learn from labelled documents whose fold is not ``held_out``; of several labels of an id the largest counts."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id") != held_out))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")  # SAMPLE rows at most
    one = _terms(sample).groupBy("signature", "toxic").agg(F.min_by("terms", "id").alias("terms"), F.min_by("counts", "id").alias("counts"), F.array_sort(F.collect_set("id")).alias("ids"))
    one = checkpointed(one)
    n, pos = one.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms: list[str] = []
    if 0 < pos < n:
        each = checkpointed(one.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("k")))
        shapes = [(r["df"], r["k"], r["m"]) for r in each.groupBy("df", "k").agg(F.count("*").alias("m")).collect()]
        sizes = Counter()
        for df, _, m in shapes:
            sizes[df] += m
        if shapes:
            least, g = _threshold(sorted(sizes.items()), n, pos), _g([x[0] for x in shapes], [x[1] for x in shapes], n, pos)
            passing = spark.createDataFrame([(df, k) for (df, k, _), x in zip(shapes, g) if x >= least], "df long, k long")
            terms = sorted(r["term"] for r in each.join(F.broadcast(passing), ["df", "k"]).select("term").collect())
    numbers = {t: k for k, t in enumerate(terms)}
    many, frequency = document_frequencies(docs, terms, text) if terms else (0, {})
    idf = [math.log((1 + many) / (1 + frequency.get(t, 0))) + 1 for t in terms]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[(numbers[t], c) for t, c in zip(ts, cs) if t in numbers] for ts, cs in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())]
            arrays = [pa.array([[y[k] for y in x] for x in own], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("toxic"), *arrays, batch.column("ids")], names=["signature", "toxic", "ts", "cs", "ids"])

    kind = one.schema["ids"].dataType.simpleString()
    examples = map_arrow(one, project, f"signature string, toxic int, ts array<int>, cs array<int>, ids {kind}").collect()  # SAMPLE at most
    examples.sort(key=lambda r: (r["signature"], r["toxic"]))
    model = NearestExamples(terms, idf, [(r["toxic"], r["ts"], r["cs"], r["ids"]) for r in examples])
    if not terms:
        return model.calibrate({})
    shared = spark.sparkContext.broadcast(model)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [k for k in batch.column(0).to_pylist() if shared.value.vectors[k]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([shared.value.left_out(k) for k in own], pa.float64())], names=["k", "vote"])

    votes = map_arrow(spark.range(0, len(examples), 1, max(1, len(examples) // 500)), leave_out, "k bigint, vote double").collect()  # SAMPLE at most
    return model.calibrate({r["k"]: r["vote"] for r in votes})


def score(docs: DataFrame, model: NearestExamples, text: str = "text", doc_id: str = "doc_id", evidence: bool = False) -> DataFrame:
    """``docs`` with score and predicted (score >= 0.5), and if asked for evidence: the nearest examples (ids, toxic, similarity).

    Columns of these names are replaced; all others stay. Null and empty texts, and those without a telling term, score the
    rate of such examples, and have no evidence. A document that is an example is scored by the others.
    """
    docs = docs.drop("score", "predicted", *(["evidence"] if evidence else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = f"struct<doc_ids:array<{docs.schema[doc_id].dataType.simpleString()}>,toxic:int,similarity:double>"
    schema = with_fields(docs, "score double, predicted int" + f", evidence array<{inner}>" * evidence)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at, ids = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(doc_id)).to_pylist()
            found = [m.score(words_of(x.as_py()), m.own.get(i, -1), evidence) for i, x in zip(ids, batch.column(at))]
            arrays, names = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32())], ["score", "predicted"]
            if evidence:
                kind = pa.list_(pa.struct([("doc_ids", pa.list_(batch.schema.field(doc_id).type)), ("toxic", pa.int32()), ("similarity", pa.float64())]))
                arrays.append(pa.array([[{"doc_ids": m.ids[k], "toxic": int(m.labels[k]), "similarity": s} for k, s in near] for _, near in found], kind))
                names.append("evidence")
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return map_arrow(docs, judge, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")
