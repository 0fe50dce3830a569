"""Personal data: patterns, and information-theoretic sanitisation of what points at it.

Protected entities are the values that the patterns find, and the groups that they belong to: an e-mail's domain, an
address's network, a card's issuer, a phone number's area. What stands beside many values of one group accrues there. A term occurs
with an entity where it stands in its window (WINDOW whole words on each side, however far away). The units are distinct
texts, so copies weigh alike everywhere and prove nothing. For entity e and term t, with n_e the texts that hold the entity, n_et
those that hold t beside it, df_t the texts that hold t and D all texts:

    IC(e) = log(D / n_e)          PMI(e; t) = log(n_et * D / (n_e * (df_t + SMOOTH)))

A term discloses the share PMI / IC of what there is to know about the entity; it nears 1 if the term
occurs with the entity only. From GENERALISE on, it is replaced by its class beside the entity: [NAME] if it is written with
a capital, [ACRONYM] if with capitals only, else [WORD]. From REMOVE on it is dropped. Every pair counts, however rare the entity:
SMOOTH texts that hold the term without the entity are assumed besides those seen, so that little evidence weighs less, but is
not left out.

Windows, not texts, are shuffled. df_t covers every text, but is only asked for terms beside entities:
words pass by a bitmap of fixed size, are counted before the shuffle and joined exactly. A second
bitmap tells the texts that may have copies: the words of those are shuffled, once a task and text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.util import checkpointed, map_arrow, packed, unpacked, with_fields

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, SMOOTH, GENERALISE, REMOVE = 6, 2, 0.7, 0.9
BITMAP = 1 << 22
BROADCAST_ROWS = 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and only at the first digit of a run: the leftmost matches start there
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def entities_of(kind: int, value: str) -> list[str]:
    """The entity that a value is, and the group of entities that it belongs to."""
    if kind == 0:
        name = value.lower()
        return [f"email:{name}", f"email@{name.rpartition('@')[2]}"]
    if kind == 1:
        return [f"ip:{value}", f"ip/{value.rpartition('.')[0]}"]
    digits = "".join(_DIGITS.findall(value))
    return [f"{KINDS[kind]}:{digits}", f"{KINDS[kind]}/{digits[:6]}"]


def windows_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(entity, terms with their place) for each span and each entity that it stands for."""
    taken: list[list[int]] = []  # what spans cover, in order and disjoint
    for s, _, e in spans:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    out, words, k = [], [], 0
    for m in _WORD.finditer(text):
        x, y = m.span()
        while k < len(taken) and taken[k][1] <= x:
            k += 1
        if k == len(taken) or y <= taken[k][0]:
            words.append((x, y))
    starts = [x for x, _ in words]
    for s, kind, e in spans:
        before, after = bisect_left(starts, s), bisect_left(starts, e)
        near = [*words[max(0, before - WINDOW) : before], *words[after : after + WINDOW]]
        terms = [(text[x:y].lower(), x, y) for x, y in near]
        out += [(name, terms) for name in entities_of(kind, text[s:e])]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = "text_key binary, base array<struct<start:int,kind:int,end:int>>, windows array<struct<entity:string,terms:array<struct<term:string,start:int,end:int>>>>"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of ``docs`` but the text), text_key, base and windows; a null text is empty."""
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("")).alias("row"), F.col(text).alias("text"))
    schema = with_fields(docs.select("row"), _FOUND)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bases, windows = [], [], []
            for x in batch.column(1):
                value = x.as_py() or ""
                spans = base_spans(value)
                keys.append(md5(value.encode("utf-8", "surrogatepass")).digest())
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                windows.append([{"entity": n, "terms": [{"term": t, "start": s, "end": e} for t, s, e in ts]} for n, ts in (windows_of(value, spans) if spans else ())])
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            term = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            window = pa.struct([("entity", pa.string()), ("terms", pa.list_(term))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bases, pa.list_(span)), pa.array(windows, pa.list_(window))], names=["row", "text_key", "base", "windows"])

    return map_arrow(docs, search, schema)


def _gate(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap, packed, of the slots that the values fall in."""
    slots = values.select(F.pmod(F.xxhash64(column), F.lit(BITMAP)).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()  # BITMAP at most
    gate = np.zeros(BITMAP, dtype=bool)
    gate[slots] = True
    return np.packbits(gate)


def document_frequency(docs: DataFrame, copied: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) over all distinct texts for the given terms that occur; copied: the text_key of texts that occur again."""
    shared = docs.sparkSession.sparkContext.broadcast((_gate(terms, "term"), _gate(copied, "text_key")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        bits, again = (np.unpackbits(x).astype(bool) for x in shared.value)
        known: dict[str, bool] = {}
        total: Counter[str] = Counter()
        first = b""  # the key of a text in total: it has no copies, so no other rows have it

        out: list[tuple[bytes, list[str], list[int]]] = []

        def add(key: bytes, words: list[str], counts: list[int]) -> int:
            out.extend((key + k.to_bytes(4, "big"), words[k : k + 20_000], counts[k : k + 20_000]) for k in range(0, len(words), 20_000))
            return len(words)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "terms", "counts"])

        waiting = 0
        for batch in batches:
            for x in batch.column(0):
                value, held = x.as_py() or "", []
                for w in set(_WORD.findall(value.lower())):
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > 300_000:
                            known.clear()
                        hit = known[w] = bool(bits[xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42) % BITMAP])
                    if hit:
                        held.append(w)
                key = md5(value.encode("utf-8", "surrogatepass")).digest()
                if again[xxh64_intdigest(key, seed=42) % BITMAP]:
                    waiting += add(key, sorted(held), [1] * len(held))
                else:
                    first = first or key
                    total.update(held)
                    if len(total) > 200_000:
                        waiting += add(first, list(total), list(total.values()))
                        total.clear()
                        first = b""
                if waiting > 200_000:
                    yield flush()
                    waiting = 0
        add(first, list(total), list(total.values()))
        yield flush()

    once = map_arrow(docs.select(text), count, "key binary, terms array<string>, counts array<bigint>").dropDuplicates(["key"])
    each = once.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("df")).join(terms.select("term").distinct(), "term")


def disclosing(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, disclosed, action) of the terms that exceed a threshold."""
    windows = found.select("text_key", F.explode("windows").alias("w")).select("text_key", "w.entity", F.transform("w.terms", lambda x: x["term"]).alias("terms"))
    per_entity = windows.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    each = windows.select("entity", "text_key", F.explode("terms").alias("term")).distinct()
    schema = "entity string, term string, disclosed double, action string"
    texts = checkpointed(found.groupBy("text_key").agg(F.count("*").alias("n")))
    total = texts.count()
    ic = F.log(F.greatest(F.lit(total) / F.col("n_e"), F.lit(1.0)))
    share = lambda df: F.when(ic > 0, F.log(F.col("n_et") * F.lit(total) / (F.col("n_e") * (F.greatest(df, "n_et") + SMOOTH))) / ic).otherwise(F.lit(0.0))
    # a term is in as many texts at least as hold it beside any entity: most pairs fall short already with these
    beside = checkpointed(each.select("term", "text_key").distinct().groupBy("term").agg(F.count("*").alias("least")))
    pairs = each.groupBy("entity", "term").agg(F.count("*").alias("n_et")).join(per_entity, "entity")
    pairs = checkpointed(checkpointed(pairs).join(beside, "term").where(share(F.col("least")) >= GENERALISE).drop("least"))
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    known = pairs.join(document_frequency(docs, texts.where("n > 1"), pairs, text), "term")
    known = known.withColumn("disclosed", share(F.col("df"))).where(F.col("disclosed") >= GENERALISE)
    return checkpointed(known.select("entity", "term", "disclosed", F.when(F.col("disclosed") >= REMOVE, "remove").otherwise("generalise").alias("action")))


def term_spans(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """(text_key, term_spans) for texts that hold a flagged term beside its entity."""
    near = found.where(F.size("windows") > 0).select("text_key", F.explode("windows").alias("w")).select("text_key", "w.entity", F.explode("w.terms").alias("t"))
    near = near.select("text_key", "entity", "t.term", "t.start", "t.end").distinct().join(flagged, ["entity", "term"])
    spans = near.groupBy("text_key", "start", "end").agg(F.max("action").alias("action"))  # of two actions, to remove
    return spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("term_spans"))


def _joined(left: DataFrame, spans: DataFrame) -> DataFrame:
    """Broadcast where the spans are few, as counted; else a join that Spark can split where a text is hot."""
    spans = checkpointed(spans)
    few = spans.agg(F.coalesce(F.sum(F.size("term_spans")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    return left.join(F.broadcast(spans) if few else spans, "text_key", "left")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for the text, with base and term_spans; columns of these names are replaced, all others stay."""
    rest = [c for c in docs.columns if c not in (text, "base", "term_spans")]
    found = checkpointed(find(docs.select(*(F.col(f"`{c}`") for c in [*rest, text])), text))
    flagged = disclosing(docs, found, text)
    # a text without windows has no term spans, and need not meet them
    near, plain = found.where(F.size("windows") > 0).drop("windows"), found.where(F.size("windows") == 0).drop("windows")
    near = _joined(near, term_spans(found, flagged))
    plain = plain.withColumn("term_spans", F.lit(None).cast(near.schema["term_spans"].dataType))
    return unpacked(near.unionByName(plain), "row", rest, "base", "term_spans")


def class_of(term: str) -> str:
    """What a generalised term becomes."""
    return "[WORD]" if not term[0].isupper() else "[ACRONYM]" if term.isupper() else "[NAME]"


def redacted(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kind or class; overlapping ones become one, named by the first."""
    marks = sorted([(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base] + [(s, e, "" if a == "remove" else class_of(text[s:e])) for s, e, a in terms])
    out, at, k = [], 0, 0
    while k < len(marks):
        s, e, label = marks[k]
        k += 1
        while k < len(marks) and marks[k][0] < e:
            e = max(e, marks[k][1])
            k += 1
        out += [text[at:s], label]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data and the terms that disclose it replaced; all columns and rows stay.

    A null text stays null. ``n_chars``, if it is a column, is counted anew where the text changed.
    """
    found = checkpointed(find(docs.select(text), text))
    spans = term_spans(found, disclosing(docs, found, text))
    keyed = packed(docs, "row", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("text_key"))
    keyed = _joined(keyed, spans).select("row", "term_spans")
    out = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            at, new, sizes = out.index(text), [], []
            had = columns[out.index(n_chars)].to_pylist() if n_chars in out else [None] * batch.num_rows
            for x, spans, n in zip(columns[at], batch.column(1), had):
                value, terms = x.as_py(), [(s["start"], s["end"], s["action"]) for s in spans.as_py() or ()]
                base = base_spans(value) if value else []
                changed = redacted(value, base, terms) if base or terms else value
                new.append(changed)
                sizes.append(len(changed) if changed != value else n)
            columns[at] = pa.array(new, columns[at].type)
            if n_chars in out:
                columns[out.index(n_chars)] = pa.array(sizes, columns[out.index(n_chars)].type)
            yield pa.RecordBatch.from_arrays(columns, names=out)

    return map_arrow(keyed, replace, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of all spans; an empty text has none, and repeated rows stay."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes, strings = [[], [], [], []], [], []
            for base, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [(x["start"], x["kind"], x["end"]) for x in base]
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in base))
                hashes.append(sha256(joined(base).encode()).hexdigest())
                strings.append(joined(sorted([*base, *((x["start"], 4, x["end"]) for x in terms or ())])))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(hashes, pa.string()), pa.array(strings, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_arrow(found.select("doc_id", "base", "term_spans"), digest, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
