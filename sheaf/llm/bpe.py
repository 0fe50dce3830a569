"""Byte-level BPE with forced-boundary splitting.

A merge only ever makes a token of the vocabulary, so two bytes that are adjacent in a text but inside
no token can never end up in one token: between them the text can be cut, and the fragments encoded
independently and concatenated. Pre-tokens (the tokenizer's own pattern) are cut at such pairs;
codes of the words and fragments met last are kept by each worker in tables of bounded size.

The vocabulary file's path is a parameter; the file is read on the driver and broadcast (its size is
the tokenizer's, not the data's). Documents are read once, not shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.llm.util import kept, map_arrow, with_fields

#: Codes of words, and of fragments, that are kept: half of them at least are the last ones asked for.
WORDS, FRAGMENTS, LONGEST = 450_000, 50_000, 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Recent(dict):
    """What ``make`` gives for a key, kept for at most ``most`` keys, and not for long ones.

    When half of them are in, they become the old ones; of these, those that are asked for again come back, the others go
    with the next half.
    """

    def __init__(self, make: Callable, most: int):
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.half:
                self.old = None  # before the copy is made
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class BoundaryBPE:
    """Encode as the vocabulary's merges say; special tokens in a text are single tokens."""

    def __init__(self, spec: dict):
        import regex

        letters = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in specials:
            vocab.pop(t.encode(), None)
        self.vocab = vocab
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[raw(a), raw(b)] = k
        self.inside = {t[k : k + 2] for t in vocab for k in range(len(t) - 1)}
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        # the pre-tokeniser's pattern; white space is that of Unicode's property
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.pieces = {str(i): t for t, i in vocab.items()} | {str(i): t.encode() for t, i in specials.items()}
        self.codes, self.fragments = Recent(self.code, WORDS), Recent(self.merge, FRAGMENTS)

    def cut(self, word: bytes) -> list[bytes]:
        """Fragments between forced boundaries."""
        inside, out, first = self.inside, [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                out.append(word[first:k])
                first = k
        out.append(word[first:])
        return out

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Of adjacent tokens, merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [fragment[k : k + 1] for k in range(len(fragment))]
        if len(parts) > 64:
            return self.merge_long(parts)
        ranks, none = self.ranks, 1 << 60
        order = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while order:
            least = min(order)
            if least == none:
                break
            k = order.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del order[k]
            if k < len(order):
                order[k] = ranks.get((parts[k], parts[k + 1]), none)
            if k:
                order[k - 1] = ranks.get((parts[k - 1], parts[k]), none)
        return tuple(map(self.vocab.__getitem__, parts))

    def merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same with a heap and links between neighbours, for very long fragments."""
        from heapq import heapify, heappop, heappush

        n, ranks = len(parts), self.ranks
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapify(heap)
        while heap:
            _, k, a, b = heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or parts[k] != a or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = a + b, False, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(self.vocab[p] for p, ok in zip(parts, alive) if ok)

    def code(self, word: str) -> str:
        """Decimal ids of a pre-token, joined by commas."""
        ids: list[int] = []
        fragments = self.cut(word.encode("utf-8", "surrogatepass"))
        for f in fragments:
            ids += self.fragments[f] if len(fragments) > 1 else self.merge(f)  # a whole word's code is kept as it is
        return ",".join(map(str, ids))

    def encode(self, text: str | None) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        code, out = self.codes.__getitem__, []
        parts = self.special.split(text) if self.special and any(s in text for s in self.specials) else (text,)
        for part in parts:
            if part in self.specials:
                out.append(str(self.specials[part]))
                continue
            out += map(code, self.pattern.findall(part))
        return ",".join(out)

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by commas; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens and, as asked for, ids (array<int>), ids_sha256 and decoded_sha256.

    Null and empty texts have no token. Columns of these names are replaced; rows stay.
    """
    names = ["n_tokens", *(["ids"] if ids else []), *(["ids_sha256", "decoded_sha256"] if digests else [])]
    docs = docs.drop(*names)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(spec), ("vocabulary", sha256(spec.encode()).hexdigest())
    schema = with_fields(docs, "n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(key, lambda: BoundaryBPE(json.loads(shared.value)))  # with what it has learnt of the texts
        for batch in batches:
            counts, lists, hashes, decoded = [], [], [], []
            for x in batch.column(batch.schema.get_field_index(text)):
                code = bpe.encode(x.as_py())
                counts.append(code.count(",") + 1 if code else 0)
                if ids:
                    lists.append(pa.array(list(map(int, code.split(","))) if code else [], pa.int32()))
                if digests:
                    hashes.append(sha256(code.encode()).hexdigest())
                    decoded.append(sha256(bpe.decode(code).encode("utf-8", "surrogatepass")).hexdigest())
            new = [pa.array(counts, pa.int64())]
            if ids:
                offsets = [0]
                for a in lists:
                    offsets.append(offsets[-1] + len(a))
                new.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
            if digests:
                new += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return map_arrow(docs, run, schema, keeps=key)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encoded(docs, default_vocabulary(), ids=False, digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
