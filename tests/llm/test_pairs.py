"""URL rules, fixity, vectors, containment and SimHash against brute force, with odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, embedding_dedup, simhash_dedup, url_filter, warc_fixity
from sheaf.llm.util import connected_components

RULES = "host string, path string, action string"


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        rest = rest[k:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_filter(spark):
    rng = random.Random(4)
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("www.a.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/", "block"), ("b.net", "/es/x", "allow"), ("om", "/", "block")]
    hosts = ["a.com", "www.a.com", "xa.com", "b.net", "c.b.net", "NET", "com", "q.org", "a.com:80", "", "a..com"]
    urls = [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/xy', '/en/é\n?q=/es/', '#/en/', '?://'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "http://www.A.com/en/1"] + ["http://a.com/en/"] * 400
    urls += ["http://" + "a." * 40_000 + "c.b.net/es/xy", "http://c.b.net/es/x" + "y" * 300_000, "http://" + "h" * 200_000]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id int, url string, verdict string").repartition(5)
    assert len({u for u in urls}) > 100
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}
    assert url_filter.url_filter(df.limit(0), spark.createDataFrame(rules, RULES)).count() == 0
    odd = df.selectExpr("page_id", "url", "'7' as _key", "'8' as key", "9 as salt", "10 as `range`", "11 as row", "page_id as `a.b`")
    judged_too = url_filter.url_filter(odd, spark.createDataFrame(rules, RULES))
    assert judged_too.columns == [*odd.columns, "host", "path", "rule", "verdict"]
    assert {tuple(r)[2:7] for r in judged_too.collect()} == {("7", "8", 9, 10, 11)} and all(r["a.b"] == r["page_id"] for r in judged_too.collect())
    many = [("a.com", f"/p{k}/", "block") for k in range(3000)] + [("com", "/", "allow")]
    paths = spark.range(6000).selectExpr("id", "concat('http://w.a.com/p', id % 4000, '/x') as url").repartition(7)
    assert {(r["id"] % 4000 < 3000, r["verdict"]) for r in url_filter.url_filter(paths, spark.createDataFrame(many, RULES)).collect()} == {(True, "block"), (False, "allow")}
    assert {r["verdict"] for r in url_filter.url_filter(df, spark.createDataFrame([], RULES)).collect()} == {"allow"}


def test_warc_fixity(spark):
    rows = [(k, f"record {k}") for k in range(700)] + [(3000, None), (3001, ""), (5, "twice"), (5, "twice")]
    other = [(k, "damaged" if k in (17, 333) else b) for k, b in rows if k != 600] + [(9000, "more")]
    a, b = (warc_fixity.leaves(spark.createDataFrame(x, "record_id long, bytes string")) for x in (rows, other))
    found = {r["record_id"]: r for r in warc_fixity.audit(a, b).collect()}
    assert len(found) == len({k for k, _ in rows}) + 1
    assert {k: r["status"] for k, r in found.items() if r["status"] != "ok"} == {17: "corrupt", 333: "corrupt", 600: "missing", 9000: "extra"}
    assert found[1]["offset"] == len("record 0") and found[1]["shard"] == 0
    assert found[5]["length"] == len("record 5") + 2 * len("twice")
    assert found[601]["status"] == "ok" and found[601]["b_digest"] == found[601]["digest"]
    assert found[5]["digest"] != found[6]["digest"] and found[5]["status"] == "ok"
    ends = [(-(1 << 63), "first"), (-1, "x"), (0, "y"), ((1 << 63) - 1, "last")]
    wide = [warc_fixity.leaves(spark.createDataFrame([(*r, 1, 2) for r in x], "record_id long, bytes string, digest int, node int")) for x in (ends, [*ends[:3], (ends[3][0], "lost")])]
    assert {r["record_id"]: r["status"] for r in warc_fixity.audit(*wide).collect()} == {ends[0][0]: "ok", -1: "ok", 0: "ok", ends[3][0]: "corrupt"}
    hot = [warc_fixity.leaves(spark.createDataFrame([(1, f"copy {k % 3}") for k in range(n)] + [(2, "z" * 300_000)], "record_id long, bytes string")) for n in (300, 301)]
    assert {r["record_id"]: r["status"] for r in warc_fixity.audit(*hot).collect()} == {1: "corrupt", 2: "ok"}
    empty = warc_fixity.leaves(spark.createDataFrame([], "record_id long, bytes string"))
    assert {r["status"] for r in warc_fixity.audit(a, empty).collect()} == {"missing"}
    assert warc_fixity.audit(empty, empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    want = components(300, pairs)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert {k for p in pairs if p[0] != p[1] for k in p} == set(got)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block, small", [(1024, 48), (16, 48), (1024, 3)])
def test_embedding_dedup(spark, monkeypatch, block, small):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24))
    v = np.concatenate([c + rng.standard_normal((n, 24)) * 0.16 for c, n in zip(centres, [80, 40] + [3] * 20 + [1] * 38)])
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)]
    n = len(rows)
    rows += [(n, rows[0][1], 2), (n + 1, rows[0][1], 2), (n + 2, None, 0), (n + 3, [0.0] * 24, 0), (n + 4, [float("nan")] * 24, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [None] * 24, 0), (n + 8, [float("inf")] * 24, 0)]
    u = np.array([r[1] if r[0] < n + 2 else [0.0] * 24 for r in rows])
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    want, root = linked.sum(1), components(len(rows), np.argwhere(linked).tolist())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, recall=0.9999).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * want.sum() <= found <= want.sum()
    assert all(got[k]["n_links"] <= want[k] for k in got)
    assert sum(got[k]["component_id"] != root[k] for k in got) <= 2
    assert got[n]["component_id"] == 0 and not got[n]["kept"] and all(got[k]["kept"] and not got[k]["n_links"] for k in range(n + 2, n + 9))
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim, n", [(64, 5000), (384, 1500)])
def test_embedding_recall(spark, dim, n):
    """Planted pairs at and above the threshold, in higher dimensions and by the parameters of op3: recall, and no false link."""
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(0, n - 1, 2):  # every second vector is turned from the one before it by a chosen cosine
        c = rng.uniform(0.93, 0.99)
        side = rng.standard_normal(dim)
        side -= side @ v[k] * v[k]
        v[k + 1] = (c * v[k] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)) * rng.uniform(0.1, 9)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df).collect()}
    assert all(got[k] <= linked[k].sum() for k in got)
    assert sum(got.values()) >= 0.96 * linked.sum() > n / 3


def test_embedding_repeats(spark):
    df = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df, recall=0.9999).collect())
    assert got == [(-1, 2, None, True), (2, 0, 2, True), (4, 2, 4, True), (4, 2, 4, True)]


def test_containment(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 6, 9, 30, 60, 180, 400, 3, 1200, 20, 250, 2])] + [(90, None), (91, ""), (92, "Alone Here")]
    docs = []
    for k in range(200):
        words = [word() for _ in range(rng.choice([0, 3, 80, 2000, 30_000 if k % 50 == 0 else 9]))]
        if k % 3 == 0:
            item = items[k // 3 % 12][1].upper().split()
            if k % 2 and len(item) > 12:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((k, " \n".join(words), "x"))
    docs += [(500, None, "x"), (501, "alone\there", "x"), (502, "not alone here", "x"), (500, None, "x")]

    def shingles(t, n=5):
        w = (t or "").lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for d, t, _ in docs:
        for i, x in items:
            n = min(5, len((x or "").split()))
            if n and (s := shingles(x, n)) and len(s & shingles(t, n)) / len(s) >= 0.8:
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id int, text string, matches string")
    found = decontaminate.contained_items(df, spark.createDataFrame(items, "item_id int, text string"))
    assert found.count() == len(docs) and found.columns == ["doc_id", "text", "matches"]
    assert {(r["doc_id"], m["item_id"]) for r in found.collect() for m in r["matches"]} == want and {(501, 92), (502, 92)} < want
    assert decontaminate.contained_items(df, spark.createDataFrame([], "item_id int, text string")).where(F.size("matches") > 0).count() == 0


def test_containment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)
    items = [(k, f"w{k} a b c d e f") for k in range(6)]
    docs = spark.createDataFrame([(1, "x w1 a b c d e f w4 a b c d e f y")], "doc_id int, text string")
    (row,) = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id int, text string"), threshold=1.0).collect()
    assert [m["item_id"] for m in row["matches"]] == [1, 4]


def test_simhash(spark):
    from xxhash import xxh64_intdigest

    rng = random.Random(5)
    base = [[rng.choice(["red", "Blue", "grün", "one", "two", "tree", "sea"]) for _ in range(rng.choice([4, 60, 300]))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base:
        w = list(w)
        w[0] = "changed"
        texts.append("\n".join(w).upper())
    texts += [None, "", " \t", "one", "two words", texts[0], texts[0]]

    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [fp(t) for t in texts]
    root = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r for r in simhash_dedup.classes(df).collect()}
    assert {k: r["fp"] & (1 << 64) - 1 for k, r in got.items()} == dict(enumerate(fps))
    assert {k: r["component_id"] for k, r in got.items()} == dict(enumerate(root))
    assert {r["doc_id"] for r in simhash_dedup.deduplicated(df).collect()} == set(root)
    odd = df.selectExpr("doc_id", "text", "fp", "7 as row", "8 as component_id", "9 as u", "1 as _lost")
    kept = simhash_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(kept.collect()) == sorted(r for r in odd.collect() if r["doc_id"] in set(root))
    assert simhash_dedup.classes(df.limit(0)).count() == 0


def test_simhash_chain(spark):
    """Links carry over steps of two bits, across both segments."""
    fps = [0b0, 0b11, 0b1111, (0b1111 | 1 << 40), (0b1111 | 1 << 40 | 1 << 63) - (1 << 64), 0b111 << 50]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash_dedup.links(df)).collect()}
    assert len(set(got.values())) == 1 and set(got) == set(fps[:5])


@pytest.mark.parametrize("bucket", [128, 3, 0])
def test_simhash_links_with_hot_segments(spark, monkeypatch, bucket):
    """Many fingerprints that share a segment, and pairs at every place: the same components as brute force."""
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    rng = random.Random(21)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            near = centre
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 3, 4])):
                near ^= 1 << b
            fps |= {near, centre} if rng.random() < 0.5 else {near}
    fps |= {(0xABCD << 32) | rng.getrandbits(12) for _ in range(300)}
    fps = sorted(fps)
    root = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    signed = [x - (x >> 63 << 64) for x in fps]
    got = {r["node"]: r["root"] for r in connected_components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    found = [got.get(x, x) for x in signed]
    want = [signed[r] for r in root]
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_sketches_miss_nothing():
    """Every way to lack a fifth of an item's shingles that an adversary would choose still leaves enough hits."""
    rng = random.Random(6)
    for n in (1, 4, 5, 8, 9, 20, 32, 33, 100, 128, 129, 250):
        words = [f"w{k}" for k in range(n + 4)]
        index = decontaminate.ItemIndex([(0, " ".join(words))])
        weights = sorted((int(w) for o in index.owners for _, w in o), reverse=True)
        assert sum(weights) == next(f for most, f in decontaminate.PARTS if n <= most) and len(index.items) == 1
        lacking = n - -(-4 * n // 5)
        assert sum(weights[lacking:]) >= index.items[0][2] > 0
    for n in (400, 1000, 5000):  # here a candidate is found by chance: a contained item, many times over
        words = [f"w{k}" for k in range(n + 4)]
        index = decontaminate.ItemIndex([(0, " ".join(words))])
        for _ in range(20):
            cut = rng.randrange(n // 5 - 4)
            assert index.search([" ".join([*words[:cut], "x", *words[cut + n // 5 - 4 :]])])[0]
