"""Personal data, toxicity, language model, HTML and BPE: brute force, held-out accuracy and round trips."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.llm import bpe, html_main_text, lm_score, pii, toxicity
from sheaf.llm.util import fold_of


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(8)
    parts = ["a@b.c", "x.y@", "@", "@@", "a", "é", " ", "-", ".", "+", "(", ")", "1.2.3.4", "300.1.1.1", "12", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 123-4567", "+1", "0", "７", "b-c.d", "%", "\n", "1.2.3.4.5.6.7.8", "0000.1.2.003"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_base_spans_of_long_texts():
    assert pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@" + "." * 1000 + "+" * 50_000) == []
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_pii_terms(spark):
    rows = [(k, f"note {k} the zorblax account of mail a@b.org belongs {k} to someone {'x' * (k + 3)}") for k in range(6)]
    rows += [(50 + k, f"the account of nobody belongs to the sea and note {k} mail someone") for k in range(200)] + [(400, None), (401, ""), (400, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id int, text string, n_chars long")
    found = {r["doc_id"]: r for r in pii.detect(df).collect()}
    words = {rows[k][1][s["start"] : s["end"]] for k in range(6) for s in found[k]["term_spans"] or ()}
    assert words == {"zorblax"}
    assert not any(found[k]["term_spans"] or found[k]["base"] for k in found if k >= 50)
    odd = df.selectExpr("doc_id", "text", "n_chars", "7 as text_key", "8 as term_spans", "9 as row", "10 as base", "11 as `a.b`")
    assert {tuple(r)[3:] for r in pii.sanitise(odd).collect()} == {(7, 8, 9, 10, 11)} and pii.sanitise(odd).columns == odd.columns
    kept = pii.detect(odd)
    assert kept.columns == ["doc_id", "n_chars", "text_key", "row", "a.b", "base", "term_spans"]
    assert {(r["text_key"], r["row"], r["a.b"]) for r in kept.collect()} == {(7, 9, 11)}
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[0]["text"] == "note 0 the  account of mail [EMAIL] belongs 0 to someone xxx" and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[50]["text"] == rows[6][1] and clean[50]["n_chars"] == 7 and clean[400]["text"] is None
    assert pii.sanitise(df).columns == df.columns and pii.sanitise(df).count() == len(rows)
    assert pii.sanitise(df.limit(0)).count() == 0


def brute_terms(docs):
    """Spans of terms for each text, straight from the definition."""
    texts = sorted({t or "" for _, t in docs})
    word = re.compile(r"[^\W\d_]{3,}")
    df, beside, holders, near = Counter(), {}, {}, {}
    for t in texts:
        df.update({w.lower() for w in word.findall(t)} | {w for w in word.findall(t.lower())})
        spans = brute_spans(t)
        words = [(m.start(), m.end()) for m in word.finditer(t) if not any(s < m.end() and m.start() < e for s, _, e in spans)]
        for s, kind, e in spans:
            v = t[s:e]
            d = re.sub("[^0-9]", "", v)
            names = [("email", v.lower()), ("domain", v.lower().split("@")[1])] if kind == 0 else [("ip", v), ("network", v[: v.rindex(".")])] if kind == 1 else [(kind, d), (kind, "group", d[:6])]
            around = [w for w in words if w[1] <= s][-6:] + [w for w in words if w[0] >= e][:6]
            for name in names:
                holders.setdefault(name, set()).add(t)
                for x, y in around:
                    beside.setdefault((name, t[x:y].lower()), set()).add(t)
                    near.setdefault(t, set()).add((name, x, y))
    found = {}
    for t, ws in near.items():
        for name, x, y in ws:
            n_e, n_et = len(holders[name]), len(beside[name, t[x:y].lower()])
            ic = math.log(len(texts) / n_e)
            if ic > 0 and (share := math.log(n_et * len(texts) / (n_e * (max(df[t[x:y].lower()], n_et) + 2))) / ic) >= 0.7:
                found.setdefault(t, {}).setdefault((x, y), set()).add("remove" if share >= 0.9 else "generalise")
    return {t: sorted((x, y, max(a)) for (x, y), a in s.items()) for t, s in found.items()}


@pytest.mark.parametrize("few", [50_000, 0])
def test_term_spans_of_the_table(spark, monkeypatch, few):
    """Whole table against the definition, by either join."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", few)
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in frame.collect()]
    want = brute_terms(docs)
    got = {r["doc_id"]: [tuple(s) for s in r["term_spans"] or ()] for r in pii.detect(frame).collect()}
    assert got == {k: want.get(t or "", []) for k, t in docs} and sum(map(len, got.values())) > 20


def test_windows_of_whole_words():
    text = "supercalifragilistic" + " " * 400 + "a@b.org" + " 1" * 300 + " Zebulon and one more here of them all"
    assert {t for _, ts in pii.windows_of(text, pii.base_spans(text)) for t, *_ in ts} == {"supercalifragilistic", "zebulon", "and", "one", "more", "here", "them"}
    long = "word " * 200_000 + "1.2.3.4 " * 2000
    assert len(pii.windows_of(long, pii.base_spans(long))) == 4000
    assert [pii.class_of(x) for x in ("bank", "Bank", "BANK")] == ["[WORD]", "[NAME]", "[ACRONYM]"]


def test_copies_prove_nothing(spark):
    df = spark.createDataFrame([(k, "the zorblax mail a@b.org here") for k in range(50)], "doc_id int, text string")
    assert all(r["term_spans"] is None for r in pii.detect(df).collect())


def test_terms_of_an_entity_seen_once(spark):
    rows = [(0, "please ask zebulon about k@b.org for the key")] + [(k, f"please ask {k} about the key for nobody") for k in range(1, 401)]
    found = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {rows[0][1][s["start"] : s["end"]] for s in found[0]["term_spans"] or ()} == {"zebulon"}
    assert not any(found[k]["term_spans"] for k in range(1, 401))


def test_copies_hide_nothing(spark):
    rows = [(k, f"please write {'abc'[k] * 5} to zorblax mail a@b.org {'abc'[k] * 4} here") for k in range(3)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000 + k, f"please write {k} mail here aaaaa bbbbb ccccc aaaa bbbb cccc") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = pii.find(df)
    frequency = pii.document_frequency(df, found.groupBy("text_key").count().where("count > 1"), spark.createDataFrame([("zorblax",), ("mail",)], "term string"))
    assert {r["term"]: r["df"] for r in frequency.collect()} == {"zorblax": 3, "mail": 403}
    spans = {r["doc_id"]: r["term_spans"] for r in pii.detect(df).collect()}
    assert {rows[k][1][s["start"] : s["end"]] for k in range(3) for s in spans[k] or ()} == {"zorblax"} and spans[1299] == spans[0]


def vectors(rng, n, terms):
    out = []
    for _ in range(n):
        v = {t: rng.random() for t in rng.sample(range(terms), rng.randrange(1, 6))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def test_block_max_index_is_exact():
    rng = random.Random(9)
    v = vectors(rng, 900, 40)
    index = toxicity.BlockMaxIndex(v, 40)
    for q in vectors(rng, 40, 40):
        want = sorted((round(sum(w * x.get(t, 0) for t, w in q.items()), 9) for x in v), reverse=True)[:15]
        got = [round(s, 9) for _, s in index.search(q, 15)]
        assert got == [x for x in want if x > 0]


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    filler = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(400)]
    bad = ["blarg", "snork", "fleeb", "gromp"]
    docs, labels = [], []
    for k in range(900):
        words = [rng.choice(filler) for _ in range(40)]
        toxic = k % 6 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                words[rng.randrange(40)] = w.upper()
        docs.append((k, " ".join(words), 3.0))
        labels.append((k, int(toxic)))
    docs += [(2000, None, 0.0), (2001, "", 0.0), (2001, "", 0.0), (None, "blarg snork", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (3, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [(dict(labels)[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    odd = toxicity.score(df.selectExpr("doc_id", "text", "score", "'x' as label", "1 as id", "2 as toxic", "3 as terms"), model, evidence=True)
    assert odd.columns == ["doc_id", "text", "label", "id", "toxic", "terms", "score", "predicted", "evidence"]
    near = {r["doc_id"]: r["evidence"] for r in odd.collect()}
    assert not any(k in e["doc_ids"] for k, es in near.items() for e in es) and all(es == sorted(es, key=lambda e: -round(e["similarity"], 9)) for es in near.values())
    nothing = toxicity.fit(df, known.limit(0))
    assert {r["predicted"] for r in toxicity.score(df, nothing).collect()} <= {0, 1}


def brute_toxicity(docs, labels, neighbours=15):
    """Scores by dense arithmetic: the telling terms, vectors, left-out votes and their calibration written out again."""
    import numpy as np

    words = {k: Counter(re.findall(r"\w+", (t or "").lower())) for k, t in docs}
    train = sorted(k for k in labels if k in words and zlib.crc32(str(k).encode()) % 5)
    y = np.array([labels[k] for k in train], dtype=float)
    n, pos = len(y), int(y.sum())
    df = Counter(t for k in train for t in words[k])
    hits = Counter(t for k in train if labels[k] for t in words[k])

    def g(d, k):
        cells = [(k, d * pos / n), (d - k, d * (n - pos) / n), (pos - k, (n - d) * pos / n), (n - pos - d + k, (n - d) * (n - pos) / n)]
        return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)

    reach = sorted(max(g(d, min(d, pos)), g(d, max(0, d - (n - pos)))) for d in df.values())
    least = 2.0
    while least < 2 * math.log(max(1, sum(r >= least for r in reach))) + 2:
        least += 0.25
    terms = sorted(t for t in df if g(df[t], hits[t]) >= least)
    everywhere = Counter(t for c in words.values() for t in c)
    idf = np.array([math.log((1 + len(docs)) / (1 + everywhere[t])) + 1 for t in terms])

    def vector(c):
        v = np.array([(1 + math.log(c[t])) if c[t] else 0.0 for t in terms]) * idf
        return v / (np.linalg.norm(v) or 1)

    v = np.array([vector(words[k]) for k in train])
    prior = (pos + 0.1) / (n + 10)

    def vote(sims):
        best = np.sort(np.where(sims > 1e-12, sims, 0))[::-1]
        kth = best[neighbours - 1]
        top = np.nonzero((sims > 1e-12) & (np.round(sims, 12) > round(kth, 12)))[0].tolist()
        ties = [k for k in np.nonzero((sims > 1e-12) & (np.round(sims, 12) == round(kth, 12)))[0].tolist()]
        if len({y[k] for k in ties}) > 1 and len(top) + len(ties) > neighbours:
            return None  # which of the ties are taken is up to the index
        top += ties[: neighbours - len(top)]
        w = sims[top] ** 2
        return float(((w * y[top]).sum() + prior) / (w.sum() + 1))

    return terms, {k: vector(c) for k, c in words.items()}, v, vote, train


def test_toxicity_against_brute_force(spark):
    """On the whole small table: terms, nearest examples and votes."""
    import numpy as np

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    frame, label = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(frame, label)
    kept = {i for ids in model.ids for i in ids[:1]}  # near copies count once
    labels = {r["doc_id"]: int(r["toxic"] > 0) for r in label.where("toxic is not null").collect() if r["doc_id"] in kept}
    terms, vectors, v, vote, train = brute_toxicity(docs, labels)
    assert sorted(model.terms) == terms and len(terms) > 5
    got, checked = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}, 0
    for k, t in docs:
        own = model.own.get(k, -1)
        sims = v @ vectors[k]
        if own >= 0:
            sims[train.index(model.ids[own][0])] = 0
        x = vote(sims)
        if not vectors[k].any():
            assert got[k]["score"] == model.blank
        elif x is not None:
            assert got[k]["score"] == pytest.approx(float(np.interp(x, *model.curve)), abs=1e-9)
            checked += 1
    assert checked > 20


def test_isotonic_is_the_best_monotone_fit():
    rng = random.Random(16)
    raw = [(x := rng.random(), float(rng.random() < x)) for _ in range(200)]
    xs, ys = toxicity.NearestExamples.isotonic(raw)
    assert all(a <= b for a, b in zip(ys, ys[1:])) and 0 <= ys[0] and ys[-1] <= 1 and xs[0] == 0 and xs[-1] == 1
    best = []  # max-min formula of isotonic regression
    y = [b for _, b in sorted(raw)]
    for k in range(len(y)):
        best.append(max(min(sum(y[a : b + 1]) / (b + 1 - a) for b in range(k, len(y))) for a in range(k + 1)))
    assert len(set(round(b, 9) for b in best)) == len(xs) - 2


def test_unigram_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 20)
    rng = random.Random(11)
    words = [f"W{k}é" if k % 3 else f"w{k}" for k in range(80)]
    docs = [(k, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([0, 1, 30, 200]))) + rng.choice(["", " "])) for k in range(150)]
    docs += [(900, None), (901, ""), (901, ""), (902, " \t "), (None, "w0 w3 unseen")]
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    c = Counter()
    for k, t in docs:
        if fold(k) != 1:
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").selectExpr("*", "1 as rare", "2 as _row", "3 as id", "4 as row", "5 as c", "6 as `a.b`", "7 as taught")
    got = lm_score.scored(df, fold_of("doc_id") != 1)
    assert got.columns == ["doc_id", "rare", "_row", "id", "row", "c", "a.b", "taught", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    got = got.collect()
    assert {tuple(r)[1:8] for r in got} == {(1, 2, 3, 4, 5, 6, 7)}
    assert len(got) == len(docs)
    texts = {}
    for k, t in docs:
        texts[k] = t
    for r in got:
        w = [*(texts[r["doc_id"]] or "").encode().lower().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-9)
        assert r["score"] < 0
    assert lm_score.scored(df.limit(0), fold_of("doc_id") != 1).count() == 0


def test_model_prefers_its_language(spark):
    rng = random.Random(12)
    syllables = ["ther", "on", "ing", "re", "st", "ou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice([1, 2, 3])))
    docs = [(k, " ".join(word() for _ in range(60))) for k in range(300)]
    odd = [(1000 + k, "".join(rng.choice("qzxvjkw ") for _ in range(300))) for k in range(5)]
    df = spark.createDataFrame([*docs, *odd], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.scored(df, fold_of("doc_id") != 1).collect()}
    bits = {k: -got[k]["score"] / math.log10(2) / len(t) for k, t in [*docs, *odd]}
    held = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 == 1]
    own = sum(bits[k] for k in held) / len(held)
    assert own < 2.0
    # eight symbols at random hold nearly three bits each, which no model can code in less
    assert min(bits[k] for k, _ in odd if zlib.crc32(str(k).encode()) % 5 == 1) > max(2.9, own + 1)


def small_model(units):
    import numpy as np

    tree = lm_score.Tree(np.bincount(np.frombuffer(b"".join(units), np.uint8), minlength=257))
    tables, firsts, mixer = np.zeros((2, lm_score.SLOTS), np.float32), np.zeros((lm_score.FIRSTS, 256)), lm_score.Mixer(lm_score.GATES, lm_score.MODELS)
    lm_score.count_tables(units, np.ones(len(units)), tree, tables)
    u = lm_score.Units.of([b" ".join(x for x in units if x.strip())])
    np.add.at(firsts, (u.contexts(), u.data[u.starts]), 1)
    return lm_score.Model(tables, tree, mixer, lm_score.Firsts(firsts).log10)


def test_model_is_a_distribution():
    """First bytes in any context, and what may follow one, add up to one or less."""
    import numpy as np

    m = small_model([b"abc", b"abd", b"b", b" ", b"\n"])
    assert np.allclose((10.0 ** m.firsts.astype(float)).sum(axis=1), 1, atol=1e-4)
    for head in (b"a", b"ab", b" ", b"q"):
        ends = 10 ** m.rest([head])[0]
        more = sum(10 ** (m.rest([head + bytes([b])])[0] - 0) for b in range(1, 256))
        assert 0 < ends + more <= 1.0001
    assert sorted(m.tree.depth.tolist())[0] < 8 and sum(2.0 ** -int(d) for d in m.tree.depth) == 1


def test_steps_once_each():
    """Scores by distinct steps are those of each unit on its own; long units are the sum of their parts."""
    import numpy as np

    rng = random.Random(19)
    units = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + [b"x" * n for n in (1, 1023, 1024, 1025, 2048, 5000)] + [" \n".encode(), b"  "]
    m = small_model(units)
    assert np.allclose(m.rest(units), [m.rest([u])[0] for u in units], atol=1e-4)
    big = bytes(rng.choice(b"ab") for _ in range(3000))
    whole = m.rest([big])[0]
    lm_score.AT_ONCE, kept = 1024, lm_score.AT_ONCE
    try:
        assert m.rest([big])[0] == pytest.approx(whole, abs=1e-3)
    finally:
        lm_score.AT_ONCE = kept


def test_a_unit_of_ten_megabytes(tmp_path):
    """Bounded memory: a process of its own scores base64 without a space."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from sheaf.llm import lm_score as L
rng = np.random.default_rng(1)
text = bytes(rng.choice(np.frombuffer(b"ABCDEFGHIJKLMNOPabcdefghijklmnop0123", np.uint8), 10_000_000))
tree = L.Tree(np.bincount(np.frombuffer(text[:10000], np.uint8), minlength=257))
m = L.Model(np.zeros((2, L.SLOTS), np.float32), tree, L.Mixer(L.GATES, L.MODELS), L.Firsts(np.zeros((L.FIRSTS, 256))).log10)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = L._measured(L.Units.of([text]), L.Words(m, 1.0, pa.array([b"x", b"yy"], pa.large_binary()), np.ones(2), np.zeros(2)), 1, -0.1)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, out[0].to_pylist(), out[5].to_pylist())
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(__import__("pathlib").Path(lm_score.__file__).parents[2]))
    assert said.returncode == 0, said.stderr[-800:]
    assert int(said.stdout.split()[0]) < 700 and said.stdout.split()[1:] == ["[2]", "[1]"]


def test_units_and_own_words():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(20)
    texts = [b"".join(rng.choice([b"a", b"bc", b" ", b"\n", b"\t ", b"long" * 9, "é".encode()]) for _ in range(rng.randrange(12))) for _ in range(300)] + [b"", b" ", b"x"]
    u = lm_score.Units.of(texts)
    spans = [(d, g, t) for d, x in enumerate(texts) for t, g in ((m[0], not m[0].strip()) for m in re.finditer(rb"[ \t\n\r\x0b\x0c]+|[^ \t\n\r\x0b\x0c]+", x))]
    assert [(int(d), bool(g), u.data[s:e].tobytes()) for d, g, s, e in zip(u.doc, u.gap, u.starts, u.ends)] == spans
    number, known = u.distinct
    known = known.to_pylist()
    assert [known[k] for k in number] == [t for _, _, t in spans] and len(set(known)) == len(known)
    columns = pa.array([t.decode() or None for t in texts])
    parts = [(x, y, v) for c in (columns, columns.slice(7)) for x, y, v in lm_score.units_of(c, 40)]
    assert [v.data[s:e].tobytes() for x, y, v in parts for s, e in zip(v.starts, v.ends)] == [t for _, _, t in spans] + [t for d, _, t in spans if d >= 7]
    more = [*dict.fromkeys([*known, *(b"x" * n for n in range(1, 60)), *(b"%dlong unit number %d" % (n, n) for n in range(300)), b"q" * 5000])]
    hashes = lm_score.hashed(pa.array(more, pa.large_binary()))
    assert len(set(hashes.tolist())) == len(more)
    assert all(lm_score.hashed(pa.array([x], pa.large_binary()))[0] == h for x, h in zip(more, hashes))
    doc, ids = u.doc[~u.gap], u.size[~u.gap]
    before, held = lm_score.own_words(doc, ids)
    for k in range(len(doc)):
        mine = [j for j in range(k) if doc[j] == doc[k]]
        assert (before[k], held[k]) == (sum(ids[j] == ids[k] for j in mine), len(mine))


def brute_score(docs, taught, model, n_units, shares=lm_score.SHARES):
    """log10 of each text, unit by unit and passage by passage, with the model's own bits."""
    ends = sum(taught)
    stop = (ends + 0.5) / (n_units + ends + 1)
    cut = []
    for t in docs:
        u = lm_score.Units.of([t])
        cut.append((u, [(h, a, b) for h, a, b in zip(*(x.tolist() for x in u.passages()))]))
    held = Counter(h for (u, ps), own in zip(cut, taught) if own for h, a, b in ps if u.ends[b - 1] - u.starts[a] >= lm_score.LEAST_PASSAGE)
    out = []
    for (u, ps), own in zip(cut, taught):
        logs, seen, n = {s: [] for s in shares}, Counter(), 0
        for k, (a, b, gap) in enumerate(zip(u.starts, u.ends, u.gap)):
            t = u.data[a:b].tobytes()
            p = 10 ** (float(model.firsts[u.contexts()[k], t[0]]) + model.rest([t])[0])
            for s in shares:
                logs[s].append(math.log10(p if gap or not n else s * seen[t] / n + (1 - s) * p) + math.log10(1 - stop))
            if not gap:
                seen[t] += 1
                n += 1
        big = [(h, a, b) for h, a, b in ps if u.ends[b - 1] - u.starts[a] >= lm_score.LEAST_PASSAGE]
        mine = Counter(h for h, _, _ in big) if own else Counter()
        copies = [(h, a, b) for h, a, b in big if held[h] > mine[h]]
        spelled = [sum(logs[s]) - sum(sum(logs[s][a:b]) for _, a, b in copies) for s in shares]
        best = max(spelled)
        x = best + math.log10(sum(10 ** (y - best) for y in spelled) / len(shares))
        x += sum(math.log10((held[h] - mine[h]) / (sum(held.values()) - sum(mine.values()))) + math.log10(1 - stop) for h, _, _ in copies)
        copied = 0
        for h, a, b in ps:  # one after the other: copies so far tell the next
            is_copy = (h, a, b) in copies
            x += math.log10(((0.02 if is_copy else 1.0) + (copied if is_copy else ps.index((h, a, b)) - copied)) / (1.02 + ps.index((h, a, b))))
            copied += is_copy
        out.append(x + (math.log10(0.5) if len(u.data) else 0) + math.log10(stop))
    return out


def test_score_against_brute_force(spark):
    """op7's score of a whole small table, written out again; texts that occur twice, and parts of them, are named."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice(["ther", "on", "ing", "re", "st", "ou", "X."]) for _ in range(rng.choice([1, 2, 3])))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 150, 300]))) + rng.choice(["", "\n", "."]) for _ in range(60)]
    texts += [texts[k] for k in range(20)] + ["new start " + t + " new end" for t in texts[:10]] + ["", " ", "again " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    caught = {}
    train = lm_score.train

    def kept(units, *rest):
        caught["n"], caught["model"] = units.agg(F.sum("n")).first()[0], train(units, *rest)
        return caught["model"]

    lm_score.train = kept
    try:
        got = {r["doc_id"]: r["score"] for r in lm_score.scored(df, fold_of("doc_id") != 1).collect()}
    finally:
        lm_score.train = train
    taught = [zlib.crc32(str(k).encode()) % 5 != 1 for k in range(len(texts))]
    want = brute_score([t.encode() for t in texts], taught, caught["model"], caught["n"])
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-3), (k, len(t))
    twins = [k for k in range(60, 80) if len(texts[k]) > 500 and taught[k - 60] and taught[k]]
    assert twins and all(got[k] / len(texts[k]) > 0.3 * sum(got[j] for j in range(20, 60)) / sum(len(texts[j]) for j in range(20, 60)) for k in twins)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home page of this</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them all.</div>
<main><article class="post"><h1>The   title&nbsp;here</h1><p>First &lt;b&gt; <b>bold</b>, text of &eacute; a paragraph.<br>More.<p>Second one with <a href="x">a link</a> in it, unclosed
<ul><li>Point one of it.</li><li>Point two</li></ul><div class="advert">Buy now, it is cheap.</div><p>a < b &amp&amp; c</p><form><p>Your mail, please, here.</p><input></form></article>
<section id="comments"><p>I disagree, said a reader, at some length, with everything.</p></section></main><aside><p>Related: another story, with words.</p></aside>
<footer><p>&copy; 2024 us. All rights reserved.</p></footer><!-- <p>hidden</p> --></body></html>"""


def test_main_text():
    assert html_main_text.main_text(PAGE) == "The title here\nFirst <b> bold, text of é a paragraph. More.\nSecond one with a link in it, unclosed\nPoint one of it.\nPoint two\na < b && c"
    for odd in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='", "& &amp"):
        assert html_main_text.main_text(odd) in ("", "<", "& &")
    assert html_main_text.main_text("<div>" * 3000 + "<p>A deep, long paragraph of text, that is content.</p>") == "A deep, long paragraph of text, that is content."


WORDY = " ".join(f"<p>Paragraph {k} of the article, with some words in it.</p>" for k in range(6))


@pytest.mark.parametrize("start", ['article class="post comment-status-open"', 'article class="tags-enabled"', 'article id="share-buttons-on"', 'article class="header-visible"', 'article class="category-ads"', 'div class="search-results"', 'div class="page with-sidebar"', "form", 'div id="comments-and-more"'])
def test_no_word_loses_the_article(start):
    tag = start.split()[0]
    page = f'<body><nav><a href="x">Home</a> <a href="y">More of this</a></nav><{start}>{WORDY}<p>Energy is <math><mi>E</mi><annotation>\\E</annotation></math>, we say.</p></{tag}><footer>All rights, reserved.</footer>'
    assert html_main_text.main_text(page).split("\n") == [*(f"Paragraph {k} of the article, with some words in it." for k in range(6)), "Energy is E, we say."]


def test_parts_of_an_article():
    page = f"""<body class="has-sidebar comment-form"><header><h1>The site</h1><p>All the news, every day, for everyone who reads.</p></header><div class="comment-list"><p>A first reader: {"this is long, " * 30}</p></div>
    <article><header><h1>The headline</h1><p>By someone, on some day.</p></header>{WORDY}<aside><p>{"An aside, with words. " * 9}</p></aside><div class="share-buttons"><p>Share this, with all.</p></div>
    <section class="comments"><article class="comment"><p>{"I disagree, dear author, with all of it. " * 20}</p></article></section><footer><p>Filed under news, by someone, at some time.</p></footer></article>
    <div class="sidebar"><p>{"A long text in the sidebar, about us. " * 9}</p></div><div><p>{"An advert without a name, but with words. " * 3}</p></div>"""
    assert html_main_text.main_text(page).split("\n") == ["The headline", "By someone, on some day.", *(f"Paragraph {k} of the article, with some words in it." for k in range(6))]


def test_the_cut_decides():
    """Short list items that look like boilerplate on their own stay between paragraphs; a like list of links goes."""
    page = "<body><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div><h2>Title</h2><p>A long paragraph of text, which says much.</p><ul><li>Point two</li><li>x</li></ul><p>Another paragraph of text, which says much.</p></div>"
    costs, edges = html_main_text.graph_of(html_main_text.parsed(page))
    assert [c > 0 for c in costs] != html_main_text.minimum_cut(costs, edges)
    assert html_main_text.main_text(page) == "Title\nA long paragraph of text, which says much.\nPoint two\nx\nAnother paragraph of text, which says much."


def test_pages_are_cut_at_least_cost():
    """The labels of random small pages against all labellings, with the costs written out again."""
    rng = random.Random(15)
    parts = ["<p>Words, some of them.", "<li>x", "<div>", "</div>", "<ul>", "</ul>", '<a href="x">link</a>', "<h2>Head", '<div class="share">', "<p>y", "<article>", "</article>", "<aside>", "</aside>", "<br>", "tail"]
    differ = 0
    for _ in range(400):
        page = html_main_text.parsed("".join(rng.choice(parts) for _ in range(rng.randrange(14))))
        costs, edges = html_main_text.graph_of(page)
        if len(costs) > 9:
            continue
        value = lambda x: sum(c for c, keep in zip(costs, x) if not keep) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        labels = html_main_text.minimum_cut(costs, edges)
        assert value(labels) == pytest.approx(min(value([bool(m >> k & 1) for k in range(len(costs))]) for m in range(1 << len(costs))))
        differ += labels != [c > 0 for c in costs]
    assert differ > 20


def test_long_and_deep_pages():
    import time

    began = time.time()
    assert html_main_text.main_text("<div>" * 60_000 + "<p>A deep, long paragraph of text, that is content.</p>") == "A deep, long paragraph of text, that is content."
    assert html_main_text.main_text("<b>" * 50_000 + "</i>" * 50_000 + "<p>Text, with words, that stays.</p>" * 3000).count("stays") == 3000
    assert len(html_main_text.main_text("<article><p>" + "word, " * 1_000_000)) == 5_999_999
    assert time.time() - began < 20


def test_pages_of_the_table(spark):
    """Whole table: title and paragraphs of each article, as a plain reading of these pages' one form finds them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_main_text.op9_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    from html import unescape

    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div|section|ul|li)\b[^>]*>", article.replace("<br>", " "))]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in lines if x) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_minimum_cut():
    rng = random.Random(13)
    for _ in range(300):
        n = rng.randrange(1, 9)
        costs = [rng.choice([-3, -1, -0.5, 0.5, 1, 2.5]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.3, 1.2, 2.0])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        value = lambda x: sum(c for c, l in zip(costs, x) if not l) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731, E741
        best = min(value([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert value(html_main_text.minimum_cut(costs, edges)) == pytest.approx(best)


def test_extracted(spark):
    df = spark.createDataFrame([(1, PAGE, "old", 4), (2, None, "old", 4), (2, None, "old", 4)], "page_id int, html string, text string, n_chars int")
    got = html_main_text.extracted(df)
    assert got.columns == ["page_id", "text", "n_chars"] and sorted(r["n_chars"] for r in got.collect())[:2] == [0, 0]
    assert html_main_text.extracted(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_as_the_library(spark, tokenizer):
    rng = random.Random(14)
    pool = [*"abcdefgh  \n\t'.,!?123é日🙂  \u0085\x1c", "'s", "'ll", "<|endoftext|>", "the", "therewh", "a" * 70, "\r\n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)] + [None, "", "x" * 5000, " " * 3000, "thereab" * 4000]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id int, text string, ids string")
    from hashlib import sha256

    for r in bpe.encoded(df, bpe.default_vocabulary(), digests=True).collect():
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(df.limit(0), bpe.default_vocabulary()).count() == 0


def test_forced_boundaries():
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        b = bpe.BoundaryBPE(json.load(f))
    assert b.cut(b"a\x00b") == [b"a", b"\x00", b"b"] or b"".join(b.cut(b"a\x00b")) == b"a\x00b"
    assert any(len(b.cut(w)) > 1 for w in (b"qzxj", b"\xc3\xa9q", b"wvq"))
    assert b.merge(b"ab" * 100) == b.merge_long([bytes([x]) for x in b"ab" * 100])


def test_fold(spark):
    df = spark.createDataFrame([(k,) for k in [None, 0, 7, -3, 10**12]], "doc_id long").select("doc_id", fold_of("doc_id").alias("f"))
    assert all(r["f"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 for r in df.collect())
    assert F is not None


def test_bpe_tables_are_bounded(monkeypatch):
    """Small tables give the same ids, hold no more than they may, and keep what is asked for again and again."""
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    rng = random.Random(5)
    texts = [" ".join("the" if rng.random() < 0.3 else "".join(rng.choices("abcdeé京 ", k=rng.randrange(1, 90))) for _ in range(40)) for _ in range(60)]
    whole = bpe.BoundaryBPE(spec)
    expected = [whole.encode(t) for t in texts]
    assert not whole.fragments.keys() & {w.encode() for w in whole.codes if len(whole.cut(w.encode())) == 1 and len(w) > 20}
    monkeypatch.setattr(bpe, "WORDS", 20)
    monkeypatch.setattr(bpe, "FRAGMENTS", 6)
    small = bpe.BoundaryBPE(spec)
    for t, ids in zip(texts, expected):
        assert small.encode(t) == ids
        assert len(small.codes) + len(small.codes.old) <= 20 and len(small.fragments) + len(small.fragments.old) <= 6
    made = []
    recent = bpe.Recent(lambda k: made.append(k) or k, 8)
    for k in range(100):
        assert recent["often"] == "often" and recent[str(k)] == str(k)
    assert made.count("often") == 1 and recent["x" * 65] == "x" * 65 and "x" * 65 not in recent
