"""The training-data operators against brute force, on texts with nulls, empty and long texts, ties, copies and clashing columns."""

import base64
import functools
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidebars.llm import ann, bpe, lm, media, near_dup, neural, packing, queries, secrets, warc

WORDS = "[^\\x20\\x09-\\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("sequence_id", "spans", "score", "key", "node", "block", "y", "payload_bytes")


def texts():
    rng = np.random.default_rng(5)
    vocab = [f"word{i}" for i in range(400)] + ["Été", "naïve,", "don't", "x=1", "日本語"]
    out = [None, "", "one two", "ONE two", " \t\n", "a b c d e", "word " * 4000]
    for i in range(40):
        base = list(rng.choice(vocab, 120))
        out.append(" ".join(base))
        if i % 4 == 0:
            base[60] = "changed"
            out += [" ".join(base), " ".join(base)]
    out += ["password = hunter22x and token=token:abcdefgh", "AKIA" + "A" * 16 + " AKIAB", "f" * 24 + " " + "0" * 23, 'é "secret": "abc/def==" passwd=abc', "-----BEGIN RSA PRIVATE KEY-----"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH)).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_TOKENS)
    plain = Tokenizer.from_file(path)
    rows = packing.pack(packing.token_pieces(docs, path, 256), 256, shard_rows=20).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, t in enumerate(texts()):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            want[i, k // 256] = (k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes()))
    assert got == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= packing.bin_bound(np.array([r["length"] for r in rows]), 256) + 2
    assert packing.pack(packing.token_pieces(nothing, path)).count() == 0
    clash = packing.token_pieces(docs, path, 256).withColumns({c: F.lit("x") for c in ("_row", "_bin", "_gap", "_free", "_shard", "c0", "offset")})
    twice = packing.pack(clash.unionByName(clash), 256)
    assert twice.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "_row", "_bin", "_gap", "_free", "_shard", "c0", "sequence_id", "offset", "certified"]
    assert twice.count() == 2 * len(want) and twice.where("_row = 'x' and c0 = 'x'").count() == 2 * len(want)


def test_packing_ids_of_odd_text():
    """Ids equal the plain tokenizer's where signs, marks and letters of all kinds meet ASCII punctuation."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_TOKENS)
    plain, own = Tokenizer.from_file(path), packing.ChunkTokens(path)
    rng = np.random.default_rng(11)
    odd = ["“hello”.", "well…\"", "😀!", "5€.", "नमस्ते, ", "hello’.", "—,", "»,", "©.", "İ.", "İstanbul, ok", "e\u0301.", "a\u200d.", "ΑΣ. ΑΣ", "ﬁ.", "it's. we'll, 'tis '", "\x00.", "<|endoftext|>.", "x<|startoftext|> y", "日本語。!", "ΟΔΟΣ,"]
    signs = list("abcXYZ019.,!?'\"-()é Éßσ ΣİıжЖकि日本“”’…—€©😀\u0301\u0307\u200d\u00a0\u3000 \n\tſK") + ["'s", "'LL", "word", "Word's"]
    odd += ["".join(rng.choice(signs, rng.integers(1, 12))) for _ in range(20_000)]
    for low in range(0, len(odd), 500):
        some = odd[low : low + 500]
        for text, got, want in zip(some, own.encode([t.encode() for t in some]), plain.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, free = packing.best_fit_decreasing(lengths, 100)
        assert packing.bin_bound(lengths, 100) <= len(free) and (np.bincount(bins, lengths) <= 100).all()
    assert packing.bin_bound(np.array([51, 51, 51]), 100) == 3 and packing.bin_bound(np.array([34] * 6), 100) == 3


def test_media(docs, nothing):
    got = table(media.media_round_trip(docs))
    for i, t in enumerate(texts()):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["n_samples"] == len(payload) // 64 and r["keyframes"][0]["length"] == 64 and r["error"] is None
    broken = media.write_container(bytes(640))
    frame = docs.sparkSession.createDataFrame([(1, 1, broken[:300]), (2, 1, None), (3, 1, b"")], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] for r in media.probe(frame).collect())
    assert media.media_round_trip(nothing).count() == 0


def test_secrets(docs, nothing):
    rules = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found, ledger = secrets.scan(docs)
    got = table(found.select("doc_id", secrets.spans_line(F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))).alias("line")))
    for i, t in enumerate(texts()):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in p.finditer(t or "") if ok(m))
        assert got[i]["line"] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
    assert ledger.count() == len(set(t or "" for t in texts()))
    assert secrets.scan_new_blobs(docs, ledger).count() == 0
    newer = docs.unionByName(docs.limit(1).withColumn("text", F.lit("token: abcdef9")))
    assert secrets.scan_new_blobs(newer, ledger).count() == 1
    clean = table(secrets.join_findings(docs, ledger).withColumn("text", secrets.redact(F.col("text"), F.col("spans"))))
    assert clean[len(texts()) - 3]["text"] == "[SECRET] " + "0" * 23 and clean[0]["text"] is None
    assert secrets.scan(nothing)[0].count() == 0


def test_secret_ledger_by_blob_and_rule_version(docs):
    """A second generation scans unseen blobs with all rules, and seen ones with rules of a new version alone."""
    spark = docs.sparkSession
    make = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    jwt = "eyJabcdefghijk.eyJabcdefghijk.x"
    first = make(f"password=hunter22 {jwt}", "nothing", None, "nothing")
    _, ledger = secrets.scan(first)
    assert ledger.count() == 3 and ledger.where("generation = 1").count() == 3
    newer = tuple(secrets.Rule("jwt", "eyJ[a-z]+", version=2) if r.kind == "jwt" else r for r in secrets.RULES)
    second = make("nothing", f"password=hunter22 {jwt}", "AKIA" + "B" * 16)
    found, whole = secrets.scan(second, newer, ledger)
    rows = {tuple(r["rules"]) for r in whole.where("generation = 2").collect()}
    assert rows == {("jwt.2",), tuple(map(secrets.pair_of, newer))} and whole.where("generation = 2").count() == 4 - 1
    lines = {r["doc_id"]: r["line"] for r in found.select("doc_id", secrets.spans_line(F.col("spans")).alias("line")).collect()}
    assert lines == {0: "", 1: "assign:0:17,jwt:18:32,jwt:33:47", 2: "access:0:20"}
    assert secrets.findings(ledger, newer).count() == 0 and secrets.scan_new_blobs(second, whole, newer).count() == 0
    clash = first.withColumns({"spans": F.lit(1), "_blob": F.lit(2)})
    assert secrets.join_findings(clash, ledger).columns == ["doc_id", "text", "_blob", "spans"]
    twice, ledger = secrets.scan(first.unionByName(second), deliveries=F.when(F.col("text").startswith("AKIA"), 2).otherwise(1))
    assert twice.count() == 7 and ledger.where("generation = 2").count() == 1


def brute_components(some):
    sets = []
    for t in some:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return sets, root


def test_near_duplicates(docs, nothing):
    sets, root = brute_components(texts())
    got = table(near_dup.near_duplicates(docs))
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), root[i], root[i] == i)
    assert near_dup.near_duplicates(nothing).count() == 0


def test_near_duplicates_by_any_id(docs):
    """Null and repeated ids: rows with equal sets share a component, and no text is taken for another's."""
    one, two, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, one), (None, one), (5, two), (5, other), (7, other + " end"), (7, two), (None, "")]
    found = near_dup.near_duplicates(docs.sparkSession.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in found) == sorted([("None", 56, None, False)] * 2 + [("5", 56, 5, True)] * 2 + [("7", 57, 5, False), ("7", 56, 5, False), ("None", 0, None, False)])


def _at_similarity(rng, near, n=200):
    """A text and a copy with other words at its end: their similarity is the least value of near or more."""
    words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
    cut = int((n - 4) * (1 - near) / (1 + near))
    return " ".join(words), " ".join(words[: n - cut] + [f"x{x}" for x in rng.integers(0, 10**9, cut)])


@pytest.mark.parametrize("num", [85, 80])
def test_near_duplicates_recall_at_the_threshold(spark, num):
    rng = np.random.default_rng(num)
    pairs = [_at_similarity(rng, num / 100 + 0.05 * rng.random(), int(rng.integers(100, 900))) for _ in range(600)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(sum(pairs, ()))]
    got = table(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), num).select("doc_id", "component_id"))
    assert sum(got[2 * i + 1]["component_id"] == 2 * i for i in range(600)) >= 599


def test_a_crowd_just_under_the_threshold(spark, monkeypatch):
    """Texts that share most of a passage are compared in tiles, and only true links count."""
    monkeypatch.setattr(near_dup, "CROWD", 20)
    monkeypatch.setattr(near_dup, "STRIP", 15)
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(170)]
    some = [" ".join(passage + [f"u{k}_{i}" for i in range(30)]) for k in range(60)]
    some += [" ".join(passage + [f"u{k}_{i}" for i in range(26)] + ["z"] * 4) for k in range(0, 60, 3)]
    some = [some[i] for i in rng.permutation(len(some))]
    _, root = brute_components(some)
    got = table(near_dup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(some)], SCHEMA).repartition(3)))
    assert [got[i]["component_id"] for i in range(len(some))] == root and len(set(root)) == 60


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_language_scores(docs, nothing):
    got = table(lm.language_scores(docs, lm.held_out_rows(2, 7)))
    tokens = {i: [w for w in re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for i, t in enumerate(texts())}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0
    seen = [r for r in got.values() if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    assert lm.language_scores(nothing).count() == 0


def test_language_model_learns_which_word_follows(spark):
    """Words of one class and slot are told apart by the word before and the word before last."""
    rng, vocab = np.random.default_rng(2), [f"v{i}" for i in range(300)]
    follow = rng.permutation(300)

    def text(n):
        at = [int(rng.integers(300))]
        while len(at) < n:
            at.append(int(follow[at[-1]]) if rng.random() < 0.9 else int(rng.integers(300)))
        return " ".join(vocab[i] for i in at)

    rows = [(i, text(300), "en", "s", 0) for i in range(400)]
    got = lm.language_scores(spark.createDataFrame(rows, SCHEMA).repartition(4), rounds=1).where("held_out").agg(*(F.sum(c) for c in ("score", "base_score", "n_tokens"))).first()
    assert got[0] / got[2] > got[1] / got[2] + 1.0  # ten times likelier a token than by counts


def test_language_model_learns_beyond_its_own_words(spark):
    """Of 5,000 words most are leaves below shared items; these are predicted from the words before as well."""
    rng, size = np.random.default_rng(4), 5000
    follow = rng.permutation(size)
    at = np.empty((1500, 300), int)
    at[:, 0] = rng.integers(size, size=1500)
    for j in range(1, 300):
        at[:, j] = np.where(rng.random(1500) < 0.9, follow[at[:, j - 1]], rng.integers(size, size=1500))
    rows = [(i, " ".join(f"v{k}" for k in line), "en", "s", 0) for i, line in enumerate(at.tolist())]
    got = lm.language_scores(spark.createDataFrame(rows, SCHEMA).repartition(2), rounds=1).where("held_out").agg(*(F.sum(c) for c in ("score", "base_score", "n_tokens"))).first()
    assert got[0] / got[2] > got[1] / got[2] + 2.0  # a hundred times likelier a token than by counts, of 1,000 times at most


def test_language_model_is_a_distribution():
    """Whatever the weights and the words before, all slots' probabilities add up to 1; so do those of the words of a vocabulary."""
    rng, (levels, width), rows = np.random.default_rng(5), (2, 4), 64
    leaves = width**levels
    slots = lm.TOP + lm.CLASSES * lm.FORKS * leaves
    words = rng.integers(1, 1 << 63, 3000, dtype=np.uint64)
    count = rng.integers(1, 50, len(words))
    head, places = lm.own_slots(words[np.argsort(-count)[: lm.HEAD]].view(np.int64).tolist())
    s = lm.slots_of(words, head, places, leaves)
    assert len(set(s[np.isin(words, head)])) == lm.HEAD and (s[~np.isin(words, head)] >= lm.TOP).all() and s.max() < slots
    n, v = np.bincount(s, count, slots), np.bincount(s, minlength=slots)
    model = lm.MaxEnt(n, rows, levels, width, rng.normal(size=rows * (64 + width)).astype(np.float32))
    used = np.array([x for x in range(slots) if x >= lm.TOP or x % lm.ITEMS < lm.OWN_ITEMS])
    alone = np.arange(len(used) + 1)  # each slot as the only token of a text: the same words before
    p = np.exp(model.log_probs(np.zeros(len(used), np.uint64), used, alone))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    known = np.where(s < lm.TOP, 1.0, (count + 1) / (n[s] + v[s] + 1)) * p[np.searchsorted(used, s)]
    unknown = (p / (n[used] + v[used] + 1))[used >= lm.TOP].sum()  # what each leaf leaves to words that it hasn't seen
    assert known.sum() + unknown == pytest.approx(1, abs=1e-4)


def test_language_model_steps(monkeypatch):
    """One minibatch against plain loops over tokens and features."""
    rng, (levels, width), rows, n = np.random.default_rng(6), (2, 4), 16, 500
    slots = lm.TOP + lm.CLASSES * lm.FORKS * width**levels
    words, s, offsets = rng.integers(1, 9, n, dtype=np.uint64), rng.integers(slots, size=n), np.array([0, 100, 100 + 1, n])
    s = np.where((s < lm.TOP) & (s % lm.ITEMS >= lm.OWN_ITEMS), 0, s)
    start = rng.normal(size=rows * (64 + width)).astype(np.float32)
    model = lm.MaxEnt(rng.integers(0, 30, slots).astype(float), rows, levels, width, start.copy())
    one, two = lm.before(words, offsets)
    grads, hits = [np.zeros((rows, w)) for w in model.widths], np.zeros((3, rows))
    for i in range(n):
        me = slice(i, i + 1)
        for mine, t, bias, at, way in model._steps(s[me], one[me], two[me]):
            z = sum(model.tables[t][r[0]].astype(float) for r in at) + np.atleast_2d(bias)[0]
            g = np.exp(z - z.max())
            g /= g.sum()
            g[way[0]] -= 1
            for k, r in enumerate(at):
                grads[t][r[0]] += g
                hits[t, r[0]] += 1
    state, got = np.zeros((3, rows), np.float32), np.zeros((3, rows))
    monkeypatch.setattr(lm, "_step", lambda table, state, hits, rows, gradient: [np.add.at(state, rows, 1), np.add.at(hits, rows, 1), np.add.at(sums[id(table)], rows, gradient)])
    sums = {id(t): np.zeros(t.shape) for t in model.tables}
    model.learn(words, s, offsets, state, got)
    assert (got == hits).all() and all(np.allclose(sums[id(t)], g, atol=1e-3) for t, g in zip(model.tables, grads, strict=True))
    monkeypatch.undo()
    table, state, got = rng.normal(size=(40, 8)).astype(np.float32), np.ones(40, np.float32), np.zeros(40)
    at, g = np.minimum(rng.zipf(1.4, 2000), 40) - 1, rng.normal(size=(2000, 8)).astype(np.float32)
    total = np.zeros((40, 8))
    np.add.at(total, at, g)
    want = table - lm.RATE * total / np.sqrt(1 + 1e-3 + (total**2).mean(1))[:, None]
    lm._step(table, state, got, at, g)
    assert np.allclose(table, want, atol=1e-4) and (got == np.bincount(at, minlength=40)).all()
    runs = np.array([1] * 100 + [2] * 80 + [7] * 70 + [300])
    wide = rng.normal(size=(runs.sum(), 3)).astype(np.float32)
    firsts = np.cumsum([0, *runs[:-1]])
    assert np.allclose(lm._sums(wide, np.arange(len(wide)), firsts, runs), np.add.reduceat(wide, firsts, axis=0), atol=1e-4)


@pytest.mark.parametrize("salts", [1, 3])
def test_language_model_mean_changes(spark, salts):
    """Rows of the tables move by the tasks' mean change, weighted by hits; rows without hits stay."""
    rows, widths = 2 * lm.PART, (32, 32, 16)
    rng = np.random.default_rng(7)
    old = rng.normal(size=rows * sum(widths)).astype(np.float32)
    tasks = [(rng.normal(size=(len(old))).astype(np.float32) / 8, rng.integers(0, 4, (3, rows)).astype(float) * (rng.random((3, rows)) < 0.3)) for _ in range(5)]
    sent = []
    for k, (change, hits) in enumerate(tasks):
        for batch in lm._changes(lm.tables_of(old, widths), lm.tables_of(old + change, widths), hits, 1):
            sent += [(r["part"], k % salts, bytearray(r["hits"]), bytearray(r["change"])) for r in batch.to_pylist()]
    got = lm._moved(old, widths, spark.createDataFrame(sent, lm.CHANGES).repartition(3), salts)
    for t, (now, first) in enumerate(zip(lm.tables_of(got, widths), lm.tables_of(old, widths), strict=True)):
        weight = sum(h[t] for _, h in tasks)
        mean = sum(lm.tables_of(c, widths)[t] * h[t][:, None] for c, h in tasks) / np.maximum(weight, 1)[:, None]
        assert np.allclose(now, first + mean, atol=2e-3) and (now[weight == 0] == first[weight == 0]).all()


def test_language_model_grows():
    shapes = [(v, w**l) for v in (0, 1, 300, 8000, 10**5, 10**7, 10**9) for l, w in [lm.leaf_shape(v)]]
    assert all(leaves >= math.sqrt(v) / 3 and leaves <= 8 * math.sqrt(v) + 2 for v, leaves in shapes) and all(w <= 32 for v, _ in shapes for _, w in [lm.leaf_shape(v)])


def test_byte_bpe(docs, nothing):
    import tiktoken

    path = public_tokenizers.path(queries.BYTE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN)
    got = table(encoded)
    for i, t in enumerate(texts()):
        assert got[i]["ids"] == plain.encode_ordinary(t or "") and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = table(bpe.decode_ids(encoded, path, public_tokenizers.PATTERN))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts())) and bpe.encode_texts(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert set(got) == set(range(0, 400, 50))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(400), -s.round(12)))[:5]
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
        assert all(score == pytest.approx(s[v]) for v, score in found.values())
    assert hits >= 0.9 * 5 * len(got) and [v for v, _ in (got[0][k] for k in range(1, 6))] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0)).count() == 0


def _recall(spark, x, asked, every, missed=ann.MISSED):
    """Share of the asked ids' five nearest, by brute force, that the search finds, how many rows each query has, and the share of
    all vectors that were scored for it."""
    found, scored = {q: set() for q in asked}, {}
    for r in ann.nearest(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>"), every, missed=missed).collect():
        if r["query_id"] in found:
            found[r["query_id"]].add(r["vec_id"])
            scored[r["query_id"]] = r["scored"]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q, got in found.items():
        s = u @ u[q]
        s[q] = -9
        hits += len(got & set(np.argsort(-s)[:5].tolist()))
    return hits / 5 / len(found), [len(found[q]) for q in asked], np.mean(list(scored.values())) / len(x)


@pytest.mark.parametrize("n", [6000, 20000])
def test_nearest_where_prefixes_decide(spark, n, monkeypatch):
    """Groups of 20 near vectors: a query scores a small part of all, of leaves far larger than that, and finds its neighbours."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 2048)
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 20, 64))
    x = (np.repeat(centres, 20, axis=0) + 0.3 * rng.standard_normal((n, 64))).astype(np.float32)[rng.permutation(n)]
    recall, rows, share = _recall(spark, x, range(0, n, 50), 50)
    assert recall >= 0.95 and set(rows) == {5} and share < 0.08


def test_nearest_in_a_dense_cluster(spark, monkeypatch):
    """A third of the rows lies in one cluster, many times as large as a leaf."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 256)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    x[:2000] = x[0] / np.linalg.norm(x[0]) * 4 + 0.05 * x[:2000]
    assert _recall(spark, x, range(0, 2000, 50), 50)[0] > 0.95


def test_nearest_without_near_neighbours_is_exact(spark):
    x = np.random.default_rng(8).standard_normal((3000, 64)).astype(np.float32)
    recall, _, share = _recall(spark, x, range(0, 3000, 50), 50, missed=0.0)  # the exact search has a name since the forest answers by itself
    assert recall == share == 1


@pytest.mark.parametrize("n", [2, 3, 5, 6, 10])
def test_nearest_of_few_vectors(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 64)).astype(np.float32)
    recall, rows, _ = _recall(spark, x, range(n), 1)
    assert rows == [min(5, n - 1)] * n and (n < 6 or recall == 1)


def test_nearest_of_mixed_lengths(spark):
    """Vectors of another length than most take no part; other columns may have any names; repeated ids are rows of their own."""
    x = np.random.default_rng(1).standard_normal((30, 8))
    rows = [(i % 20, r.tolist()) for i, r in enumerate(x)] + [(0, [1.0] * 9), (50, [1.0] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "node", "hash", "score", "tree", "query")})
    got = ann.nearest(frame, 10).collect()
    assert {r["query_id"] for r in got} == {0, 10} and all(r["vec_id"] != r["query_id"] for r in got) and len(got) == 2 * 2 * 5 // 2


def test_classifiers_on_strange_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    strange = spark.createDataFrame([(None, None, "en", "s", 0), (10**9, "", "en", "s", 0), (10**9, "word " * 60_000, "en", "s", 0), (None, None, "en", "s", 0)], SCHEMA)
    rows = docs.unionByName(strange).withColumns({"y": F.lit("a"), "x": F.lit(1), "n": F.lit(2)})
    repeated = labels.unionByName(labels.limit(5)).unionByName(labels.limit(1).withColumns({"doc_id": F.lit(None).cast("long")}))
    for scores in (neural.quality_scores(rows, repeated), neural.toxicity_scores(rows, repeated)):
        found = scores.collect()
        assert len(found) == docs.count() + 4 and all(0 <= r["score"] <= 1 for r in found)
    assert neural.quality_scores(docs, labels.limit(0)).first()["score"] == 0.5
    assert neural.toxicity_scores(docs.limit(0), labels).count() == 0 and neural.quality_scores(docs.limit(0), labels).count() == 0
    whole = neural.quality_scores(rows, labels, whole=True, out="_score")
    assert whole.columns == [*rows.columns, "_score"]
    hot = docs.withColumn("doc_id", F.lit(labels.where("toxic = 1").first()["doc_id"]))
    assert neural.labelled_sample(hot, labels, "toxic", 100).count() == 1


@pytest.mark.parametrize("name, label, modulus, remainder, least", [("op3_quality_classifier", "quality", 3, 1, (0.97, 0.95)), ("op9_toxicity", "toxic", 4, 2, (0.8, 0.85))])
def test_held_out_accuracy(spark, name, label, modulus, remainder, least):
    """Precision and recall on rows whose labels were never learnt from."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)
    held = [r for r in rows if r["held_out"]]
    both = sum(r["predicted"] == 1 == r[label] for r in held)
    assert both / sum(r["predicted"] for r in held) > least[0] and both / sum(r[label] for r in held) > least[1]


COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op3_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op4_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_language_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_nearest_vectors": ["query_id", "rank", "vec_id", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_warc_archives": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_keep_their_contract(spark, sf_dir, name):
    import tiktoken
    from tokenizers import Tokenizer

    got = queries.QUERIES[name](spark, sf_dir)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    source = "embeddings" if name.startswith("op8") else "pages" if name.startswith("op10") else "documents"
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(*{"embeddings": ("vec_id", "embedding"), "pages": ("page_id", "html"), "documents": ("doc_id", "text")}[source]).collect()]
    if source != "embeddings" and not name.startswith("op1_"):
        assert len(rows) == len(given)
    texts_ = {i: (t or "") for i, t in given} if source == "documents" else {}
    if name.startswith("op1_"):
        plain, places, seen = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENS)), {}, {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        for i, t in texts_.items():
            ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4")
            assert sorted(seen[i]) == [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
        for some in places.values():
            some.sort()
            assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 2048
    if name.startswith("op2_"):
        for r in rows:
            data = texts_[r["doc_id"]].encode()
            payload = data + bytes(-len(data) % 64 if data else 64)
            stored = media.write_container(payload)
            assert (r["payload_sha256"], r["media_bytes"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest()) and r["feature"]
    if name.startswith("op6_"):
        assert {r["train_tokens"] for r in rows} == {sum(len(re.findall(WORDS, t)) + 1 for i, t in texts_.items() if zlib.crc32(str(i).encode()) % 7 != 2)}
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0 for r in rows)
    if name.startswith("op7_"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.BYTE_RANKS), "rb"))}
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in rows:
            ids = plain.encode_ordinary(texts_[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    if name.startswith("op8_"):
        x = np.array([v for _, v in given], np.float64)
        u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([i for i, _ in given])
        hits = 0
        for q in np.flatnonzero(ids % 50 == 0):
            s = u @ u[q]
            s[q] = -9
            mine = [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == ids[q]]
            hits += len(set(mine) & set(ids[np.argsort(-s)[:5]].tolist()))
        assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_nnpu_finds_planted_words():
    rng = np.random.default_rng(1)
    make = lambda bad: np.unique(np.append(rng.integers(100, 5000, 60), rng.integers(0, 8, 3) if bad else [])).astype(np.int32)
    sides = [make(True) for _ in range(300)], [make(i % 10 == 0) for i in range(2000)]
    a, b = (np.bincount(np.concatenate(x), minlength=neural.BUCKETS).astype(float) for x in sides)
    used = neural.used_features(a, b, 300, 2000)
    cut = lambda sets: [np.searchsorted(used, x[np.isin(x, used)]) for x in sets]
    w = neural.nnpu(cut(sides[0]), cut(sides[1]), np.ones(2000), 0.1, np.append(np.zeros(len(used)), np.log(0.1 / 0.9)), 200)
    model = neural.PositiveUnlabelled(used, w[:-1], w[-1])
    assert set(used) == set(range(8))
    assert np.mean(model([make(True) for _ in range(200)]) >= 0.3) > 0.9 and np.mean(model([make(False) for _ in range(200)]) >= 0.3) < 0.05


def test_warc(spark, monkeypatch):
    html = [None, "", "short", "x" * 100, "x" * 100, "é" * 60, "x" * 100, "WARC/1.1\r\n\r\n\r\n\r\n" * 20, "short", "long " * 500_000]
    urls = [f"http://www.b{i % 2}.example.com:80/P?q={i}" for i in range(8)] + [None, "http://[bad"]
    rows = [(9 - i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(2**62, "http://a/", "y" * 200), (None, "http://a/", "y" * 200), (3, "http://a/", "x" * 100), (None, "http://a/", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumns({c: F.lit(1) for c in ("digest", "first", "size", "archive", "n")})
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    index = warc.archive_pages(pages)
    got = index.collect()
    assert len(got) == len(rows)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = {"x" * 100: 3, "y" * 200: 2**62}.get(h)
        again = first is not None and i != first
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(first) if again else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    got.sort(key=lambda r: (r["range_no"], r["position"]))
    keys = [(r["url_key"], r["captured"]) for r in got]
    assert keys == sorted(keys) and len({r["archive"] for r in got}) >= 4
    for r in got:
        head, body = warc.fetch(r["archive"], r["offset"], r["length"])
        assert head["warc-record-id"] == f"<urn:page:{'null' if r['page_id'] is None else r['page_id']}>" and (r["record_type"] == "revisit" or hashlib.sha256(body).hexdigest() == r["payload_digest"])
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_captures_of_a_hot_url_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://h{i}.example.com/", f"page {i}") for i in range(600)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    hot = sorted((r["captured"], r["page_id"], r["capture"]) for r in got if r["url_key"] == "com,example,hot)/")
    assert [c for *_, c in hot] == list(range(1, 401)) and len({r["range_no"] for r in got if r["url_key"] == "com,example,hot)/"}) > 3
    assert all(r["capture"] == 1 for r in got if r["url_key"] != "com,example,hot)/")


def test_merge_of_sorted_runs():
    runs = [sorted((int(x),) for x in np.random.default_rng(k).integers(0, 50, k * 3)) for k in range(7)]
    assert list(warc.merge_runs(runs, key=lambda r: r)) == sorted(sum(runs, []))
    row = lambda k: (k, "", 1, "", 0, "", "", None, "a", 0, 0)
    assert [len(r) for r in warc.natural_runs(iter(map(row, "abcabbz")))] == [3, 4] and warc.natural_runs(iter([])) == []


def test_broken_archives_are_refused():
    import io

    data = warc.record(1, "u", b"body", "d", None)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packed.compress(data) + packed.flush()
    found = list(warc.read_members(io.BytesIO(member * 3), 7))
    assert [(a, n) for a, n, _ in found] == [(i * len(member), len(member)) for i in range(3)] and all(d == data for *_, d in found)
    for broken in (member[:-9], member + member[:20]):
        with pytest.raises(ValueError):
            list(warc.read_members(io.BytesIO(broken)))
    for broken in (b"", b"HTTP/1.1\r\n\r\n", data[:-1]):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = corpus_pipeline.as_table(out, name)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert 0 < len(kept) and len([i for i in good if i in kept]) > 0.8 * len(good)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == kept


def test_pipeline_decides_by_row(spark, monkeypatch):
    """Rows without an id, or with one that others have, are judged by their own text alone."""
    import corpus_pipeline

    one, two, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, one), (None, one), (None, two), (7, two), (7, two), (7, other), (9, one), (None, None), (None, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    stages = {f.__name__: f for _, f in corpus_pipeline.STAGES}
    kept = stages["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, two), (7, other), (9, one), (None, None), (None, ""), (3, None)], key=str)
    monkeypatch.setattr(corpus_pipeline, "_labels", lambda *_: spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    monkeypatch.setattr(corpus_pipeline.neural, "TwoLayers", lambda x, y: functools.partial(np.linalg.norm, axis=1))
    clash = docs.withColumns({"score": F.lit("x"), "_row": F.lit(1), "spans": F.lit(2), "_blob": F.lit(3), "_id": F.lit(4)})
    for name, n in (("quality", 7), ("near_duplicates", 6), ("secret_scan", 10)):
        out = stages[name](spark, clash, "")
        assert out.columns == clash.columns and out.count() == n and out.where("score = 'x' and _row = 1").count() == n
        assert stages[name](spark, clash.limit(0), "").count() == 0
    assert stages["quality"](spark, docs, "").count() == 7
    model = neural.PositiveUnlabelled(neural.word_buckets([two.encode()])[0], 5, -2)
    monkeypatch.setattr(corpus_pipeline.neural, "toxicity_model", lambda *_: model)
    assert stages["toxicity"](spark, docs, "").count() == 7


def test_nearest_breaks_ties_by_id(spark):
    """Vectors that are powers of two times one another have equal cosines, in the forest and at the root; so have others whose cosines are exactly equal."""
    rng = np.random.default_rng(12)
    one = rng.standard_normal(8).astype(np.float32)
    scaled = [(i, [float(v) * 2.0 ** (i % 9 - 4) for v in one]) for i in range(40)]
    frame = spark.createDataFrame(scaled[::-1], "vec_id long, embedding array<float>").repartition(3)
    assert [r["vec_id"] for r in ann.nearest(frame).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    far = [(i, [1.0, 0.0, 0.0, 0.0, *(1.0 if j == i % 7 else 0.0 for j in range(7))]) for i in range(1, 70)]
    rows = [(0, [1.0] + [0.0] * 10), *far, *((1000 + i, [-9.0, *rng.standard_normal(10).tolist()]) for i in range(300))]
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<float>").repartition(4), every=10**6).orderBy("rank").collect()]
    assert [v for v, _ in got] == [1, 2, 3, 4, 5] and len({s for _, s in got}) == 1


def test_nearest_answers_through_the_forest(spark):
    """Without near neighbours (cosines of 0.35 to 0.5) most queries still score a part of the nodes, and few end at the root."""
    x = np.random.default_rng(8).standard_normal((4000, 64)).astype(np.float32)
    recall, rows, share = _recall(spark, x, range(0, 4000, 50), 50)
    assert recall >= 0.9 and set(rows) == {5} and share < 0.5
    assert ann.chances()[ann.SIGNS][100] == 1.0 and all(a <= b for a, b in zip(ann.chances()[7], ann.chances()[7][5:], strict=False))


def test_nearest_on_the_given_table(spark, sf_dir):
    """The query's answers against brute force, and what each cost: fewer nodes than there are."""
    sf_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    if not os.path.isdir(sf_dir):
        pytest.skip("no table of 2,000 vectors")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().dropna()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    u, found = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for r in queries.op8_nearest_vectors(spark, sf_dir).collect():
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, rows in found.items():
        s = u @ u[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len({r["vec_id"] for r in rows} & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        assert all(r["score"] == pytest.approx(s[ids == r["vec_id"]][0], abs=1e-12) for r in rows) and sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * 5 * len(found) and np.mean([rows[0]["scored"] for rows in found.values()]) < 0.6 * len(ids)


def test_context_vectors_equal_plain_sums(spark):
    some = ["one two three two", "", None, "two", "ONE-1 two, x", "a b c d e f g"]
    frame = spark.createDataFrame([(t,) for t in some], "text string").repartition(2)
    want = [np.zeros((n, neural.DIM)) for n in (neural.WORD_ROWS, neural.SHAPE_ROWS)]
    index = [neural._index_vectors(neural.WORD_ROWS, 1), neural._index_vectors(neural.SHAPE_ROWS, 2)]
    for text in some:
        for table, (places, signs), (rows, _) in zip(want, index, neural._streams([(text or "").encode()]), strict=True):
            for i, me in enumerate(rows):
                for j, other in enumerate(rows):
                    if 0 < abs(i - j) <= neural.REACH:
                        for place, sign in zip(places[other], signs[other], strict=True):
                            table[me, place] += sign
    for got, table in zip(neural.context_vectors(frame), want, strict=True):
        assert np.allclose(got, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9), atol=1e-6)


def test_positive_unlabelled_steps_equal_a_plain_version():
    """Adam on the risk as it is written down, with its gradient by differences, over dense rows."""
    rng, n = np.random.default_rng(2), 6
    for prior in (0.2, 0.9):
        sets = [[np.flatnonzero(rng.random(n) < p).astype(np.int16) for _ in range(k)] for k, p in ((5, 0.6), (9, 0.4))]
        times, start = rng.integers(1, 5, 9).astype(float), np.append(rng.normal(0, 0.1, n), -0.5)
        dense = [np.array([np.isin(np.arange(n), s) for s in part], float) for part in sets]
        signs = []

        def parts(w):
            fp, fu = (d @ w[:n] + w[n] for d in dense)
            rest = (times / times.sum() * np.logaddexp(0, fu)).sum() - prior * np.logaddexp(0, fp).mean()
            return prior * np.logaddexp(0, -fp).mean(), rest, 0.5 * (w[:n] ** 2).sum() / len(fp)

        w, m, v = start.copy(), np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, 41):
            good = parts(w)[1] >= 0
            signs.append(good)
            risk = (lambda w: sum(parts(w))) if good else (lambda w: parts(w)[2] - parts(w)[1])
            g = np.array([(risk(w + h) - risk(w - h)) / 2e-6 for h in np.eye(n + 1) * 1e-6])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(neural.nnpu(sets[0], sets[1], times, prior, start, 40), w, atol=1e-4)
        assert prior < 0.5 or not all(signs)


def test_network_learns_what_plain_descent_does():
    """On rows that neither saw, the network's calibrated probabilities are no worse than those of a plain full-batch descent from other weights."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 3)).astype(np.float32)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.05)).astype(np.int64)
    net = neural.TwoLayers(x[:2000], y[:2000])
    loss = lambda p: -np.mean(np.where(y[2000:] == 1, np.log(p), np.log1p(-p)))
    z, few = (x - x[:2000].mean(0)) / x[:2000].std(0), slice(0, 2000)
    w = [rng.normal(0, 0.5, (3, 32)), np.zeros(32), rng.normal(0, 0.2, 32), 0.0]
    for _ in range(2000):
        h = np.tanh(z[few] @ w[0] + w[1])
        d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[few]) / 2000
        back = d[:, None] * w[2] * (1 - h * h)
        w = [w[0] - z[few].T @ back, w[1] - back.sum(0), w[2] - h.T @ d, w[3] - d.sum()]
    plain = 1 / (1 + np.exp(-(np.tanh(z[2000:] @ w[0] + w[1]) @ w[2] + w[3])))
    got = net(x[2000:])
    assert loss(np.clip(got, 1e-6, 1 - 1e-6)) < loss(plain) + 0.05 and np.mean((got >= 0.5) == (y[2000:] == 1)) > 0.9
