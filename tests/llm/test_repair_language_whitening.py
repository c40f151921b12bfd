"""Conversation repair, language identification and whitening against brute force, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import conversation, langid, queries, whitening

CLASH = ("audit", "block", "kind", "digest", "copies", "score", "x", "index", "whitened", "_best")
TURNS = "conv_id long, turn long, role string, text string"


def table(df, key):
    return {r[key]: r for r in df.collect()}


# --- conversations -----------------------------------------------------------------------------------------------


def brute_repair(rows):
    """Least cost and least audit by best-first search over (row, last initial), with the rows that stay. rows: role, text in order."""
    seen, must, cut, counts = set(), [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        must.append(fault in ("blank", "duplicate"))
        cut.append(fault == "truncated")
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out), counts
        if (i, last) in done:
            continue
        done.add((i, last))
        to = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if not must[i]:
                if (last, role[:1]) in after:
                    heapq.heappush(heap, (cost + cut[i], audit + "K", i + 1, after[last, role[:1]], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + cut[i], audit + "R", i + 1, to, (*out, f"{name}:{text}")))


def dialogues():
    rng = np.random.default_rng(3)
    says = ["Yes.", "No", "Why?", " ", "", "Fine!", "Fine!\n", "é。", "so\t", "Long. " * 500]
    out = []
    for conv in range(60):
        n = int(rng.integers(0, 12)) if conv < 58 else 2600
        for turn in range(n):
            out.append((conv, turn * int(rng.integers(1, 3)), str(rng.choice(["user", "assistant", "system", "tool", "", "umpire"], p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05])), str(rng.choice(says[:9] if conv < 58 else says)) + ("" if conv < 58 else str(turn % 700))))
    return out + [(None, None, None, None), (None, None, "user", "Hi."), (None, 4, "user", "Hi."), (70, 1, "user", "A."), (70, 1, "user", "A."), (70, 1, "user", "A."), (71, 2, "assistant", "B"), (72, 0, "system", "S.")]


def by_conversation(rows):
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    order = sorted(spaced, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    out = {}
    for c, t, r, x in order:
        out.setdefault(c, []).append((t, r, x))
    return out


def test_repair_equals_a_search(spark, monkeypatch):
    rows = dialogues()
    frame = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit("x") for c in CLASH})
    got = table(conversation.audits(frame), "conv_id")
    want = by_conversation(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        cost, audit, text, counts = brute_repair([(r, x) for _, r, x in turns])
        r = got[conv]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), conv
        assert {k: r[k] for k in counts} == counts
        known = [t for t, _, _ in turns if t is not None]
        assert r["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for r in conversation.repaired(frame.where("conv_id = 58")).collect() for role in r["roles"]))


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    """Conversations of many blocks: the walk goes on from the state in which the block before ended."""
    rows = [(c, t, r, x) for c, t, r, x in dialogues() if c is not None and c < 40]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    whole = table(conversation.audits(frame), "conv_id")
    monkeypatch.setattr(conversation, "_edges", lambda batch: np.arange(batch.num_rows + 1))  # a row a block
    assert table(conversation.audits(frame), "conv_id") == whole


def test_checkpoints_give_what_one_table_would():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 10, 64, 65, 200):
        block = rng.integers(0, 4, n), (rng.random(n) < 0.2).astype(np.int64), (rng.random(n) < 0.3).astype(np.int64), rng.integers(0, 2, n)
        padded, ends = conversation.Padded([block]), conversation.END[None]
        costs = padded.backward(ends.astype(np.int64), 0, n, True)
        (audit,), (state,) = padded.walk(ends, np.array([0]), np.array([conversation.EMPTY]))
        price = {"K": 0, "D": 3, "I": 2, "R": 2}
        paid, i, more = 0, 0, 0
        for e in audit.decode():
            paid += price[e] + (block[2][i] if e in "KR" else 0)
            if e == "I":
                continue
            if more:
                more -= 1
            else:
                more, i = int(block[3][i]), i + 1
        assert paid + conversation.END[state] == costs[0, 0, conversation.EMPTY]


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"One. Two{t}!") for c in range(200) for t in range(4)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, TURNS)
    hurt = {}
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if r is None else r), (" " if x is None else x)
        if h:
            hurt.setdefault(c, []).extend([(t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1))
    got = {}
    for r in conversation.damaged(frame).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in hurt.items()}
    every = frame.unionByName(spark.createDataFrame([(999, 0, "user", "x")], TURNS))
    out = table(conversation.audits(conversation.damaged(frame), every), "conv_id")
    assert set(out) == set(range(200)) | {999, None}
    r = out[999]
    assert (r["gaps"], r["blank"], r["cost"], r["audit"], r["repaired_sha256"]) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation.audits(frame.limit(0)).count() == 0


# --- languages ---------------------------------------------------------------------------------------------------

TEXT = "doc_id long, text string, lang string"


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def brute_scores(learn, text, orders=langid.ORDERS):
    """Each language's log-probability of a text, gram by gram over Python dicts."""

    def grams(t):
        t = re.sub(r"\0+", "\0", "\0" + "".join(c if c.isalpha() else "\0" for c in t.lower()))
        return [t[i : i + n] for n in orders for i in range(len(t) - n + 1) if t[i : i + n] != "\0"]

    names = sorted({lang for _, lang in learn})
    counts = {name: {} for name in names}
    for t, lang in learn:
        for g in grams(t):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    out = {}
    for name in names:
        total, n = sum(counts[name].values()), sum(lang == name for _, lang in learn)
        out[name] = np.log(n + langid.SMOOTH) + sum(np.log((counts[name].get(g, 0) + langid.SMOOTH) / (total + langid.SMOOTH * langid.BUCKETS)) for g in grams(text)) / len(orders)
    return out


@pytest.mark.parametrize("together", [1, 64])
def test_languages_equal_plain_counts(spark, together):
    rng = np.random.default_rng(1)
    learn = [(speech(rng, letters, 30), lang) for letters, lang in (("abcdeé", "x"), ("abfgh", "y"), ("日本語学", "z")) for _ in range(6)]
    ask = ["abc déa", "Gha. bfa", "語学 日", "a", "", None, "123 - !", "zzz", speech(rng, "abfgh", 20_000)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(learn)] + [(None, t, "y") for t in ask] + [(7, "abcd", None), (8, None, "w"), (9, "ab", "learned")]
    frame = spark.createDataFrame(rows, TEXT).repartition(3).withColumns({c: F.lit("x") for c in CLASH})
    out = langid.identify(frame, F.col("doc_id").isNotNull() & (F.col("lang") != "learned"), together=together)
    assert out.columns == [c for c in frame.columns if c != "score"] + ["lang_pred", "score"]
    got = {r["text"]: r for r in out.where("doc_id is null").collect()}
    for t in ask:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[t]["lang_pred"], got[t]["score"]) == ("und", 0.0)
            continue
        want = brute_scores(learn, t)
        best = max(want, key=want.get)
        assert got[t]["lang_pred"] == best
        assert got[t]["score"] == pytest.approx(1 / sum(np.exp(v - want[best]) for v in want.values()), abs=2e-3)
    assert out.count() == len(rows)
    nothing = langid.identify(frame, F.lit(False)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)] and langid.identify(frame.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        langid.languages(frame, most=1)


def test_slices_do_not_matter():
    texts = ["...Ab c", "d", "", "!!", "e-f"]
    whole = {i: [] for i in range(len(texts))}
    for buckets, owner in langid.gram_buckets(*langid.letters([t.encode() for t in texts])[:2]):
        for b, o in zip(buckets.tolist(), owner.tolist(), strict=True):
            whole[o].append(b)
    for i, t in enumerate(texts):
        code, owner, some = langid.letters([t.encode()])
        assert [b for buckets, _ in langid.gram_buckets(code, owner) for b in buckets.tolist()] == whole[i] and some[0] == any(c.isalpha() for c in t)


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op12_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


# --- whitening ---------------------------------------------------------------------------------------------------


def vectors(n=900, dim=40):
    rng = np.random.default_rng(8)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + rng.normal(size=dim)).astype(np.float32)


def check_whitened(rows, x, most=32):
    x = np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    got = np.array([r["whitened"] for r in rows])
    assert got.shape == (n, k) and [r["n"] for r in rows] == [n] * n
    assert [int(r["deviation"]) for r in rows] == [int(v) for v in ((n * x - total).astype(object) ** 2).sum(1)]
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * got).sum(0))
    assert np.abs(got - want).max() < 1e-6 and np.abs(got.T @ got / n - np.eye(k)).max() < 1e-6
    assert np.allclose(rows[0]["explained"], values[:k] / np.trace(cov), rtol=1e-9) and 0 <= rows[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("matrix_rows", [whitening.MATRIX_ROWS, 1])
def test_whitening_equals_numpy(spark, matrix_rows):
    x = vectors()
    odd = [(None, [float("nan")] * 40), (5, None), (6, []), (7, [1.0] * 39), (8, [float("inf")] + [0.0] * 39), (9, [None] + [0.0] * 39), (10, [1e30] + [0.0] * 39)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + odd
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumns({c: F.lit("x") for c in CLASH})
    got = sorted(whitening.whiten(frame, matrix_rows=matrix_rows).collect(), key=lambda r: r["vec_id"])
    check_whitened(got, x)


def test_whitening_of_flat_repeated_and_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    base = vectors(30, 6)
    flat = np.concatenate([base, base[:, :1], np.ones((30, 1), np.float32)], 1)
    flat = np.concatenate([flat, flat, flat])
    frame = spark.createDataFrame([(None if i == 0 else i, [float(c) for c in v]) for i, v in enumerate(flat)], schema)
    rows = sorted(whitening.whiten(frame, most=4).collect(), key=lambda r: r["vec_id"] or 0)
    check_whitened(rows, flat, 4)
    assert {len(r["whitened"]) for r in whitening.whiten(frame).collect()} == {6}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(2, 0, [], 0.0)] * 2
    assert whitening.by_component(whitening.whiten(frame.limit(0))).count() == 0
    far = spark.createDataFrame([(i, [1e8 * i, -1e9 + i]) for i in range(50)], "vec_id long, embedding array<double>")
    check_whitened(sorted(whitening.whiten(far).collect(), key=lambda r: r["vec_id"]), np.array([[1e8 * i, -1e9 + i] for i in range(50)]))


def test_whitening_query(spark, sf_dir):
    rows = queries.op13_embedding_whitening(spark, sf_dir)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in rows.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert rows.count() == 32 * n
