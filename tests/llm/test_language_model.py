import math
import random
import re
import zlib
from collections import Counter

from quartier.llm import io, language_model as lm


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), "</s>"]


def brute(train, texts):
    """Base and modified Kneser-Ney scores with plain dictionaries."""
    uni, bi = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    d = lm.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    cont = Counter(b for _, b in bi)
    low_d = lm.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    disc = lambda d, c: d[min(c, 3) - 1] if c else 0
    rest = sum(disc(low_d, c) for c in cont.values()) / len(bi)
    low = lambda w: max(cont[w] - disc(low_d, cont[w]), 0) / len(bi) + rest / (v + 1)
    total, gamma = Counter(), Counter()
    for (a, _), c in bi.items():
        total[a] += c
        gamma[a] += disc(d, c)

    def p(a, b):
        if not total[a]:
            return low(b)
        c = bi[a, b]
        return max(c - disc(d, c), 0) / total[a] + gamma[a] / total[a] * low(b)

    seen = set(uni)
    for a in [*list(uni)[:5], "<s>", "never"]:
        assert abs(sum(p(a, b) for b in seen) + p(a, "unseen token") - 1) < 1e-9
    out = []
    for t in texts:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((len(w), sum(x in uni for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True))))
    return out


def compare(got, want):
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * abs(w[3]) + 1e-9 and abs(g[4] - w[4]) < 1e-6 * abs(w[4]) + 1e-9, (g, w)


def test_equal_to_brute_force(spark):
    rng = random.Random(4)
    words = ["The", "the", "cat", "sat", "on", "a", "mat,", "é", "x" * 50] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "\n", "never seen these", "the " * 5000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    model = lm.train(docs.where("doc_id % 3 > 0"), io.shared_folder(spark, "lm"))
    got = [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs, model).orderBy("doc_id").collect()]
    compare(got, brute([t for i, t in enumerate(texts) if i % 3], texts))


def test_query_on_small_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    got = lm.op10_lm_scoring(spark, path).orderBy("doc_id").collect()
    assert [r.held_out for r in got] == held
    want = brute([t for (_, t), h in zip(rows, held, strict=True) if not h], [t for _, t in rows])
    compare([(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], want)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = lm.train(docs.limit(0), io.shared_folder(spark, "lm"))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in lm.score(docs, model).collect()}
    assert got == {1: (3, 0, 0.0), None: (1, 0, 0.0)}
    assert lm.score(docs.limit(0), model).count() == 0


def brute_order(train, texts, order):
    """Modified Kneser-Ney scores of any order with plain dictionaries of tuples."""
    raw = {n: Counter() for n in range(1, order + 1)}
    for t in train:
        w = ["<s>", *tokens(t)]
        for n in raw:
            raw[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    count = {order: raw[order]}
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in raw[n + 1])
        count[n].update({g: c for g, c in raw[n].items() if g[0] == "<s>" and n > 1})
    v = len({g for g in raw[1] if g != ("<s>",)})
    d = {n: lm.discounts([sum(c == k for c in count[n].values()) for k in (1, 2, 3, 4)]) for n in count}
    disc = lambda n, c: d[n][min(c, 3) - 1] if c else 0
    total, rest = Counter(), Counter()
    for n in count:
        for g, c in count[n].items():
            total[n, g[:-1]] += c
            rest[n, g[:-1]] += disc(n, c)

    def p(context, w):
        n = len(context) + 1
        low = p(context[1:], w) if context else 1 / (v + 1)
        if not total[n, context]:
            return low
        c = count[n][(*context, w)]
        return (max(c - disc(n, c), 0) + rest[n, context] * low) / total[n, context]

    seen = {g[0] for g in raw[1]} - {"<s>"}
    for context in [*[g[:-1] for g in list(raw[order])[:4]], ("<s>",)]:
        assert abs(sum(p(context, w) for w in seen) + p(context, "unseen token") - 1) < 1e-9
    lines = [["<s>", *tokens(t)] for t in texts]
    return [sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))) for w in lines]


def test_higher_orders_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["The", "the", "cat", "sat", "on", "a"] + [f"w{i}" for i in range(25)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "never seen these", "the " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for order in (2, 3, 4):
        model = lm.train(docs.where("doc_id % 3 > 0"), io.shared_folder(spark, "lm"), order)
        got = [r.score for r in lm.score(docs, model).orderBy("doc_id").collect()]
        want = brute_order([t for i, t in enumerate(texts) if i % 3], texts, order)
        assert all(abs(g - w) < 1e-6 * abs(w) + 1e-9 for g, w in zip(got, want, strict=True)), order


def test_ids_are_not_rounded(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c")], "doc_id long, text string").coalesce(1)
    model = lm.train(docs, io.shared_folder(spark, "lm"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in lm.score(docs, model).collect()) == [(0, 3), (2**60 + 1, 2)]


def test_counts_beyond_32_bits():
    import numpy as np
    import pandas as pd

    assert lm.narrow(np.array([2**32 - 1])).dtype == np.uint32 and lm.narrow(np.array([2**32])).dtype == np.uint64
    keys = np.array([3, 9], np.uint64).tobytes()
    sent = pd.DataFrame({"keys": [keys, keys], "counts": [lm.narrow(np.array(c)).tobytes() for c in ([2**33, 1], [5, 2**32 - 1])]})
    assert lm.summed(sent)[1].tolist() == [2**33 + 5, 2**32]
