import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest

from quartier.llm import bpe, bytescan, token_counts, words

TEXTS = [
    "It's the THING, don't we'll 'something I'd 12 3.4 x²½ <|endoftext|>tail<|startoftext|> <|ENDOFTEXT|>",
    None, "", "   \n\t ", "a" * 5000, "Été ça Ünïcode ß ŁÓDŹ", "é café İstanbul ΣΑΣ 中文字 🙂 a b c\x1cd\x85e",
    "tab\tnew\nline", "'s't're '", "--'s !!'t ?'", "It's the THING", "ab ab ab",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_round_trip_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    latin = ["a" + chr(c) + "B" for c in range(1, 0x250)]
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab'stdlvemrLS 1².,!\n<|>éÉ") for _ in range(60)) for _ in range(200)]
    texts = TEXTS + latin + mixed
    got = {r.doc_id: r for r in bpe.round_trip(rows(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_and_stage(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    docs = rows(spark, TEXTS)
    ids = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, x in enumerate(TEXTS)}
    assert ids[1] == [] and back[1] == ""
    staged = bpe.stage(spark, docs, "").collect()
    assert {r.doc_id: r.ids for r in staged} == ids and {r.doc_id: r.text for r in staged} == dict(enumerate(TEXTS))
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_ids_are_not_rounded(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c")], "doc_id long, text string").coalesce(1)
    for got in (bpe.round_trip(docs), token_counts.count_tokens(docs)):
        assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got.collect()) == [(0, True), (2**60 + 1, True)]


def test_words_with_one_hash_stay_apart(spark, monkeypatch):
    """Words whose hash another word has are encoded where they stand."""
    monkeypatch.setattr(bytescan, "hash_spans", lambda codes, start, end: (end - start).astype(np.uint64))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    docs = pd.DataFrame({"range": 0, "hash": [1, 1, 2, 2], "word": ["a", "b", "aa", "aa"], "times": 1})
    assert words.gathered(docs)[["word", "times"]].to_numpy().tolist() == [["aa", 2]]
    coder = bpe.encoder(bpe.default_path())
    table = words.Table("file:///tmp/spark-no-such-folder", 1)
    split = coder.split(["hello"])
    values, begins = table.lists(split, lambda w: coder.encode_words([w])[0], set())
    assert values.tolist() == t.encode("hello").ids and begins.tolist() == [0, len(values)]


def brute(word, scores, byte):
    word = token_counts.MARK + word
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def learned_plainly(texts, scores):
    """One round: the pieces of all best segmentations, by plain dynamic programming for each word."""
    seen, byte = {}, min(scores.values()) - 1_000_000
    for word in [w for t in texts for w in (t or "").split()]:
        word = token_counts.MARK + word
        best = [(0, 0, [])]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n, best[end - 1][2])]
            options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1, best[s][2] + [word[s:end]]) for s in range(max(0, end - 20), end) if word[s:end] in scores]
            best.append(max(options, key=lambda o: o[:2]))
        for piece in best[-1][2]:
            seen[piece] = seen.get(piece, 0) + 1
    total = math.log(sum(seen.values()) + len(scores))
    return {p: round(1e6 * (math.log(seen.get(p, 0) + 1) - total)) for p in scores}


def test_token_counts_equal_plain_dynamic_programming(spark):
    texts = [*TEXTS, "x" * 700 + " ".join(["an", "and", "andes", "the"] * 5)]
    texts[4] = "a" * 400
    docs = rows(spark, texts)
    first = token_counts.zipf(token_counts.default_path())
    for rounds in (0, 1):
        scores = learned_plainly(texts, first) if rounds else first
        byte = min(scores.values()) - 1_000_000
        got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs, rounds=rounds).collect()}
        for i, text in enumerate(texts):
            found = (text or "").split()
            assert got[i] == (len(found), sum(brute(w, scores, byte) for w in found)), (rounds, i)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("found", [["a", "ab", "abc", "b", "ba"], ["x"], ["ab", "abab", "ababab"]])
def test_ties_take_fewest_pieces(found):
    scores = {token_counts.MARK: -5, "a": -1, "b": -1, "ab": -2, "ba": -3}
    walk = token_counts.Walk(scores)
    assert [walk.to(w) for w in found] == [brute(w, scores, walk.byte) for w in found]
