import numpy as np

from quartier.llm import language

SAMPLES = {"a": ["the cat sat on the mat with the other cat", "a mat is on the cat"], "b": ["der hund und die katze", "die maus und der hund"]}


def brute(text, sample):
    """Phrases of the greedy longest-match parse by substring search."""
    s = "".join(map(chr, np.concatenate([language.letters(t) for t in sample])))
    t = "".join(map(chr, language.letters(text)))
    n = at = 0
    while at < len(t):
        end = at + 1
        while end < len(t) and t[at : end + 1] in s and t[at:end] in s:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_equal_plain_parse():
    model = language.Model(SAMPLES)
    texts = ["the cat and der hund", "xyz", "The, CAT!! 12 mat", "die katze", "e", "zebra qq the mat"]
    counts, letters = model.phrases(texts)
    assert letters.tolist()[1] == 3
    for i, t in enumerate(texts):
        assert counts[i].tolist() == [brute(t, SAMPLES[k]) for k in "ab"], t


def test_predictions_and_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "a", "x"), (2, "der hund und die maus", "b", "x"), (3, None, "a", "x"), (4, " 12 ,. ", None, "x"),
            (5, "", "b", "x"), (6, "the cat " * 3000 + "hund", "a", "x"), (6, "the cat " * 3000 + "hund", "a", "x"), (7, "the mat", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(docs, docs)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = sorted((r.doc_id, r.lang_pred) for r in got.collect())
    assert found == [(1, "a"), (2, "b"), (3, "und"), (4, "und"), (5, "und"), (6, "a"), (6, "a"), (7, "a")]
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert {r.lang_pred for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0
    assert sorted(r.doc_id for r in language.stage(spark, docs, "").collect()) == [1, 2, 6, 6, 7]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = language.op2_language_id(spark, d).where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_every_text_gives_a_share():
    foreign = " ".join(SAMPLES["b"]) + " "
    samples = {"a": [foreign * 1500, *SAMPLES["a"]], "b": SAMPLES["b"]}  # the first text alone is longer than a sample
    model = language.Model(samples)
    text = "the cat sat on the mat with the other cat"
    assert model.predict([text])[0] == ["a"] and model.phrases([text])[0][0, 0] == 1
    texts = [np.arange(n) for n in (90, 3, 20, 0, 50)]
    assert [len(t) for t in language.shared(texts, 80)] == [28, 3, 20, 0, 28]
    assert [len(t) for t in language.shared(texts, 1000)] == [90, 3, 20, 0, 50]
    assert language.SAMPLE_CHARS == 48_000


def test_packed_steps_hold_all_substrings():
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 40, 4000) ** 2 // 40 + 1
    automaton = language.SuffixAutomaton(codes, 45)
    text = bytes(codes.tolist())
    for _ in range(3000):
        at = int(rng.integers(0, 3990))
        query = codes[at : at + int(rng.integers(1, 9))].copy()
        query[-1] = rng.integers(0, 45)
        state = np.zeros(1, np.int32)
        for i, c in enumerate(query):
            state = automaton.step(state, query[i : i + 1])
            assert (state[0] > 0) == (bytes(query[: i + 1].tolist()) in text)
            if not state[0]:
                break


def test_every_sampled_letter_has_its_code():
    rng = np.random.default_rng(7)
    common = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 80))
    samples = {k: [common * 5 + "".join(chr(0x5000 + n + int(c)) for c in rng.integers(0, 150, 400))] for k, n in (("x", 0), ("y", 300))}
    model = language.Model(samples)
    texts = [samples["x"][0][-60:-40] + samples["x"][0][-90:-70], samples["y"][0][-50:]]
    counts, _ = model.phrases(texts)
    assert [[brute(t, samples[k]) for k in "xy"] for t in texts] == counts.tolist()
    assert model.predict(texts)[0] == ["x", "y"]


def test_a_hot_id_is_one_row_of_the_sample(spark):
    """Thousands of labelled rows with no id, or with one and the same, are not gathered."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("the cat sat on mat "), F.col("id").cast("string"), F.repeat(F.lit("x"), F.col("id").cast("int") % 7)).alias("text"), F.lit("a").alias("lang"))
    rows = rows.unionByName(rows.select(F.lit(7).cast("long").alias("doc_id"), "text", "lang"))
    assert len(language.sample(rows)["a"]) == 2
    again = language.sample(rows.repartition(5))
    assert again == language.sample(rows)


def test_rows_are_learned_from_whole(spark):
    """A text is in the sample as a whole or not at all; a language of long texts only is learned from shares."""
    rows = [(i, "a", "the cat sat " * (20 + i)) for i in range(60)] + [(100 + i, "a", "mat dog " * 9000) for i in range(3)] + [(200 + i, "b", "der hund " * 8000) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.sample(docs)
    assert set(got) == {"a", "b"} and {t.strip() for t in got["a"]} <= {t.strip() for _, _, t in rows}
    assert len(got["a"]) > 20 and sum(len(language.letters(t)) for t in got["a"]) <= language.SAMPLE_CHARS
    assert got == language.sample(docs.repartition(7))
    assert language.identify(docs, docs).where("lang <> lang_pred").isEmpty()
    assert language.whole(["abc", "abcdefgh", "de"], 10) == ["abc", "de"]
    assert language.whole(["abcdefghijk"], 5) == ["abcdefghijk"]
