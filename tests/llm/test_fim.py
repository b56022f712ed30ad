import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from quartier.llm import fim

MARK = {"p": "<P>", "s": "<S>", "m": "<M>"}


def brute(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) by plain means."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in MARK.values()) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), output


def texts(rng):
    fixed = [None, "", "\n", "\n\n\n", "one", "one\n", "\none", "a\nb", "<P>", "x<S>y\nz", "<M", "<<P", "é\n漢字\n😀́\nend", "\r\n\x00\x0b \u0085\n", " \n" * 500, "x" * 100_000, "<\n<\n<P\n"]
    made = ["".join(rng.choice(["a", "ß", "漢", "😀", " ", "\n", "<", "P>", "S>", "<S"]) for _ in range(rng.choice([5, 50, 3000]))) for _ in range(60)]
    return fixed + made + ["\n".join("w" * rng.randint(0, rng.choice([3, 80, 900])) for _ in range(5000)), "l\n" * 40_000, made[0], made[1]]


def test_equal_to_brute_force_and_restored(spark):
    found = texts(random.Random(3))
    rows = [(None if i == 20 else 5 if i in (21, 22) else i, t, i, "kept", 1.5) for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i int, n string, output double").repartition(3)
    for rate, spm in ((100, 50), (50, 0), (100, 100)):
        got = fim.fill_in_middle(docs, rate=rate, spm=spm).withColumn("restored", fim.restored()).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, found[r.i], 7, rate, spm)
            assert r.restored == (found[r.i] or "") and r.text == found[r.i]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_a_written_index_serves_other_seeds(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(4)))]
    fim.line_index(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for seed in (7, 8):
        got = fim.fill_in_middle(stored, seed=seed)
        assert "ArrowEval" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()
        assert sorted((r.doc_id, r.output) for r in got.collect()) == [(i, brute(i, t, seed)[4]) for i, t in rows]


@pytest.mark.parametrize("kind", ["even", "random", "jumps", "flat", "one"])
def test_segments_are_bounded_and_exact(kind):
    rng = np.random.default_rng(5)
    steps = {"even": np.full(50_000, 61), "random": rng.integers(1, 120, 30_000), "jumps": np.where(rng.random(20_000) < 0.01, 90_000, 1), "flat": np.ones(2_200_000, int), "one": np.array([7])}[kind]
    offsets = np.concatenate([[0], np.cumsum(steps)])
    first, base, slope, residual = fim.fit(offsets)
    assert np.abs(residual.astype(int)).max() <= fim.ERROR + 2 and first[0] == 0 and len(residual) == len(offsets)
    rank = np.arange(len(offsets))
    s = np.searchsorted(first, rank, side="right") - 1
    assert (np.array(base)[s] + (np.array(slope)[s] * (rank - np.array(first)[s]) >> fim.PLACES) + residual == offsets).all()
    assert len(first) <= {"even": 1, "flat": 3, "one": 1}.get(kind, len(offsets) / 5)


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    got = fim.op13_fill_in_middle(spark, path)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({fim.OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want, key=str)
