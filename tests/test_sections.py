import duckdb

from quartier.operators import corpus
from quartier.plans import catalog


def test_no_paragraph_begins_in_the_middle_of_a_cut_line(spark):
    line = "x" * 113 + " and so"
    texts = [
        ("cut", f"§1.1 {line} (909) 555-7013 is a number.\n(a) One\n§1.2\n{line}(b) more"),
        ("whole", f"§1.1 {line}\n(909) a paragraph\n§1.2(a) another\n§1.3 {line} \n(b) more"),
    ]
    got = corpus.split_sections(spark.createDataFrame(texts, "doc_id string, text string")).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.citation, r.content, r.depth) for r in got] == [
        ("cut", "§1.1", "(909) 555-7013 is a number.\n(a) One", 0),
        ("cut", "§1.1(a)", "One", 1),
        ("cut", "§1.2", "(b) more", 0),
        ("whole", "§1.1", "(909) a paragraph", 0),
        ("whole", "§1.1(909)", "a paragraph", 1),
        ("whole", "§1.2", "(a) another", 0),
        ("whole", "§1.2(a)", "another", 1),
        ("whole", "§1.3", "(b) more", 0),
        ("whole", "§1.3(b)", "more", 1),
    ]


def test_sections_equal_sql_where_a_cut_line_goes_on_with_a_mark(spark, tmp_path):
    lines = "\n".join("é" * (119 + i % 3) + mark + "and what follows" for i, mark in enumerate([" (909) ", "(a) ", " (iv) ", "(2) ", " ", "(a) one "]))
    spark.createDataFrame([(1, lines), (2, "short\n(a) one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = ["doc_id", "citation", "title", "content", "depth"]
    got = catalog.QUERIES["r1_sections_whole"](spark, str(tmp_path)).select(*columns).collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES['r1_sections_whole']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
