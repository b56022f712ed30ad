from quartier.llm import urls

URLS = [
    ("https://WWW.Example.COM/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/2?x#y", "a.example.com", "/en/2", "example.com/en/", "block"),
    ("http://example.com/de/2", "example.com", "/de/2", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net#/fr/", "x.net", "", None, "allow"),
    ("x.net/fr/", "", "", None, "allow"),
    ("HTTP://ÄB.net/fr/a\nb", "Äb.net", "/fr/a\nb", "net/fr/", "block"),
    ("a://b.com/c://d.net/es/", "b.com", "/c://d.net/es/", "com/", "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "y")], "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], URLS[r.page_id]
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_reject_by_purity(spark):
    rules = (("h.org", "/shop/1", "block"), ("h.org", "/shop/2", "block"), ("h.org", "/wiki/", "allow"))
    pages = [f"http://h.org/shop/{i}" for i in range(10, 30)] + [f"http://h.org/shop/{i}/x" for i in range(3, 9)] + [f"http://h.org/wiki/{w}" for w in "abc"] + ["http://h.org/about"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {pages[r.page_id]: r for r in urls.judge(df, rules).collect()}
    # the labelled pages below /shop are bad ones and those below /wiki are not, so the two branches stay apart
    more = spark.createDataFrame([*enumerate(pages), (99, "http://h.org/shop/777")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(more, rules).collect() if r.page_id == 99] == ["block"]
    assert got["http://h.org/about"].verdict == "allow" and got["http://h.org/wiki/a"].verdict == "allow"
    assert got["http://h.org/shop/10"].template == "h.org/shop/{n}" and got["http://h.org/wiki/a"].template.startswith("h.org/wiki/")


def test_many_rare_segments_become_a_wildcard(spark):
    rules = (("w.org", "/u/a", "block"),)
    df = spark.createDataFrame([(i, f"http://w.org/u/{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q") for i in range(600)], "page_id long, url string")
    got = {r.template for r in urls.judge(df, rules).collect()}
    assert len(got) < 30


def plain_templates(pages, rules, depth, many, rare, z):
    """page -> (template, rejected), with dictionaries."""
    import re
    from collections import Counter, defaultdict

    def parts(url):
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        label = max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None
        segments = ["{id}" if re.search(r"^(?=.*\d)[0-9a-fA-F-]{8,}$", s) else re.sub(r"\d+", "{n}", s) for s in path.split("/") if s]
        return host, segments[:depth] + ["**"] * (len(segments) > depth), label

    rows = [[p, *parts(p)] for p in pages]
    name = {i: r[1] for i, r in enumerate(rows)}
    for level in range(depth + 1):
        below = defaultdict(lambda: defaultdict(list))
        for i, r in enumerate(rows):
            below[name[i]][r[2][level] if level < len(r[2]) else ""].append(i)
        for template, children in below.items():
            every, fixed, label = sum(map(len, children.values())), [], {}
            for segment, mine in children.items():
                seen = [rows[i][3] for i in mine if rows[i][3]]
                label[segment] = "/" + segment if segment else ""
                if segment and len(children) > many and len(mine) < every * rare:
                    label[segment] = "/*"
                elif segment and seen:
                    fixed.append((seen.count("block") / len(seen), segment, seen.count("block"), len(seen)))
            branches = []
            for share, segment, bad, n in sorted(fixed):
                if branches:
                    _, _, bad2, n2 = branches[-1][-1]
                    p = (bad + bad2) / (n + n2)
                    if (share - bad2 / n2) ** 2 <= z * z * p * (1 - p) * (1 / n + 1 / n2):
                        branches[-1].append((share, segment, bad, n))
                        continue
                branches.append([(share, segment, bad, n)])
            for branch in branches:
                names = [s for _, s, _, _ in branch]
                for s in names if len(names) > 1 else []:
                    label[s] = f"/<{min(names)}|{max(names)}>"
            for segment, mine in children.items():
                for i in mine:
                    name[i] = template + label[segment]
    labels = Counter((name[i], r[3]) for i, r in enumerate(rows))
    known = [r[3] for r in rows if r[3]]
    prior = known.count("block") / max(1, len(known))
    out = {}
    for i, r in enumerate(rows):
        bad, n = labels[name[i], "block"], labels[name[i], "block"] + labels[name[i], "allow"]
        out[r[0]] = (name[i], r[3] or ("block" if n and (bad + 4 * prior) / (n + 4) > 0.5 else "allow"))
    return out


def test_tree_equals_plain_version(spark):
    import random

    rng = random.Random(5)
    rules = [("h.org", f"/{a}/{b}", rng.choice(["allow", "block"])) for a in "abcdef" for b in "uvw"] + [("k.org", "/", "block")]
    pages = sorted({f"http://{rng.choice(['h.org', 'h.org', 'x.h.org', 'k.org', 'free.org'])}/{rng.choice('abcdefg')}/{rng.choice('uvwxyz')}{rng.choice(['', 'q', '7', '12/x/y/z/zz'])}/{rng.choice(['', 'ab12cd34ef', 'p' + str(rng.randrange(300)), chr(97 + rng.randrange(26)) * rng.randrange(9)])}" for _ in range(1500)})
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {pages[r.page_id]: (r.template, r.verdict) for r in urls.judge(df, rules, depth=3).collect()}
    assert got == plain_templates(pages, rules, 3, 50, 0.005, 2.58)
    assert len({t for t, _ in got.values()}) > 30 and any("<" in t for t, _ in got.values())


def test_rules_equal_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet')")
    got = urls.op7_url_rules(spark, path).select("page_id", "host", "path", "rule", "rule_verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(urls.OP7_SQL).fetchall()))


def test_main_path_has_no_python(spark):
    plan = urls.op7_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
