import random
import re

from tieplane.llm.urls import RULES, judge, rules_frame


def brute(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def check(spark, urls, rules, partitions=5):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, rules_frame(spark, rules), partitions=partitions).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_rules_and_odd_urls(spark):
    hosts = ["example.com", "EXAMPLE.com", "a.example.com", "notexample.com", "com", "example.net", "x.net", "net", "b.org", "example.com:80", "example.com.", "", "u@example.com", "a..com", "ü.com"]
    paths = ["/en/", "/en/7", "/en/71?x=1", "/en/8#top", "/de/8", "/de/9", "/es/", "/", "", "?q=/en/", "#/en/", "/EN/7", "en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://example.com/en/7", "://com/en/", "\nhttp://com/en/7\n"]
    check(spark, urls, RULES)


def test_nested_rules_against_brute_force_on_a_hot_host(spark):
    rng = random.Random(5)
    labels = ["a", "b", "c", "aa", "z"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}{path()}" for _ in range(600)] + ["http://hot.b.a/x/y"] * 400
    check(spark, urls, rules, partitions=11)


def test_empty_tables(spark):
    check(spark, [], RULES)
    df = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    none = rules_frame(spark).filter("host = 'no'")
    assert [tuple(r) for r in judge(df, none).collect()] == [(1, "com", "/en/", None, "allow")]


def test_many_paths_of_one_host(spark):
    rng = random.Random(6)
    path = lambda k: "/" + "/".join(str(int(c)) for c in f"{k:06d}")
    paths = [path(k) for k in rng.sample(range(1_000_000), 100_000)]
    known = set(paths)
    df = spark.createDataFrame([(p, "allow" if i % 2 else "block") for i, p in enumerate(paths)], "path string, verdict string").selectExpr("'hot.com' AS host", "path", "verdict")
    rules = df.unionByName(spark.createDataFrame([("com", "/1", "block"), ("hot.com", "/1/2/", "allow"), ("com", "/", "allow")], "host string, path string, verdict string"))
    urls = [f"http://a.HOT.com{path(rng.randrange(1_000_000))}/x" for _ in range(2000)] + ["http://hot.com/1/2/3", "http://hot.com/1", "http://hot.com", "http://b.com/2", "http://hot.com/" + "9" * 100_000]
    got = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, partitions=7).collect()}
    side = dict(zip(paths, ("allow" if i % 2 else "block" for i in range(len(paths))), strict=True))
    for i, u in enumerate(urls):
        rest = u.split("com", 1)[1]
        p = rest.removesuffix("/x")
        if p in known and len(p) == 12:
            assert got[i] == ("hot.com" + p, side[p])
        elif rest.startswith("/1/2/"):
            assert got[i] == ("hot.com/1/2/", "allow")
        elif rest.startswith("/1"):
            assert got[i] == ("com/1", "block")
        else:
            assert got[i] == (("com/", "allow") if rest else (None, "allow"))
    assert sum(v[0] is not None and v[0].startswith("hot.com/") for v in got.values()) > 100


def test_nulls_and_clashing_names(spark):
    names = ["uid", "key", "stack", "kind", "part", "host", "path", "rule", "verdict", "above", "id"]
    rows = [(None, "http://a.com/en/x"), (1, None), (1, None), (2, "http://example.com/en/7")]
    df = spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], f"page_id long, url string, {', '.join(f'{n} string' for n in names)}")
    rules = spark.createDataFrame([*RULES, *RULES, (None, "/", "block"), ("com", None, "block"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in judge(df, rules).collect()), key=str)
    assert got == sorted([(None, "a.com", "/en/x", "com/en/", "block"), (1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "example.com", "/en/7", "example.com/en/7", "allow")], key=str)
