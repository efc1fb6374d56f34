import random

from quillspark.llm import url_filter as U
from quillspark.sources.tables import local_table

from .conftest import rows_of

URLS = [
    None, "", "no scheme.example.org/es/", "http://example.org/es/x", "http://EXAMPLE.org/ES/x", "https://a.b.example.org/en/12?q=/es/", "http://org/", "http://org", "http://xorg/",
    "http://example.org#top", "ftp://example.com/fr/", "http://example.com/de/1", "http://com/de/", "http://www.example.com/de", "x://y://example.com/de/", "http://example.org:80/es/",
    "http://.example.org/es/", "http://example.org./es/", "://example.org/en/1", "http:///es/", "http://a..com/fr/\nline", "http://example.org/es/" + "y/" * 20_000, "http://" + "s." * 5_000 + "org/",
]


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return low(rest[:end]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_contract_rules(spark):
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "k", 1), (None, URLS[4], "k", 1)], "page_id long, url string, rule string, part int")
    got = U.judge(pages.select("page_id", "url", "rule", "part"), local_table(spark, U.FIXED_RULES, ["host", "path", "verdict"]))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *brute(u, U.FIXED_RULES)) for i, u in [*enumerate(URLS), (3, URLS[3]), (None, URLS[4])]]
    assert rows_of(got) == sorted(want, key=repr)


def test_random_rules_in_small_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    host = lambda: ".".join(rnd.choices("abc", k=rnd.randrange(0, 4)))
    path = lambda: "".join(rnd.choices(["/", "a", "b", "/a/"], k=rnd.randrange(0, 5)))
    rules = sorted({(host(), path()): rnd.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}/{path()}" for _ in range(400)] + ["http://a.b/a/a"] * 800  # one url holds most rows
    stacks = U.rule_stacks
    monkeypatch.setattr(U, "rule_stacks", lambda r: stacks(r, block=4))
    frame = spark.createDataFrame([(*r, 1) for r in rules] + [(None, "/", "block", 1), ("a", None, "block", 1)], "host string, path string, verdict string, key int")
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), frame, default="none")
    assert rows_of(got) == sorted([(i, *brute(u, rules, "none")) for i, u in enumerate(urls)], key=repr)


def test_repeated_rules_and_empty_tables(spark):
    rules = spark.createDataFrame([("a", "/", "allow"), ("A", "/", "block"), ("a", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.a/x")], "page_id long, url string")
    assert rows_of(U.judge(pages, rules)) == [(1, "b.a", "/x", "a/", "block")]
    assert rows_of(U.judge(pages, rules.limit(0))) == [(1, "b.a", "/x", None, "allow")]
    assert rows_of(U.judge(pages.limit(0), rules)) == []
