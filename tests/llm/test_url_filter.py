import random

from tablevec.llm.queries import URL_ENTRIES
from tablevec.llm.url_filter import judge_urls

ENTRIES = [
    *URL_ENTRIES, ("block", "a.b.org", ""), ("allow", "a.b.org", "/x/y"), ("block", "a.b.org", "/x/yz/"),
    ("allow", "net", "/"), ("block", "net", "/"), ("block", "", "/empty"),
]


def brute(url, entries):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [
        (h.count(".") + bool(h), len(p), v == "block", v, h + p) for v, h, p in entries
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def test_equals_brute_force(spark):
    rng = random.Random(0)
    hosts = ["org", "Example.ORG", "a.b.org", "x.a.b.org", "b.org", "xexample.org", "com", "q.com", "net", "", "org.", ".org", "org:80", "ÀÉ.org", "a..org"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12/3", "/en/", "/fr/", "/de/x", "/x/y", "/x/yz", "/x/yz/q", "/x/", "//", "/e\nn/1", "/empty"]
    urls = [None, "", "no scheme/org/", "://", "http:/org/", "a://b://org/es/"]
    urls += [f"{rng.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?a=/es/", "#x", "?u=http://com/de/")]
    rows = [(i, u, "page") for i, u in enumerate(urls + urls[:5])] + [(None, "http://org/", None)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), ENTRIES).collect()
    want = [(i, *brute(u, ENTRIES)) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_no_entries(spark):
    df = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    assert judge_urls(df.limit(0), ENTRIES).count() == 0
    assert judge_urls(df, []).collect()[0].verdict == "allow"
