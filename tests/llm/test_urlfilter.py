from hypothesis import given, settings
from hypothesis import strategies as st

from starquilt.llm import urlfilter as u


def brute(url, rules=u.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def index(rules, hash_of=u.digest64, tmp=[0]):
    import tempfile

    d = tempfile.mkdtemp()
    for name, data in zip(("k", "r"), u.DigestIndex.pack(rules, hash_of)):
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    return u.DigestIndex(f"{d}/k", f"{d}/r", hash_of)


URLS = [
    None, "", "no mark", "http://", "http:///en/", "http://NET/x", "http://net", "https://a.Example.NET/en/1?q#f", "https://example.net/EN/1",
    "https://b.example.com/de/", "https://x.org/fr/1#/en/", "https://org/fr/", "https://xorg/fr/", "https://example.net?/en/", "a://b://net/", "http://net:80/", "http://ÉX.net/", "http://.net/", "http://net./",
]


def test_odd_urls():
    assert index(u.RULES).judge(URLS) == [brute(x) for x in URLS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http", ""]), st.lists(st.sampled_from(["net", "example", "com", "org", "X"]), max_size=4), st.sampled_from(["", "/", "/en/a", "/de/", "/fr/?x", "#a/fr/", "/en"]))))
def test_any_urls(parts):
    urls = [f"{s}://{'.'.join(h)}{p}" for s, h, p in parts]
    assert index(u.RULES).judge(urls) == [brute(x) for x in urls]


def test_colliding_digests_do_no_harm():
    assert index(u.RULES, lambda data: 7).judge(URLS) == [brute(x) for x in URLS]
    assert index([]).judge(["http://net/"]) == [("net", "/", None, "allow")]


def test_hosts_of_many_labels_and_rules_of_any_depth():
    import time

    deep = ("." .join(["a"] * 40), "/", "block")
    found = index([*u.RULES, deep, ("", "/x", "block")])
    urls = ["http://" + "a." * 50_000 + "net/x", "http://" + "a." * 39 + "a/", "http://" + "a." * 38 + "a/", "http://" + "." * 3000 + "/", "http:///x"]
    began = time.perf_counter()
    got = found.judge(urls)
    assert time.perf_counter() - began < 1
    assert [g[2] for g in got] == ["net/", deep[0] + "/", None, None, None]


def test_query(spark):
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    got = sorted(u.judge_urls(df).collect())
    assert [tuple(r)[1:] for r in got] == [brute(x) for x in [*URLS, *URLS]]
    assert u.judge_urls(df.limit(0)).count() == 0
