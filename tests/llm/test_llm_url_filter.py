import pickle
import random
import time

from gauntlet.llm.queries import URL_ALLOW, URL_BLOCK
from gauntlet.llm.url_filter import UrlTrie, judge_urls


def brute(host, path, allow, block, default="allow"):
    fits = []
    for action, rules in (("allow", allow), ("block", block)):
        for rule in rules:
            h, s, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(s + p):
                fits.append((h.count("."), len(s + p), action == "block", rule, action))
    return max(fits)[3:] if fits else (None, default)


def test_trie_against_brute_force():
    rng = random.Random(3)
    label, part = ["com", "net", "a", "b", "www", ""], ["", "en", "en/ar", "e", "x/", "en/"]
    rules = sorted({".".join(rng.choice(label[:5]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/"]) + "" for _ in range(25)}
                   | {f"a.com/{rng.choice(part)}" for _ in range(6)} | {f"com/{rng.choice(part)}" for _ in range(6)})
    allow, block = rules[::2], rules[1::2] + rules[:2]
    trie = UrlTrie(allow, block)
    for _ in range(4000):
        host = ".".join(rng.choice(label) for _ in range(rng.randrange(1, 5)))
        path = rng.choice(["", "/", "/en", "/en/", "/en/ar", "/en/arx/y", "/e", "/x/y", "//"])
        assert (trie.match(host, path) or (None, "allow")) == tuple(brute(host, path, allow, block)), (host, path)


def test_urls_nulls_and_clashing_columns(spark):
    urls = ["HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en/1", "http://example.com/EN/", "http://x.net/es/", "https://net",
            "http://com?x", "mailto:x", None, "", "a://b://c/d", "http://É.com/", "http://x.net/es/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, URL_ALLOW, URL_BLOCK).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("example.com", "/EN/", "com/", "allow")
    assert got[3] == got[11] == ("x.net", "/es/", "net/es/", "block")
    assert got[4] == ("net", "", None, "allow") and got[5] == ("com", "", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("b:", "//c/d")
    assert got[10][0] == "É.com"
    assert judge_urls(pages.limit(0), URL_ALLOW, URL_BLOCK).count() == 0


def test_join_equals_trie(spark):
    rng = random.Random(9)
    host = lambda: ".".join(rng.choice(["com", "net", "a", "b", "www", "", "É"]) for _ in range(rng.randrange(1, 5)))
    path = lambda: rng.choice(["", "/", "/en", "/en/", "/en/ar", "/en/arx/y", "/e", "/x/y", "//", "/É/"])
    rules = sorted({host() + path() for _ in range(120)} - {""})
    allow, block = rules[::2], [*rules[1::2], *rules[:6], rules[8].upper()]
    urls = [f"http://{host()}{path()}" for _ in range(600)] + [None, "", "x", "http://", "http:///en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[:50])], "page_id long, url string, rule string")
    one, other = (sorted(map(tuple, judge_urls(pages, allow, block, max_trie_bytes=size).collect())) for size in (1 << 20, 0))
    assert one == other and len(one) == len(urls) + 50 and len({r[3] for r in one}) > 20
    assert judge_urls(pages.limit(0), allow, block, max_trie_bytes=0).count() == 0
    assert {r.verdict for r in judge_urls(pages, [], [], max_trie_bytes=0).collect()} == {"allow"}


def test_packed_trie_of_many_rules():
    rules = [f"h{i % 300}.example.com/section{i}/page{i}" for i in range(50_000)]
    prefixes = [f"com/{i:05d}" for i in range(20_000)]
    trie = UrlTrie(rules, prefixes)
    assert len(pickle.dumps(trie)) < 4 * sum(map(len, rules + prefixes))
    started = time.monotonic()
    for i in range(0, 20_000, 20):
        assert trie.match("x.org.com", f"/{i:05d}x/y") == (f"com/{i:05d}", "block")
    assert time.monotonic() - started < 0.5
    assert trie.match("a.h7.example.com", "/section307/page307/x") == (rules[307], "allow")
