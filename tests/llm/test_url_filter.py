from quarry.llm import url_filter as U
from quarry.llm.queries import URL_RULES


def _brute(url, rules=URL_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = sorted(((len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
                   if (host == h or host.endswith("." + h)) and path.startswith(p)))
    return (host, path, fits[-1][3], fits[-1][4]) if fits else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.ORG/x?y=/es/",
        "http://example.org/es/1", "http://www.example.org/es/", "http://badexample.org/es/",
        "http://example.org/en/173.html", "http://example.org/en/2", "http://x.com/fr/",
        "http://x.com/fr", "http://com/de/1#top", "http://x.com?/de/", "http://É.com/de/é",
        "http://a..com/de/", "http://com./de/", "ftp://user@example.org:80/es/", "://org/a",
        "http://a.org\n/x", "x://y://org/", "http://" + "sub." * 200 + "org/" + "p" * 20000]


def test_verdicts_equal_brute_force(spark, frame):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(5, URLS[5]), (None, URLS[7])]
    pages = frame(rows, "page_id long, url string", clash=("host", "rule", "digest", "e"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = U.filter_urls(pages, rules).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:4], r[4])
    assert sorted(((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got),
                  key=key) == sorted(((i, h, p, r or "", v) for i, u in rows
                                      for h, p, r, v in [_brute(u)]), key=key)
    assert all(r.digest == "clash" for r in got)


def test_repeated_odd_and_missing_rules(spark, frame):
    pages = frame([(1, "http://a.org/x")], "page_id long, url string")
    make = lambda rows: spark.createDataFrame(
        rows, "host string, path string, verdict string")
    both = make([("org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"),
                 ("", "", "block"), ("org", None, "allow")])
    assert U.filter_urls(pages, both).first().verdict == "block"
    none = make([])
    assert U.filter_urls(pages, none).first().verdict == "allow"
    tie = make([("a.org", "", "block"), ("org", "/x", "allow")])
    assert U.filter_urls(pages, tie).first().rule == "a.org"
    assert U.filter_urls(pages.limit(0), both).count() == 0
