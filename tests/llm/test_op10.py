import re

from primeweft.llm import op10_url_templates as o
from primeweft.llm.op10_url_templates import judge_urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        host, rest = re.match(r"([^/?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        path = re.match(r"[^?#]*", rest)[0]
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://Éx.ORG", "http://ÉX.org/É?x://y", "http://a.org#f/", "http://a.org?/x", "x://A.Example.org/en/12", "x://example.org/en/2", "x://xexample.org/es/", "x://b.com/fr", "x://b.com/fr/", "x://com/de/9", "a://b://c/de/", "x://h/\nq", "x://h/" + "s/" * 40]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)] + [(0, None, "t"), (None, urls[9], "t")], "page_id long, url string, template string")
    got = judge_urls(pages, RULES).collect()
    assert len(got) == len(urls) + 2
    for x in got:
        host, path, rule, verdict = brute(urls[x.page_id] if x.page_id is not None else urls[9])
        assert (x.host, x.path, x.rule) == (host, path, rule)
        assert x.verdict == verdict or (verdict is None and x.verdict in ("allow", "block"))
    assert judge_urls(pages.limit(0), RULES).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://s.net/{'ads' if i % 2 else 'news'}/{i}.html") for i in range(400)] + [(1000 + i, f"http://t.net/en/{i}") for i in range(50)] + [(2000 + i, f"http://t.net/x{i}/a") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(2001, 0)], "page_id long, blocked int")
    got = {x.page_id: x for x in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [], labels=labels).collect()}
    assert got[301].template == "/ads/<n>.html" and got[301].verdict == "block"
    assert got[300].verdict == "allow" and got[1007].template == "/en/<n>" and got[1007].verdict == "allow"
    assert got[2010].template == "/*/a"


def test_branches_without_a_label_go_by_those_around_them(spark):
    rows = [(i, f"http://bad.net/{'abc'[i % 3]}/x/{i}") for i in range(30)] + [(100 + i, f"http://mixed.net/{'abcde'[i % 5]}/{'uv'[i // 5 % 2]}/{i}") for i in range(100)] + [(300 + i, f"http://good.net/{i}") for i in range(60)]
    blocked = {i: 1 for i in range(30) if i % 3 != 2} | {100 + i: int(i % 5 == 0) for i in range(100) if i % 5 < 4 and i // 5 % 2} | {300 + i: 0 for i in range(30)}
    labels = spark.createDataFrame(list(blocked.items()), "page_id long, blocked int")
    got = {x.page_id: x for x in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [], labels=labels).collect()}
    prior = sum(blocked.values()) / len(blocked)
    assert got[2].template == "/c/x/<n>" and got[2].verdict == "block" and abs(got[2].share - (20 + 4 * prior) / 24) < 1e-12
    # /a is apart from /b, /c and /d; /a/u has no label and goes by /a, /e by /b, /c and /d
    host = (10 + 4 * prior) / 44
    a, rest = (10 + 4 * host) / 14, 4 * host / 34
    assert (got[100].template, got[100].verdict) == ("/a/u/<n>", "block") and abs(got[100].share - a) < 1e-12
    assert (got[104].template, got[104].verdict) == ("/e/u/<n>", "allow") and abs(got[104].share - rest) < 1e-12
    assert got[359].verdict == "allow" and abs(got[359].share - 4 * prior / 34) < 1e-12


def test_deep_paths_become_templates(spark, monkeypatch):
    stem = "http://d.net/" + "/".join("abcdefghi")
    rows = [(i, f"{stem}/{i}/end{i % 2}/{i}.html") for i in range(20)] + [(50 + i, f"{stem}/name{i}") for i in range(40)] + [(99, stem)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    both = []
    for local in (0, 100):
        monkeypatch.setattr(o, "LOCAL", local)
        both.append({x.page_id: x.template for x in judge_urls(pages, []).collect()})
    assert both[0] == both[1]
    assert both[0][4] == "/a/b/c/d/e/f/g/h/i/<n>/end0/<n>.html" and both[0][60] == "/a/b/c/d/e/f/g/h/i/*" and both[0][99] == "/a/b/c/d/e/f/g/h/i"
