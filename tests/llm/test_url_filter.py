import random
import re

import pytest

from helixframe.llm import url_filter


def by_hand(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules
        if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def urls():
    draw = random.Random(8)
    out = [None, "", "no scheme", "http://", "x://org", "x://ORG/", "x://a.ORG/es/?q#f", "x://example.org/en/12", "x://a.b.example.org/en/1#x",
           "x://notexample.org/en/1", "x://example.org?/en/1", "x://com/fr/", "x://É.COM/de/é", "http://a\nb.com/fr/\nz", "a://b://c.org/", "x://.org/", "x://org./"]
    for _ in range(600):
        host = ".".join(draw.choice(["a", "b", "org", "com", "example"]) for _ in range(draw.randint(1, 5)))
        out.append(f"http://{host}/{draw.choice(['es/', 'en/1', 'fr/', 'de/', ''])}{draw.choice(['', 'x', '1', '?q=/es/'])}")
    return out + ["http://hot.example.org/es/1"] * 400


@pytest.mark.parametrize("rules", [
    url_filter.RULES, [], [("", "", "block")], [(None, "/", "block"), ("org", None, "block"), ("org", "", "allow")],
    [("org", "/en/1", "block"), ("example.org", "/", "allow"), ("a.example.org", "/en", "block"), ("EXAMPLE.org", "/", "block")],
])
def test_against_each_rule_in_turn(spark, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls())], "page_id long, url string, rule string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default="block").collect()
    lowered = [(None if h is None else h.lower(), p, v) for h, p, v in rules]
    assert len(got) == len(urls())
    for row in got:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == by_hand(row["url"], lowered, "block")


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect() == []


def test_many_nested_rules(spark):
    draw = random.Random(9)
    rules = [(".".join(draw.choice("ab") for _ in range(draw.randint(1, 4))), "/" + "".join(draw.choice("xy/") for _ in range(draw.randint(0, 4))), draw.choice(["allow", "block"])) for _ in range(400)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    pages = [(i, "s://" + ".".join(draw.choice("ab") for _ in range(draw.randint(1, 6))) + "/" + "".join(draw.choice("xy/") for _ in range(6))) for i in range(800)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    for row in got.collect():
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == by_hand(row["url"], rules)
