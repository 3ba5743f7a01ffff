import random

import pytest

from shelfkin.llm import urls

RULES = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_equals_every_rule_tried(spark, ranges):
    rng = random.Random(ranges)
    labels, paths = ["a", "b", "ab", "c-d", "com", "é", "\U0001f600", "\U0010ffff", "\uffff"], ["/", "/x/", "/x", "/x/y", "", "/y/"]
    name = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(name(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)]
    pages = [(i, rng.choice(["http://", "HTTPS://", "", "x"]) + name().upper() + rng.choice(paths) + rng.choice(["", "?q=/x", "#/x/", "/z"]))
             for i in range(500)]
    pages += [(1000 + i, "http://hot.a.com" + rng.choice(paths)) for i in range(400)]
    pages += [(None, None), (2000, ""), (2001, "://"), (2002, "http://"), (2003, "http://a.com://b"), (2004, "x\ny://A.com/x\n?"), (2004, "http://a.")]
    df = spark.createDataFrame([(i, u, "z") for i, u in pages], "page_id long, url string, rule string")
    got = urls.judge(df, spark.createDataFrame(rules, RULES), "block", ranges).collect()
    want = [(i, *plain(u, rules, "block")) for i, u in pages]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_labels_beyond_the_basic_plane_stay_inside_their_rule(spark):
    """Borders fall inside the interval of ``com``, whose last labels are the last code points."""
    hosts = [f"{chr(0x1F600 + i % 64)}{i}.com" for i in range(300)] + ["\U0010ffff.com", "a.\U0010ffff\U0010ffff.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], RULES)
    assert {r.verdict for r in urls.judge(pages, rules, ranges=8).collect()} == {"block"}


def test_borders_come_from_a_bounded_share(spark):
    keys = spark.range(50_000).selectExpr("cast(id % 3000 as string) AS key")
    found = urls._borders(keys, 50_000, 10, 500)
    assert len(found) == 9 and found == sorted(found)
    assert keys.sample(500 / 50_000, 7).count() < 1000


def test_nothing(spark):
    page = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in urls.judge(page, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert urls.judge(page.limit(0), none).count() == 0
