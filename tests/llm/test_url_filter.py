from __future__ import annotations

import random
import re

from decklattice.llm import url_filter as u
from decklattice.llm.registry import URL_RULES

SCHEMA = "page_id long, url string, host string"


def urls(n=400):
    rng = random.Random(1)
    out = [None, "", "no scheme", "http://", "HTTP://Www.EXAMPLE.Net/en/x?y#z", "a://b://c/d", "x://net", "x://net/", "x://sub.net#f", "x://example.net/en", "x://org/fr/é?", "x://ÄB.org/fr/1", "x://nnet/a", "x://a.example.com/de/\nq"]
    for _ in range(n):
        host = rng.choice(["", "www.", "m."]) + rng.choice(["example", "casino", "blog"]) + rng.choice([".net", ".com", ".org"])
        out.append("http://%s/%s/%d%s" % (host, rng.choice(["en", "de", "fr"]), rng.randint(1, 99), rng.choice(["", "?x=1", "#top"])))
    return out


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(r, v) for r, v in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_hosts_paths_and_fixed_rules(spark):
    rows = [(i // 2, x, "clash") for i, x in enumerate(urls(60))]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = u.judge(frame, spark.createDataFrame([], "url string, bad int"), URL_RULES).collect()
    want = [(i, *brute_rule(x)) for i, x, _ in rows]
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((*w[:4], w[4] or "allow") for w in want)))
    assert u.judge(frame.limit(0), spark.createDataFrame([], "url string, bad int"), URL_RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rows = [(x, int("casino" in x and ("de" in x or i % 3 == 0)) if x else None) for i, x in enumerate(urls())]
    labelled = spark.createDataFrame(rows, "url string, bad int")
    rules = u.mine(labelled, support=0.05, confidence=0.6, lift=1.5).collect()
    split = lambda x: set(re.findall(r"[^\W_]+(?:-[^\W_]+)*", x.lower()))
    sets = [(split(x), b) for x, b in rows if b is not None and split(x)]
    base = sum(b for _, b in sets) / len(sets)
    assert any(list(r["items"]) == ["casino"] or "casino" in r["items"] for r in rules)
    for r in rules:
        own = [b for s, b in sets if set(r["items"]) <= s]
        assert abs(sum(own) / len(own) - r.confidence) < 1e-9 and r.confidence >= max(0.6, 1.5 * base - 1e-9) and sum(own) / len(sets) >= 0.05 - 1e-9
    pages = spark.createDataFrame([(k, sorted(split(x or ""))) for k, x in enumerate(urls(100))], "key long, tokens array<string>")
    got = {r.key: r.confidence for r in u.match(pages, spark.createDataFrame(rules)).collect()}
    want = {k: max(c) for k, x in enumerate(urls(100)) if (c := [r.confidence for r in rules if set(r["items"]) <= split(x or "")])}
    assert got == want


def test_every_labelled_page_counts(spark):
    pages = spark.range(520_000).selectExpr("if(id < 40000, 'casino', 'blog') AS url", "int(id < 26000) AS bad")
    (rule,) = u.mine(pages).collect()
    assert (rule["items"], round(rule.confidence, 9), round(rule.support, 9)) == (["casino"], 0.65, 0.05)


def test_mined_rules_decide_on_the_given_pages(spark):
    """The whole table: labels by the fixed rules, mined rules by brute force over all sets of tokens."""
    from itertools import combinations

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    got = u.judge(pages, u.labelled_by_rules(pages, URL_RULES), URL_RULES).collect()
    split = lambda x: frozenset(t for t in re.split(r"[^\w-]+|_", x.lower()) if t)
    rows = [(r.page_id, split(r.url or ""), *brute_rule(r.url)) for r in pages.collect()]
    known = [(s, v == "block") for _, s, _, _, _, v in rows if s]
    base, least = sum(b for _, b in known) / len(known), u.SUPPORT * len(known) - 1e-9
    seen, level, rules = {}, {frozenset()}, {}
    while level:  # level by level: every set whose bad pages are enough
        level = {s | {t} for s in level for t in {t for x, b in known if b and s <= x for t in x} - s} if len(next(iter(level))) < 4 else set()
        level = {s for s in level if sum(b for x, b in known if s <= x) >= least}
        for s in level:
            own = [b for x, b in known if s <= x]
            seen[s] = sum(own) / len(own)
    for s, c in seen.items():
        if c >= max(u.CONFIDENCE, u.LIFT * base) - 1e-9 and not any(seen[frozenset(p)] >= c - 1e-12 for k in range(1, len(s)) for p in combinations(s, k)):
            rules[s] = c
    assert rules and max(map(len, rules)) < 4
    want = {i: (rule, v or ("block" if any(s <= x for s in rules) else "allow")) for i, x, _, _, rule, v in rows}
    assert {r.page_id: (r.rule, r.verdict) for r in got} == want
    by_method = [r for r in got if r.rule is None and r.mined_rule is not None]
    assert len(by_method) > 50 and all(frozenset(r.mined_rule.split()) in rules and abs(rules[frozenset(r.mined_rule.split())] - r.confidence) < 1e-9 for r in got if r.mined_rule)


def test_many_rules_are_joined_in_parts(spark, monkeypatch):
    rules = spark.createDataFrame([(1, ["a"], 0.9, 0.1), (2, ["a", "b"], 0.9, 0.1), (3, ["c"], 0.95, 0.1)], "rule_id long, items array<string>, confidence double, support double")
    pages = spark.createDataFrame([(k, t) for k, t in enumerate([["a"], ["a", "b"], ["b"], ["a", "c"], []])], "key long, tokens array<string>")
    whole = sorted(map(tuple, u.match(pages, rules).collect()))
    assert whole == [(0, "a", 0.9), (1, "a b", 0.9), (3, "c", 0.95)]
    monkeypatch.setattr(u, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, u.match(pages, rules).collect())) == whole
    assert u.match(pages, rules.limit(0)).count() == 0
