"""The automaton of URL rules against plain matching, one rule and one URL at a time."""

import random
import re

import numpy as np
import pytest

from ledgerspark.llm import url_rules as u


def pattern(glob):
    """The glob as a regular expression over characters."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return re.compile("".join(out), re.DOTALL)


def parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def brute(url, rules, default=u.DEFAULT):
    host, path = parts(url)
    fits = [r for r in sorted(rules, key=lambda r: -r.rank) if pattern(r.glob).fullmatch(f".{host}{path}")]
    return (host, path, fits[0].name, fits[0].action) if fits else (host, path, None, default)


def texts(strings):
    data = [s.encode() for s in strings]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@pytest.mark.parametrize("states", [3, 64, 65, u.STATES])
def test_random_globs(states):
    r = random.Random(states)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(r.randint(0, n)))
    rules = [u.glob_rule(u.BLOCK, some(["a", "b", ".", "/", "*", "**", "?", "\\*", "\\?", "\\\\"], 7)) for _ in range(150)]
    urls = ["." + some("ab./*?\\", 12) for _ in range(1500)] + ["", ".", "." + "a" * 5000 + "/b"]
    order = sorted(rules, key=lambda x: -x.rank)
    data, offsets = texts(urls)
    got = np.full(len(urls), -1)
    for machine in u.automata(order, states):
        got = np.where(got < 0, machine.first_rule(data, offsets), got)
    compiled = [pattern(x.glob) for x in order]
    assert got.tolist() == [next((k for k, p in enumerate(compiled) if p.fullmatch(x)), -1) for x in urls]
    assert len(set(got.tolist())) > 20


HOSTS = ["com", "example.com", "www.example.com", "EXAMPLE.net", "b.c", "c", "xn--é.org"]
URLS = [
    "http://example.com/en/", "https://WWW.Example.com/en/x?y#z", "http://badexample.com/en/", "http://example.com", "http://com/", "http://com.net/", "http://.com/",
    "http://a.net/x.com/en/", "http://example.com:80/en/", "http://u@example.com/en/", "http://example.com?x=/en/", "http://example.com#/en/", "example.com/en/", "://", "", None,
    "x://y://example.com/en/", "http://EXAMPLE.COM/EN/", "http://a.b.c/en/" + "q" * 9000, "http://" + "w." * 4000 + "example.com/en/", "http://xn--é.org/日本", "http://com/\n?", "http://a\nb.com/",
    "http://İ.com/é/", "http://a.example.net/en", "http://a.example.net/en/",
]


def test_hosts_and_subdomains(spark):
    rules = [u.host_rule(a, h, p) for h in HOSTS for a, p in (("block", "/"), ("allow", "/en/"), ("allow", "/日"), ("block", "/é/*?"))]
    rows = [(k % 40, x, "h", 3) for k, x in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[0], "h", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int").repartition(3)
    for states, default in ((u.STATES, "block"), (40, "allow")):
        got = u.judge(pages, rules, default=default, states=states)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        want = sorted((repr(i), *map(repr, brute(x, rules, default))) for i, x, _, _ in rows)
        assert sorted(tuple(map(repr, x)) for x in got.collect()) == want


def test_ties_and_empty(spark):
    pages = spark.createDataFrame([("p", "http://a.b/c/d")], "page_id string, url string")
    first = [u.host_rule("block", "a.b", "/c"), u.host_rule("allow", "b", "/c/d")]
    assert [r.rank for r in first] == [5, 5] and u.judge(pages, first).first()["rule"] == "a.b/c" and u.judge(pages, first[::-1]).first()["rule"] == "b/c/d"
    assert u.judge(pages, []).first()["verdict"] == "allow" and u.judge(pages.limit(0), first).count() == 0
    with pytest.raises(ValueError):
        u.judge(pages, [u.host_rule("block", "x" * (u.RULE_BYTES + 1))])
