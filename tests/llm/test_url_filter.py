import math
import random
import re
from collections import defaultdict

import pytest

from claimloom.llm import url_filter as U
from claimloom.llm.queries import RULES

SCHEMA = "page_id bigint, url string, html string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def named(segment):
    return "=" + segment if segment[0] in "*=" else segment


def plain_node(rows, level, prefix, s):
    """Templates of the paths of a node, level by level until one splits it."""
    while True:
        here = [r for r in rows if len(r[3]) > level]
        for r in rows:
            if len(r[3]) <= level:
                r[5] = prefix
        if not here:
            return
        marks = [r[4] for r in here if r[4] is not None]
        share = (sum(marks) + 0.5) / (len(marks) + 1)
        children = defaultdict(list)
        for r in here:
            children[r[3][level]].append(r)

        def apart(got, share):
            return bool(got) and abs(sum(got) - len(got) * share) > s.apart * math.sqrt(len(got) * share * (1 - share))

        labelled = {k: [r[4] for r in own if r[4] is not None] for k, own in children.items()}
        out = {k: sum(labelled[k]) > len(labelled[k]) * share for k in children if apart(labelled[k], share)}
        if out:
            branches = defaultdict(list)
            for above in (True, False):
                groups = []
                for k in sorted((k for k in out if out[k] == above), key=lambda k: (sum(labelled[k]) / len(labelled[k]), k)):
                    if groups:
                        (b, n), (c, m) = ((sum(labelled[j]), len(labelled[j])) for j in (k, groups[-1][-1]))
                        both = (b + c + 0.5) / (n + m + 1)
                        if abs(b / n - c / m) <= s.apart * math.sqrt(both * (1 - both) * (1 / n + 1 / m)):
                            groups[-1].append(k)
                            continue
                    groups.append([k])
                for i, group in enumerate(groups, 1):
                    name = f"*{'+' if above else '-'}{i}" if len(group) > 1 else named(group[0])
                    for k in group:
                        branches[name] += children[k]
            for k in children:
                if k not in out:
                    branches["*"] += children[k]
            for name, own in branches.items():
                plain_node(own, level + 1, f"{prefix}/{name}", s)
            return
        prefix += "/" + (named(next(iter(children))) if len(children) == 1 else "*")
        rows, level = here, level + 1


def plain_filter(pages, labels, rules, s=U.TreeSettings()):
    """The tree built node by node, from the root."""
    bad = {}
    for i, b in labels:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, 0), b)
    rows = []
    for page, url, _ in pages:
        host, path = plain_parts(url)
        segments = [x for x in re.sub("[0-9]+", "#", path).split("/") if x]
        rows.append([page, host, path, segments, bad.get(page), ""])
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[1]].append(r)
    for own in hosts.values():
        plain_node(own, 0, "", s)
    marks = [r[4] for r in rows if r[4] is not None]
    total = (sum(marks) + 0.5) / (len(marks) + 1)
    host_marks, kind_marks = defaultdict(list), defaultdict(list)
    for r in rows:
        for into, key in ((host_marks, r[1]), (kind_marks, (r[1], r[5]))):
            into[key] += [r[4]] if r[4] is not None else []
    out = []
    for page, host, path, _, _, template in rows:
        h, k = host_marks[host], kind_marks[host, template]
        prior = (sum(h) + s.prior * total) / (len(h) + s.prior)
        purity = (sum(k) + s.prior * prior) / (len(k) + s.prior)
        rule = plain_rule(host, path, rules)
        verdict = rule.verdict if rule else "block" if purity >= s.reject else "allow"
        out.append((page, host, path, rule.text if rule else None, verdict, template, pytest.approx(purity)))
    return sorted(out, key=lambda r: repr(r[:6]))


def check(spark, pages, labels, settings=U.TreeSettings()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pages, SCHEMA).withColumns({"host": F.lit("x"), "segments": F.lit("y"), "id": F.lit("z")})
    marks = spark.createDataFrame(labels, "id bigint, bad int").withColumn("n", F.lit("clash"))
    found = U.filter_urls(df, marks, RULES, settings)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: repr(r[:6]))
    assert got == plain_filter(pages, labels, RULES, settings)
    return got


def test_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.COM", "http://Example.com/en/1?x=/y#z", "https://www.example.com/en/9",
        "https://notexample.com/en/1", "x://a.net/es/", "x://net/fr/q", "x://a.net/es", "x://h?://b/c", "x://h#/p", "a://b://c/d",
        "x://é.org/ü/1/2/3/4/5/6/7/8/9", "x://a.www.example.com/en/x.html", "//a.net/es/", "x://a.org//double//1", "x://a.org/\nline",
    ]
    pages = [(k, u, "h") for k, u in enumerate(urls)] + [(0, None, None), (None, "http://a.org/1", None), (5, urls[5], "h")]
    check(spark, pages, [(0, 1), (0, 0), (None, 1), (3, None), (15, 1)])


def test_templates_that_are_rejected(spark):
    rng = random.Random(6)
    pages, labels = [], []
    for k in range(1500):
        host = rng.choice(["hot.org"] * 6 + ["a.org", "b.net", "c.example.com"])
        section = rng.choice(["spam", "news", "wiki", *[f"user{c}" for c in "abcdefghijklmnop"]])
        pages.append((k, f"https://{host}/en/{section}/{rng.randrange(10**6)}{rng.choice(['', '.html', '/'])}", ""))
        if rng.random() < 0.5:
            labels.append((k, int(rng.random() < (0.95 if section == "spam" else 0.05))))
    got = check(spark, pages, labels)
    hot = {r[5]: r[4] for r in got if r[1] == "hot.org"}
    assert hot["/en/spam/*"] == "block" and hot["/en/*/*"] == "allow"


def test_small_bad_section_of_a_large_host(spark):
    rng = random.Random(8)
    sizes = {"spam": 0.01, "scam": 0.04, **{f"user{c}{d}": 0.95 / 28 for c in "abcdefg" for d in "wxyz"}}
    pages, labels = [], []
    for k, section in enumerate(rng.choices(list(sizes), sizes.values(), k=6000)):
        pages.append((k, f"https://big.org/{section}/{k}", ""))
        if rng.random() < 0.5:
            labels.append((k, int(section in ("spam", "scam") or rng.random() < 0.05)))
    found = U.filter_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(labels, "id bigint, bad int"), RULES)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: repr(r[:6]))
    assert got == plain_filter(pages, labels, RULES)
    assert len({r[2].split("/")[1] for r in got}) == 30
    assert {r[4] for r in got if r[2].startswith(("/spam/", "/scam/"))} == {"block"}
    assert {r[4] for r in got if r[5] == "/*/#"} == {"allow"}


def test_branches_below_the_sixth_segment(spark):
    kinds = ["bad/x", "good/x", "good/y"]
    pages = [(k, f"https://deep.org/a/b/c/d/e/f/{kinds[k % 3]}", "") for k in range(300)]
    labels = [(k, int(k % 3 == 0)) for k in range(0, 300, 2)]
    found = U.filter_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(labels, "id bigint, bad int"), RULES)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: repr(r[:6]))
    assert got == plain_filter(pages, labels, RULES)
    assert {(r[2].split("/")[7], r[4]) for r in got} == {("bad", "block"), ("good", "allow")}


def test_empty_tables(spark):
    assert check(spark, [], []) == []
    check(spark, [(1, "http://a.org/x", "")], [])


def test_alike_bad_sections_are_one_template(spark):
    """Each of two thin bad sections has too little to be rejected alone; a third, half bad, stays apart."""
    pages, labels = [], []
    for section, n, share in (("spam", 6, 1.0), ("scam", 6, 1.0), ("news", 300, 0.02), ("wiki", 300, 0.02), ("half", 200, 0.3)):
        for k in range(n):
            pages.append((len(pages), f"https://big.org/{section}/{'abc'[k % 3]}", ""))
            labels.append((len(labels), int(k < share * n)))
    got = check(spark, pages, labels)
    by_section = {r[2].split("/")[1]: (r[5], r[4]) for r in got}
    assert by_section["spam"] == by_section["scam"] == ("/*+2/*", "block")
    assert by_section["half"] == ("/half/*", "allow")


def test_deep_paths_add_no_rounds(spark, monkeypatch):
    """A path of 2,000 segments, and labelled ones that differ at every level, cost their segments only."""
    written = []
    monkeypatch.setattr(U, "stored", lambda df, name, plain=U.stored: written.append(name) or plain(df, name))
    base = [(k, f"https://trap.org/{'bad' if k % 3 == 0 else 'good'}/x{k % 7}", "") for k in range(200)]
    labels = [(k, int(k % 3 == 0)) for k in range(200)] + [(200 + k, int(k % 3 == 0)) for k in range(20)]
    deep = [(1000, "https://trap.org/" + "/".join(f"s{'ab'[j % 2]}{'x' * (j % 5)}" for j in range(2000)), "")]
    deep += [(200 + k, f"https://trap.org/{'bad' if k % 3 == 0 else 'good'}/" + "/".join(f"{chr(97 + k)}{'y' * (j % 3)}" for j in range(80)), "") for k in range(20)]
    tables = {}
    for name, pages in (("flat", base), ("deep", base + deep)):
        written.clear()
        df = spark.createDataFrame(pages, SCHEMA).coalesce(2)
        found = U.filter_urls(df, spark.createDataFrame(labels, "id bigint, bad int"), RULES)
        got = sorted((tuple(r) for r in found.collect()), key=lambda r: repr(r[:6]))
        assert got == plain_filter(pages, labels, RULES)
        tables[name] = list(written)
    assert tables["deep"] == tables["flat"] and tables["deep"].count("url-splits") == 2


def test_segments_that_look_like_wildcards(spark):
    pages = [(k, f"https://odd.org/{['*', '*+', '=', 'x'][k % 4]}/y", "") for k in range(80)]
    got = check(spark, pages, [(k, int(k % 4 == 0)) for k in range(80)])
    assert {r[5] for r in got} == {"/=*/y", "/*-1/y"}
