import random

from sojourn.llm import urls

SCHEMA = "page_id long, url string, html string, rule string, host string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    path = rest[cut:]
    end = min([i for i, c in enumerate(path) if c in "?#"] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_parsing_and_rules(spark):
    odd = [None, "", "x", "http://", "http://EXAMPLE.com", "http://example.com/", "https://a.EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "http://www.example.com/EN/", "http://a.www.example.com/en/1", "ftp://b.net/es/", "http://net/fr/a#b", "http://xnet/fr/", "a://b://c.com/d", "http://example.com?x=/en/", "http://ÉX.com/é", "http://h\nx.com/\n?a", "http://example.com/en", "x" * 50_000 + "://com/"]
    rows = [(i, u, "h", "r", "z") for i, u in enumerate(odd)] + [(1, odd[5], "", "", ""), (None, odd[10], "", "", "")]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(i, *split(u)) for i, u, *_ in rows}
    assert {(r.page_id, r.host, r.path) for r in got} == by
    for r in got:
        rule, verdict = ruled(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict) and (rule is None) == (r.chance is not None)


def test_trees_on_held_out_urls(spark):
    rnd = random.Random(4)

    def url(bad):
        words = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
        host = f"{words(4)}-{words(3)}{rnd.randint(100, 999)}" if bad else words(8)
        return f"http://{host}.org/{'/'.join(words(3) for _ in range(rnd.randint(3, 6) if bad else rnd.randint(0, 2)))}" + (f"?id={rnd.randint(0, 99999)}&b={rnd.random()}" if bad else "")

    labelled = [(url(b), b) for b in [0, 1] * 300]
    test = [(i, url(i % 2), "", "", "") for i in range(200)]
    got = urls.judge(spark.createDataFrame(test, SCHEMA), labelled=spark.createDataFrame(labelled, "url string, block int"), sample_urls=500).collect()
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got) >= 190


def test_one_label_or_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert urls.judge(empty).collect() == []
    only = spark.createDataFrame([(1, "http://a.org/", "", "", ""), (2, "http://b.net/es/", "", "", "")], SCHEMA)
    assert {r.page_id: r.verdict for r in urls.judge(only).collect()} == {1: "block", 2: "block"}


def test_hot_urls_and_suffixes_outside_the_sample(spark):
    """Copies of hot URLs don't fill the sample, and suffix rates are those of all labelled rows."""
    hot = [("http://hot.com/" + "abcdefghij"[i % 10] * (i + 1), 0) for i in range(40)]
    rare = [(f"http://x{i}.net/es/page{i}.htm", 1) for i in range(20)]
    labelled = spark.createDataFrame(hot * 100 + rare, "url string, block int")
    test = spark.createDataFrame([(1, "http://y.net/es/page77.htm", "", "", ""), (2, "http://hot.com/aaaa", "", "", "")], SCHEMA)
    got = {r.page_id: r for r in urls.judge(test, rules=[], labelled=labelled, sample_urls=60).collect()}
    assert got[1].verdict == "block" and got[2].verdict == "allow"


def test_rates_do_not_depend_on_the_sample(spark, monkeypatch):
    seen = []
    real = urls.with_suffixes
    monkeypatch.setattr(urls, "with_suffixes", lambda rows, suffixes, *more: seen.append({r.suffix: r.suffix_count for r in suffixes.collect()}) or real(rows, suffixes, *more))
    labelled = spark.createDataFrame([(f"http://h{i}.org/{i}.x{i % 30}", i % 2) for i in range(300)], "url string, block int")
    urls.judge(spark.createDataFrame([], SCHEMA), rules=[], labelled=labelled, sample_urls=20)
    assert len(seen[0]) == 30 and {round(v, 6) for v in seen[0].values()} == {2.397895}


def test_labels_of_suffixes_hold_out(spark):
    """Endings that tell the label in nine of ten rows: held-out URLs are judged by them, and a URL's own label gives nothing away."""
    rnd = random.Random(8)
    bad = {"biz": 0.95, "zip": 0.9, "org": 0.05, "edu": 0.1}
    rows = []
    for i in range(3000):
        end = rnd.choice(list(bad))
        rows.append((f"http://h{rnd.randrange(10**6)}.{end}/p{i % 7}", int(rnd.random() < bad[end])))
    labelled = spark.createDataFrame(rows[:2000], "url string, block int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[2000:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], labelled=labelled).collect()}
    right = sum((got[i] == "block") == bool(b) for i, (_, b) in enumerate(rows[2000:]))
    assert right > 850
