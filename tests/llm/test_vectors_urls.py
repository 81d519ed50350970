"""Exact top-k and URL filters over edge cases against plain Python."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from wardline.llm import topk, urls

NAN, INF = float("nan"), float("inf")


def vectors(kind):
    rng = random.Random(7)
    plain = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(130)]
    if kind == "plain":
        return plain
    if kind == "ties":
        return [(i, [float(i % 3), 1.0, -0.5]) for i in range(120)] + [(50, [0.0, 1.0, -0.5])] * 3
    if kind == "broken":
        return plain + [(150, None), (200, [1.0, None, 2.0]), (250, [NAN, 1.0]), (300, [INF, 1.0]), (None, [0.5] * 8),
                        (350, []), (400, [0.25]), (450, [0.1] * 20)]
    if kind == "huge":
        return [(i, [rng.uniform(-1, 1) * 3e7 for _ in range(4)]) for i in range(60)] + [(100, [1e12, -1e12, 1.0, 0.0])]
    return [(50, [1.0, 2.0]), (100, [2.0, 1.0])] if kind == "few" else []


@pytest.mark.parametrize("kind", ["plain", "ties", "broken", "huge", "few", "none"])
def test_top_k(spark, tmp_path, kind):
    rows = vectors(kind)
    schema = "vec_id long, embedding array<double>, rank int, score long, block long, label int"
    path = str(tmp_path / "embeddings")
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema).write.parquet(path)
    table = spark.read.parquet(path)
    got = topk.top_k(table, block_rows=50, query_rows=2)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.top_k(rows))


def test_bounds_keep_the_best(spark):
    rng = np.random.default_rng(3)
    decay = 1.0 / (1 + np.arange(64))[:, None]
    cands, queries = np.floor(256 * rng.normal(size=(64, 3000)) * decay), np.floor(256 * rng.normal(size=(64, 7)) * decay)
    ids = rng.permutation(3000)
    own = np.full(7, -1)
    best = topk.block_top(queries, cands, ids, own, 5)
    full = (queries.T @ cands).astype(int)
    for i in range(7):
        want = sorted(((-full[i, c], ids[c]) for c in range(3000)))[:5]
        assert [(-s, v) for s, v, _ in best[i]] == want


def test_candidates_are_dropped(spark):
    """On the test embeddings most pairs are dropped before the last dimensions, and none of the best."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([topk.quantised(list(r.embedding), 256) for r in rows], dtype=float).T
    ids = np.array([r.vec_id for r in rows])
    at = np.flatnonzero(ids % 50 == 0)
    first = [f[-1][0] for f in topk.block_top(m[:, at], m[:, :1000], ids[:1000], np.where(at < 1000, at, -1), 5)]
    trace = []
    best = topk.block_top(m[:, at], m, ids, at, 5, first, trace=trace)
    full = (m[:, at].T @ m).astype(int)
    for i, q in enumerate(at):
        want = sorted((-full[i, c], ids[c]) for c in range(len(ids)) if c != q)[:5]
        assert [(-s, v) for s, v, _ in best[i]] == want
    pairs = len(at) * len(ids)
    assert all(b <= a for a, b in zip(trace, trace[1:])) and trace[-1] < pairs / 10, [round(t / pairs, 3) for t in trace]


URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://a.NET/x?y#z", "http://anet/x",
    "https://example.net/en/1", "https://m.example.net/en/", "https://example.net/EN/1", "https://example.net/en",
    "http://example.com/de/5", "http://xexample.com/de/5", "http://a.b.org/fr/", "http://org/fr/x", "http://org/frx",
    "http://a.example.net/en/x?://b.net/", "http://adult-x.example.com/en/1", "http://www.spam-farm.example.org/a",
    "http://free-bets.example.org/", "http://notfree-betsx.org/", "http://x.org/setup.EXE", "http://x.org/setup.exe?x=1",
    "http://x.org/wp-login.php", "ftp://user@host:80/path", "http://x.org/" + "a" * 20_000 + "/casino-bonus",
    "http://größe.example.org/casino-bonus", "http://casino.example.org?x", "http://net?x", "http://net#/",
]


def test_url_verdicts(spark):
    rows = [(i, u, "html", 1, 2) for i, u in enumerate(URLS)] + [(3, "http://net/", "", 1, 2)] * 2 + [(None, "http://net/", "", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, verdict int")
    got = Counter(tuple(r) for r in urls.op8_query(pages).collect())
    assert got == Counter((i, *brute.url_verdict(u)) for i, u, *_ in rows)
    assert urls.op8_query(pages.limit(0)).count() == 0


def test_patterns_are_filed_under_their_rarest_token():
    p = urls.Pattern("p", ("common", "rare"), "common.*rare")
    index = urls.PatternIndex([p], {"common": 1000, "rare": 2})
    assert set(index.by_token) == {"rare"}
    assert index.first_match("http://common.rare/") == "p" and index.first_match("http://common/") is None


@pytest.mark.parametrize("p", urls.PATTERNS, ids=lambda p: p.name)
def test_pattern_tokens_stand_in_what_they_match(p):
    """A URL that the expression matches has every listed token as a whole token."""
    import re
    samples = [u.lower() for u in URLS if u] + [f"http://x.org/{'-'.join(p.tokens)}", f"http://{'-'.join(p.tokens)}.x.org/",
                                                f"http://x.org/a.{p.tokens[0]}", f"http://{p.tokens[0]}.x/"]
    for u in samples:
        if re.search(p.regex, u):
            assert set(p.tokens) <= set(re.findall(urls.TOKEN, u)), (p.name, u)


def glued_urls():
    """URLs around each rule's own words: alone, joined in every way, with letters or digits glued on, with rests and ends."""
    forms = {*[f"{a}{x}{b}" for a, b in (("sex", "cams"), ("cheap", "pills"), ("payday", "loans"), ("free", "bets"),
                                        ("spam", "farm"), ("link", "farm")) for x in ("-", "", ".", "_")],
             "ad", "ads", "adv", "ad-s", "casino", "casino-bonus", "casino/bonus", "casino_bonus", "secure.login/verify",
             "secure-bankinglogin.io/verify", "secure.x/login-verify", "wp-login.php", "phpmyadmin"}
    forms |= {t for p in urls.PATTERNS for t in p.tokens}
    for form in sorted(forms):
        for before in ("http://", "http://my", "http://a.", "http://a-", "http://x.io/", "http://x.io/a.", "http://x.io/7"):
            for after in ("", "x", "es", "online", ".io/", ".example.io/banner/", "-x.io", "?a=1", "/", "9.io/verified"):
                yield before + form + after
                yield (before + form + after).upper()


def test_index_finds_what_the_bare_expressions_match():
    """Whichever literal of a rule is the rarest, a URL is blocked if any expression matches it, and by the first one."""
    import re
    literals = sorted({t for p in urls.PATTERNS for t in p.tokens})
    rng = random.Random(5)
    samples, matched = list(glued_urls()), set()
    for _ in range(6):
        index = urls.PatternIndex(urls.PATTERNS, {t: rng.randrange(100) for t in literals})
        for u in samples:
            want = next((p.name for p in urls.PATTERNS if re.search(p.regex, u.lower())), None)
            assert index.first_match(u) == want, u
            matched.add(want)
    assert matched >= {p.name for p in urls.PATTERNS}


def test_glued_words_are_blocked(spark):
    found = ["http://ad.example.io/banner/", "http://sexcams.example.io/", "http://x.io/cheap-pillsonline",
             "http://mypayday-loans.io/", "http://x.io/casino-bonuses", "http://secure-bankinglogin.io/verify"]
    pages = spark.createDataFrame(list(enumerate([*found, "http://shady.io/x", None])), "page_id long, url string")
    got = dict(urls.op8_query(pages).select("page_id", "verdict").collect())
    assert got == {**dict.fromkeys(range(len(found)), "block"), len(found): "allow", len(found) + 1: "allow"}
    assert urls.token_counts(pages)["ad"] == 2
