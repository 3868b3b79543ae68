"""Url rules, language, quality, mixing, pivots and the pipeline against brute force, with odd rows."""

import base64
import math
import os
import re
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from quern.llm import language, mixing, pivots, quality, url_rules
from quern.llm import text as T
from quern.llm.queries import LEARNED, ORACLES, QUERIES, URL_RULES
from quern.session import table

RULES = [*URL_RULES, ("a.b.com/x/", "allow"), ("b.com/", "block"), ("b.com/x/y", "block"), ("org", "block"), ("ex-a.com/", "block"), ("ex.com/", "allow"), ("b.com/x/", "allow")]
URLS = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/1?x#y", "http://example.com", "http://example.com/EN/", "http://m.example.com/en/", "x://www.example.com/en/?q", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/es", "http://com/", "http://a.b.com/x/yy", "http://q.a.b.com/x/", "http://b.com/x/y/z", "http://x.org", "http://ex-a.com/p", "http://ex.com/p", "http://b.ex.com/p", "http://a.com//en/", "http://u@b.com:80/x", "http://b.com/x/y", "http://b.com/x/y"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(r), len(r.partition("/")[0]), v, r) for r, v in rules for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("parts", [1, 7])
def test_url_rules(spark, monkeypatch, parts):
    monkeypatch.setattr(url_rules, "partitions", lambda _: parts)
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(d, [url_rules.parse_rule(*r) for r in RULES], ["page_id"]).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(URLS)}
    assert url_rules.judge_urls(d.limit(0), [], ["page_id"]).count() == 0
    assert {r.rule for r in url_rules.judge_urls(d, [], ["page_id"]).collect()} == {None}


def test_url_ranges_share_open_rules(spark, monkeypatch):
    """Random nested rules, of which many are open over several ranges; one host has most urls, which several ranges share."""
    monkeypatch.setattr(url_rules, "partitions", lambda _: 9)
    rng = np.random.default_rng(8)
    label = lambda: rng.choice(["a", "b", "c", "a-b", "xn", "com", "net"])
    host = lambda n: ".".join([*(label() for _ in range(int(rng.integers(0, n)))), rng.choice(["com", "net"])])
    path = lambda n: "/" + "".join(rng.choice(["p/", "q", "r/", "é", "p"]) for _ in range(int(rng.integers(0, n))))
    rules = list({(host(3) + path(4), rng.choice(["allow", "block"])) for _ in range(300)})
    urls = [f"http://{host(4)}{path(6)}" for _ in range(600)] + [f"https://hot.a.com{path(6)}" for _ in range(900)] + ["http://hot.a.com/p/q"] * 300
    urls += ["http://a.com/" + "p/" * 100_000, "http://" + "a." * 5000 + "com/p/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table_ = spark.createDataFrame([(*url_rules.parse_rule(r, v)[:2], v) for r, v in rules] + [("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(d, table_, ["page_id"]).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_many_rules_under_one_host(spark):
    """100,000 path rules of one host, which every host below it is held against."""
    rules = [("com", f"/{i:05d}/", "block" if i % 2 else "allow") for i in range(100_000)]
    d = spark.createDataFrame([(i, f"http://h{i % 700}.com/{i * 37 % 120_000:05d}/x") for i in range(20_000)], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_rules.judge_urls(d, rules, ["page_id"]).collect()}
    assert got == {i: f"com/{k:05d}/" if (k := i * 37 % 120_000) < 100_000 else None for i in range(20_000)}


def test_language(spark, sf):
    d = table(spark, sf.replace("0.001", "0.01"), "documents")
    model = language.train(d, LEARNED)
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 .. 34", "fr"), (-4, "a", "en"), (-5, "漢字", "en"), (-6, "the " * 50_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(d.select("doc_id", "text", "lang").unionByName(odd), model).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    assert all(got[i].lang_pred in model.labels for i in (-4, -5, -6)) and got[-6].lang_pred == "en"
    held = [r for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.train(d.limit(0), LEARNED) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def plain_prediction(text, model):
    """Language and score by loops over bytes, with the hash written out in whole numbers."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    fold = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    x, m, total, seen = [*fold, 0, 0, 0], 1 << 32, np.zeros(len(model.labels)), 0
    for width, salt in ((2, 0x2545F491), (3, 0x9E3779B1), (4, 0x85EBCA77)):
        for i in range(max(len(fold) - width + 1, 1)):
            key = sum(x[i + j] << 8 * j for j in range(width))
            h = (key * salt % m ^ (key >> 7) * 0x27D4EB2F % m) * 0x165667B1 % m
            total += model.table[h >> (33 - language.BUCKETS.bit_length())]
            seen += 1
    z = (total / seen + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return model.labels[int(z.argmax())], float((e / e.sum()).max())


def test_language_matches_brute_force(spark, sf):
    """Whole texts in any block: short, long (more than a block), repeated ones, and columns named like the results."""
    d = table(spark, sf, "documents")
    model = language.train(d, LEARNED)
    long = "the quick brown fox " * 120_000
    texts = [r.text for r in d.collect()] + [None, "", "7", "é", "ab", "abc d", long]
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate([*texts, texts[0], texts[0]])], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in language.predict(rows, model).collect()}
    for i, t in enumerate(texts):
        want = plain_prediction(t[:200_000] if t == long else t, model)
        if t == long:
            assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-3
        else:
            assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-5, i
    assert {got[i][1:] for i in (0, len(texts), len(texts) + 1)} == {got[0][1:]}


def test_many_languages(spark, monkeypatch):
    """More languages than numbers in an embedding, and than any limit: each is learned, and the wide form predicts the same."""
    rows = [(7 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q " * 6 + f"w{j}", f"l{i:04d}") for i in range(1200) for j in range(2)]
    d = spark.createDataFrame([(*r, 5) for r in rows] + [(None, "no id", "l9999", 5)], "doc_id long, text string, lang string, count int")
    monkeypatch.setattr(language, "EPOCHS", 1)
    model = language.train(d, LEARNED)
    assert len(model.labels) > 1000 and model.table.shape == (language.BUCKETS, language.DIM) and "l9999" not in model.labels
    some = d.where("doc_id < 200 OR doc_id IS NULL")
    got = {r.doc_id: r for r in language.predict(some, model).collect()}
    wide = language.Model(model.labels, model.table @ model.head, model.bias, model.temperature, model.threshold)
    for i, r in {r.doc_id: r for r in language.predict(some, wide).collect()}.items():
        assert (got[i].lang_pred, got[i].accepted) == (r.lang_pred, r.accepted) and abs(got[i].score - r.score) < 1e-6
    few = spark.createDataFrame([r for r in rows if r[2] < "l0040"] * 3, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "EPOCHS", 60)
    learned = language.train(few)
    right = [r.lang_pred == r.lang for r in few.join(language.predict(few, learned).select("doc_id", "lang_pred").distinct(), "doc_id").collect()]
    assert learned.head is not None and sum(right) / len(right) > 0.9


def test_held_out_of_documents_without_an_id(spark, tmp_path):
    spark.createDataFrame([(None, "some words", "en"), (1, "other words", "en"), (4, "mots", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.held_out for r in QUERIES["op4_language_id"](spark, str(tmp_path)).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in (None, 1, 4)}


def test_language_never_sees_held_out_labels(spark, sf):
    d = table(spark, sf, "documents")
    a = language.train(d, LEARNED)
    b = language.train(d.selectExpr("doc_id", "text", f"CASE WHEN {LEARNED} THEN lang ELSE 'xx' END AS lang"), LEARNED)
    assert a.labels == b.labels and np.array_equal(a.table, b.table)


def test_quality(spark, sf):
    d, labels = table(spark, sf.replace("0.001", "0.1"), "documents"), table(spark, sf.replace("0.001", "0.1"), "labels")
    known = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in quality.classify(d, known).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good, bad = [[got[r.doc_id] for r in held if r.quality == q] for q in (1, 0)]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
    kept = quality.keep(d, known)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, k in got.items() if k)


def test_quality_of_odd_rows(spark, sf):
    d = spark.createDataFrame([(1, None, "h", None, 3), (2, "", None, "en", 4), (2, "a b", "h", "en", 5), (None, "x", "h", "en", 6)], "doc_id long, text string, source string, lang string, n long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep(d, none).count() == 4
    assert quality.classify(d.limit(0), none).count() == 0


def prior_weight(m, rates):
    v = float(np.var(rates))
    return min(1e4, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e4


def test_quality_matches_brute_force(spark):
    """Rates without the document itself, and how far they move it, by plain loops; one host holds most rows, some are null."""
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), ("big", "a", "b", None)[min(3, int(rng.exponential(0.5)))], ("en", "fr", None)[i % 3]) for i in range(400)]
    d = spark.createDataFrame(rows, "i int, __logit double, h string, p string")
    prob = {i: 1 / (1 + math.exp(-x)) for i, x, _, _ in rows}
    by = lambda *c: {k: [r[0] for r in rows if tuple(r[j] for j in c) == k] for k in {tuple(r[j] for j in c) for r in rows}}
    hosts, paths = by(2), by(2, 3)
    mean = sum(prob.values()) / len(rows)
    rate = lambda ids: sum(prob[i] for i in ids) / len(ids)
    w0 = prior_weight(mean, [rate(x) for x in hosts.values()])
    spread_ = float(np.mean([np.var([rate(x) for (h, _), x in paths.items() if h == k[0]]) for k in hosts]))
    log_odds = lambda x: math.log(x / (1 - x))
    got = {r.i: r for r in quality.judged(d, quality.materialise(quality.site_rates(d, "h", "p"), "t"), "h", "p").collect()}
    assert len(got) == 400
    for i, x, h, p in rows:
        own, near = hosts[(h,)], paths[h, p]
        whole = (sum(prob[j] for j in own) + w0 * mean) / (len(own) + w0)
        w1 = min(1e4, max(1.0, whole * (1 - whole) / spread_ - 1))
        host = (sum(prob[j] for j in own if j != i) + w0 * mean) / (len(own) - 1 + w0)
        path = (sum(prob[j] for j in near if j != i) + w1 * host) / (len(near) - 1 + w1)
        assert abs(got[i]["__host_rate"] - host) < 1e-9 and abs(got[i]["__path_rate"] - path) < 1e-9
        assert abs(got[i]["__moved"] - (log_odds(path) - log_odds(mean))) < 1e-9


def test_site_weight_has_the_highest_posterior():
    rng = np.random.default_rng(2)
    for true in (0.0, 0.4, 2.0):
        logit, moved = rng.normal(size=4000) * 2, rng.normal(size=4000)
        y = (rng.random(4000) < 1 / (1 + np.exp(-(logit + true * moved)))).astype(float)
        loss = [-np.sum(np.log(np.where(y > 0, p := 1 / (1 + np.exp(-(logit + b * moved))), 1 - p))) + quality.SITE_PRIOR / 2 * (b - quality.SITE_WEIGHT) ** 2 for b in np.arange(0, 1.001, 0.01)]
        assert abs(quality.fit_site_weight(logit, moved, y) - np.argmin(loss) / 100) < 0.011


def test_quality_of_urls(spark):
    """Hosts and first path segments of urls, most of them with one or two documents, against plain loops over the whole result."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        good = bool(rng.random() < 0.5)
        host = ("Big.example" if i % 3 == 0 else f"bad{i % 4}.org" if i % 7 == 0 else f"h{i}.net") if i % 50 else None
        bad_site = host is not None and host.startswith("bad") or i % 3 == 0 and i % 2 == 0
        words = rng.choice(["alpha", "beta", "gamma"] if good and not bad_site else ["buy!", "#1", "|now|", "gamma"], 30)
        rows.append((i, " ".join(words), f"http://{host}{('/en/x?q', '/fr/y#/z', '')[i % 2 if i % 11 else 2]}" if host else (None, "no scheme")[i % 100 // 50], "s", "l", good and not bad_site))
    d = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, url string, source string, host string")
    labels = spark.createDataFrame([(r[0], int(r[5])) for r in rows if r[0] % 4 == 0], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(d, labels, url="url").collect()}

    def levels(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        return host, "/" + path.split("/")[1] if path.startswith("/") else ""

    site = {r[0]: levels(r[2]) for r in rows}
    assert {site[0], site[3], site[6], site[50]} == {("", ""), ("big.example", "/fr"), ("big.example", "/en")}
    prob = {i: r.doc_score for i, r in got.items()}
    hosts, paths = {}, {}
    for i, s in site.items():
        hosts.setdefault(s[0], []).append(i)
        paths.setdefault(s, []).append(i)
    rate = lambda ids: sum(prob[i] for i in ids) / len(ids)
    mean = rate(prob)
    w0 = prior_weight(mean, [rate(x) for x in hosts.values()])
    spread_ = float(np.mean([np.var([rate(x) for (h, _), x in paths.items() if h == k]) for k in hosts]))
    assert sum(len(x) == 1 for x in hosts.values()) > 400
    for i, (h, p) in site.items():
        whole = (sum(prob[j] for j in hosts[h]) + w0 * mean) / (len(hosts[h]) + w0)
        w1 = min(1e4, max(1.0, whole * (1 - whole) / spread_ - 1))
        near = (sum(prob[j] for j in hosts[h] if j != i) + w0 * mean) / (len(hosts[h]) - 1 + w0)
        path = (sum(prob[j] for j in paths[h, p] if j != i) + w1 * near) / (len(paths[h, p]) - 1 + w1)
        assert abs(got[i].host_rate - near) < 1e-4 and abs(got[i].path_rate - path) < 1e-4
        if len(hosts[h]) == 1:  # nothing but the prior is known of it
            assert abs(got[i].host_rate - mean) < 1e-4
    kept = quality.keep(d, labels, url="url")
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_learns_words(spark):
    """Documents alike in all but their words are told apart by these, where no label saw them."""
    rng = np.random.default_rng(4)
    say = lambda good: " ".join(rng.choice([f"{'g' if good and rng.random() < 0.5 else 'b' if rng.random() < 0.5 else 'c'}{i:02d}" for i in range(60)], 120))
    rows = [(i, say(i % 2), "h", "en") for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.classify(d, labels).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(800, 1200)) > 380


def test_quality_of_long_and_clashing_rows(spark):
    d = spark.createDataFrame([(i, ("word " * 400_000 if i == 3 else f"text {i} of words"), "h", "en", 1, 2.0, "n") for i in [*range(20), 5, 5]], "doc_id long, text string, source string, lang string, n int, s double, host string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    kept = quality.keep(d, labels)
    assert kept.columns == d.columns
    want = Counter(r.doc_id for r in quality.classify(d, labels).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want and quality.classify(d, labels).count() == 22
    assert quality.keep(d.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(float(x), f"h{h}", "p") for h, n, x in ((0, 1000, 2.0), (1, 1000, -2.0), (2, 1, -2.0), (3, 500, 2.0)) for _ in range(n)]
    r = {x.host: x for x in quality.site_rates(spark.createDataFrame(rows, "__logit double, h string, p string"), "h", "p").collect()}
    p = 1 / (1 + math.exp(2.0))
    assert abs(r["h1"].host_rate - p) < 0.01 < r["h2"].host_rate - p and r["h2"].path_rate < r["h2"].global_rate


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {chr(97 + i): 1 / (i + 1) for i in range(20)}])
def test_pfair_schedule(weights):
    slots = mixing.shares(weights)
    frame, plan, seen = sum(slots.values()), mixing.schedule(slots), Counter()
    for at, (k, j) in enumerate(plan):
        assert j == seen[k] and j * frame // slots[k] <= at < -(-(j + 1) * frame // slots[k])
        seen[k] += 1
        assert all(abs(seen[s] - (at + 1) * n / frame) < 1 for s, n in slots.items())


def test_mixing(spark):
    d = spark.createDataFrame([(i, ("big" if i % 3 else "small") if i % 50 else None, i) for i in range(600)], "doc_id long, source string, position long")
    rows = mixing.mix(d, block=4).collect()
    assert len(rows) == 600 and len({r.position for r in rows}) == 600
    mixed = sorted((r for r in rows if r.in_mix), key=lambda r: r.position)
    assert [r.position for r in mixed] == list(range(len(mixed))) and len(mixed) > 100
    counts = Counter(r.source for r in rows)
    slots = mixing.shares({k: n**mixing.ALPHA for k, n in counts.items()})
    seen, frame = Counter(), sum(slots.values())
    for at, r in enumerate(mixed[::4]):
        seen[r.source] += 1
        assert all(abs(seen[s] - (at + 1) * n / frame) < 1 for s, n in slots.items())
    taken = mixing.take(d, block=4)
    assert taken.columns == d.columns and [r.doc_id for r in taken.collect()] == [r.doc_id for r in mixed]
    assert mixing.mix(d.limit(0)).count() == 0
    assert {r.in_mix for r in mixing.mix(d, {"big": 1.0}).where("source <> 'big'").collect()} == {False}


@pytest.mark.parametrize("n", [3, 20, 300])
def test_schedule_keeps_exact_weights(n):
    """Less than one block from the target weights over many frames, as long as no source is dry, and no block is lost."""
    rng = np.random.default_rng(n)
    blocks = [40_000, *rng.integers(1000, 1400, n - 1).tolist()]
    w = np.array(blocks, float) ** mixing.ALPHA
    w /= w.sum()
    order = np.concatenate(list(mixing.interleave(blocks, w, chunk=5000)))
    assert np.bincount(order, minlength=n).tolist() == blocks
    for k in range(n):
        upto = int((np.array(blocks) / w).min())
        assert upto > 4 * mixing.FRAME or n == 3
        assert np.abs(np.cumsum(order[:upto] == k) - np.arange(1, upto + 1) * w[k]).max() < 1 + mixing.EPS


def plain_schedule(blocks, weights):
    """Earliest deadline first, slot by slot, from exact fractions of the ideal mix."""
    n, w = len(blocks), [Fraction(x) for x in weights]
    done, now, edge = [Fraction(0)] * n, Fraction(0), [[Fraction(0)] for _ in range(n)]
    while any(d < b for d, b in zip(done, blocks)):  # to the next end of a block of any source
        live = [k for k in range(n) if done[k] < blocks[k]]
        rate = {k: w[k] / sum(w[j] for j in live) for k in live}
        step = min((math.floor(done[k]) + 1 - done[k]) / rate[k] for k in live)
        now += step
        for k in live:
            done[k] += step * rate[k]
            if done[k].denominator == 1:
                edge[k].append(now)
    placed, out = [0] * n, []
    for slot in range(sum(blocks)):
        ready = [(math.ceil(edge[k][j + 1]), edge[k][j + 1], k) for k, j in enumerate(placed) if j < blocks[k] and math.floor(edge[k][j]) <= slot]
        k = min(ready)[2]
        assert slot < math.ceil(edge[k][placed[k] + 1])
        placed[k] += 1
        out.append(k)
    return out


@pytest.mark.parametrize("blocks,weights", [([40, 30, 3], [3, 2, 1]), ([7, 7, 7], [1, 1, 1]), ([60, 1], [1, 5]), ([25, 9, 13, 2, 1], [8, 4, 2, 1, 1]), ([5], [2]), ([0, 4], [1, 1])])
def test_schedule_matches_brute_force(blocks, weights):
    assert np.concatenate([*mixing.interleave(blocks, weights, chunk=7), np.zeros(0, int)]).tolist() == plain_schedule(blocks, weights)


def test_mixing_places_blocks_as_the_plain_schedule(spark):
    """Blocks stand in the plain schedule's order; inside, a block's rows have consecutive positions."""
    counts, weights = {"a": 90, "b": 47, None: 5}, {"a": 3.0, "b": 2.0, None: 1.0}
    d = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))], "doc_id long, source string")
    rows = sorted(mixing.mix(d, weights, block=4).collect(), key=lambda r: r.position)
    names = sorted(counts, key=str)
    order = [names[k] for k in plain_schedule([-(-counts[k] // 4) for k in names], [int(weights[k]) for k in names])]
    seen, want = Counter(), []
    for slot, k in enumerate(order):
        size = min(4, counts[k] - 4 * seen[k])
        want += [(k, seen[k], slot)] * size
        seen[k] += 1
    assert [(r.source, r.block, r.slot) for r in rows] == want and [r.position for r in rows] == list(range(142))


def test_mixing_keeps_every_row(spark):
    """A source of one document, null ids and repeated ids cost no row; each row has a place of its own."""
    rows = [(i, "big" if i % 10 else "small", i) for i in range(900)]
    rows += [(5000, "rare", 5000)] + [(None, "big", 6000 + i) for i in range(40)] + [(7, "big", 7000 + i) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n long")
    taken = mixing.take(d, whole=True).collect()
    assert sorted(r.n for r in taken) == sorted(n for _, _, n in rows)
    mixed = mixing.mix(d).collect()
    assert sorted(r.position for r in mixed) == list(range(len(rows)))
    assert [r.doc_id for r in sorted(mixed, key=lambda r: r.position)] == [r.doc_id for r in taken]
    weighted = mixing.mix(d, {"big": 3.0, "small": 1.0})
    places = {(r.source, r.position) for r in weighted.where("in_mix").collect()}
    held = mixing.take(d, {"big": 3.0, "small": 1.0}).collect()
    assert len(held) == len(places) and sum(r.doc_id is None for r in held) == weighted.where("in_mix AND doc_id IS NULL").count()
    assert mixing.take(d, {"big": 3.0, "small": 1.0}, whole=True).count() == len(rows)


def test_pipeline_mixing_drops_nothing(spark, sf):
    import corpus_pipeline

    d = table(spark, sf, "documents").limit(100)
    stage = dict(corpus_pipeline.STAGES)["mixing_sources"]
    assert sorted(r.doc_id for r in stage(spark, d, sf).collect()) == sorted(r.doc_id for r in d.collect())


def test_pipeline_ends_in_mixed_order(spark, tmp_path):
    """Files of a mixed table are read again in any order, the larger ones first; the last stage puts their rows in order."""
    import corpus_pipeline

    rows = [(i, f"word {i} " * (1 + i % 7 * (i % 90)), "en", f"s{i % 11 % 4}", 0, i) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _metadata int").repartition(3)
    mixed = corpus_pipeline.mixing_sources(spark, docs, "")
    want = [r.doc_id for r in mixed.collect()]
    assert want != sorted(want)
    mixed.write.parquet(f"{tmp_path}/mixed")
    back = spark.read.parquet(f"file://{tmp_path}/mixed")
    assert [r.doc_id for r in back.collect()] != want
    out = corpus_pipeline.byte_level_bpe(spark, back, "")
    assert out.columns == [*docs.columns, "token_ids"] and [r.doc_id for r in out.collect()] == want
    out.write.parquet(f"{tmp_path}/out")
    names = sorted(f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet"))
    assert [i for f in names for i in pq.read_table(tmp_path / "out" / f)["doc_id"].to_pylist()] == want
    plain = spark.createDataFrame(rows[:50], docs.schema)  # not read from files
    assert [r.doc_id for r in corpus_pipeline.byte_level_bpe(spark, plain, "").collect()] == list(range(50))


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    out = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.12, 0.2)]
    out += [base[0] * k for k in (1, 2, 0.5)] + [base[1]] * 40
    return [[float(v) for v in x] for x in out] + [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, None] + [0.0] * 14, [1.0, 2.0], [2.0, 4.0], []]


@pytest.mark.parametrize("block", [1024, 16])
def test_pivots(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "TILE", block // 2)
    vs = vectors()
    ids = [5 * i + 3 for i in range(len(vs))]
    d = spark.createDataFrame(list(zip(ids, vs, [0] * len(vs))), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivots.near_duplicates(d).collect()}
    ok = [i for i, v in enumerate(vs) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(vs))}
    for i in ok:
        for j in ok:
            if i < j and len(vs[i]) == len(vs[j]):
                a, b = np.array(vs[i]), np.array(vs[j])
                c = a @ b / np.sqrt((a @ a) * (b @ b))
                if c >= 0.9:
                    links[i].add(j)
                    links[j].add(i)
    want = sum(map(len, links.values()))
    have = sum(r.n_links for r in got.values())
    assert 0.97 * want <= have <= want and all(got[ids[i]].n_links <= len(links[i]) for i in range(len(vs)))
    for i in range(len(vs)):
        if not links[i]:
            assert got[ids[i]].n_links == 0 and got[ids[i]].component_id == ids[i] and got[ids[i]].kept
    same = [got[i] for i, v in zip(ids, vs) if v == vs[4]]
    assert len({r.component_id for r in same}) == 1 and len(same) > 40
    assert pivots.near_duplicates(d.limit(0)).count() == 0


def test_pivots_of_ragged_vectors(spark, monkeypatch):
    """Many lengths go through few jobs, and vectors link within their length as they do alone."""
    rng = np.random.default_rng(3)
    rows = []
    for n in range(3, 33):
        base = rng.normal(size=(12, n))
        rows += [x.tolist() for x in base] + [(x * 3).tolist() for x in base[:4]] + [(x + rng.normal(size=n) * 0.02).tolist() for x in base[:6]]
    d = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(pivots, "_sample", lambda own, lengths, f=pivots._sample: seen.append(len(lengths)) or f(own, lengths))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(d).collect()}
    assert seen == [30] and [len(x) for x in pivots._batches([(8 * k, 10) for k in range(1000, 30_000, 500)])] > [1]
    for n in range(3, 33):
        own = [(i, np.array(x)) for i, x in enumerate(rows) if len(x) == n]
        x = np.array([v / np.linalg.norm(v) for _, v in own])
        want = (x @ x.T >= 0.9).sum(1) - 1
        have = np.array([got[i][0] for i, _ in own])
        assert (have <= want).all() and have.sum() >= 0.95 * want.sum()


def at_cosine(rng, x, c):
    """A vector whose cosine with the unit vector x is c."""
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)


def test_pivots_of_odd_rows(spark):
    """Columns named like the results, rows repeated under one vec_id, one vec_id with two vectors, null ids."""
    v, u = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (2, [2.0, 0.0, 0.41]), (3, u), (3, v), (None, v), (4, None), (9, [0.0] * 3)]
    d = spark.createDataFrame([(i, x, 7, 7, True) for i, x in rows], "vec_id long, embedding array<double>, n_links int, component_id int, kept boolean")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 3, 1, True)] * 2 + [(2, 3, 1, False)] + [(3, 3, 1, False)] * 2 + [(-1, 0, None, False), (4, 0, 4, True), (9, 0, 9, True)], key=str)


def test_pivot_recall_near_the_limit(spark):
    """5,600 vectors: pairs of cosine 0.88 to 0.92 and at 0.9 itself, a hot group, and the rest apart; no false link."""
    rng = np.random.default_rng(17)
    base = rng.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = [at_cosine(rng, x, c) for x, c in zip(base, [*rng.uniform(0.88, 0.92, 1100), *[0.9] * 100])]
    centre = base[-1]
    hot = [at_cosine(rng, centre, c) for c in rng.uniform(0.94, 0.97, 400)]
    x = np.concatenate([base, near, hot])
    x = x * rng.uniform(0.5, 2, (len(x), 1))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    np.fill_diagonal(cosine, 0)
    want, at_most = (cosine >= 0.9).sum(1), (cosine >= 0.9 - 1e-12).sum(1)
    got = np.array([r.n_links for r in pivots.near_duplicates(d).orderBy("vec_id").collect()])
    assert (got <= at_most).all() and got.sum() >= 0.95 * want.sum()
    pairs = (want > 0) & (np.arange(len(x)) >= 4000) & (np.arange(len(x)) < 5200)
    assert pairs.sum() > 500 and np.minimum(got, want)[pairs].sum() >= 0.95 * want[pairs].sum()


def test_queries_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf)
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), name


def plain_features(text, ratios):
    """The classifier's numbers for one text, word by word."""
    data = (text or "").encode()
    words = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    n, lines = len(words), data.split(b"\n")
    part = [sum(data.count(bytes([c])) for c in s) / max(1, len(data)) for s in quality._SETS]
    part += [sum(a == b for a, b in zip(words, words[1:])) / max(1, n), 1 - len(set(words)) / max(1, n) if n else 1.0, min(40, sum(map(len, words)) / max(1, n)) / 40]
    part += [sum(w[-1:] in b"#*$%&!|" for w in words) / max(1, n), 1 - len(set(lines)) / len(lines), min(1, len(lines) / 200), float(n < 50)]
    h = [int(T.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0]) for w in words]
    shift = 65 - quality.GRAMS.bit_length()
    pair = [int(T.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, h[1:])]
    evidence = sum(ratios[x >> shift] for x in h + pair) / max(1, 2 * n - 1)
    return [*part, *(max(0, x) ** 0.5 for x in part), math.log1p(n) / 10, evidence]


def plain_quality(rows, model, weight):
    """doc_id of the rows kept, from plain features and rates by loops."""
    logit = {i: float(model.logit(np.array([plain_features(r.text, model.ratios)]))[0]) for i, r in enumerate(rows)}
    prob = {i: 1 / (1 + math.exp(-x)) for i, x in logit.items()}
    mean = sum(prob.values()) / len(rows)
    hosts, paths = {}, {}
    for i, r in enumerate(rows):
        hosts.setdefault(r.source, []).append(i)
        paths.setdefault((r.source, r.lang), []).append(i)
    rate = lambda ids: sum(prob[i] for i in ids) / len(ids)
    w0 = prior_weight(mean, [rate(x) for x in hosts.values()])
    spread_ = float(np.mean([np.var([rate(x) for (h, _), x in paths.items() if h == k]) for k in hosts]))
    kept = []
    for i, r in enumerate(rows):
        own, near = hosts[r.source], paths[r.source, r.lang]
        whole = (sum(prob[j] for j in own) + w0 * mean) / (len(own) + w0)
        w1 = min(1e4, max(1.0, whole * (1 - whole) / spread_ - 1)) if spread_ > 0 else 1e4
        host = (sum(prob[j] for j in own if j != i) + w0 * mean) / (len(own) - 1 + w0)
        path = (sum(prob[j] for j in near if j != i) + w1 * host) / (len(near) - 1 + w1)
        moved = math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        if 1 / (1 + math.exp(-(logit[i] + weight * moved))) >= 0.5:
            kept.append(r.doc_id)
    return kept


def test_features_match_plain_code(spark, sf):
    ratios = np.random.default_rng(0).normal(size=quality.GRAMS)
    texts = [r.text for r in table(spark, sf, "documents").limit(60).collect()] + [None, "", "A b A b", "x\n\nx", "é " * 70]
    got = quality.features(pa.array(texts, pa.string()), ratios)
    assert np.allclose(got, [plain_features(t, ratios) for t in texts], atol=1e-5)
    total = np.zeros(quality.GRAMS)
    for x in quality.word_counts(pa.array(texts, pa.string())):
        assert abs(x.sum() - (x.sum() > 0)) < 1e-9
        total += x
    assert total.sum() > 60


def test_pipeline(spark, sf):
    """Each stage against the plain reading of its own input."""
    import corpus_pipeline

    from test_text_ops import groups, measures

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "mixing_sources", "byte_level_bpe"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        assert after <= set(before) and len(after) == len(rows)
        assert docs.columns == (columns if k < 4 else [*columns, "token_ids"])
        if name == "quality_classifier":
            labels = table(spark, sf, "labels")
            model, known = quality.train(quality.labelled(table(spark, sf, "documents"), labels, "source", "lang"))
            _, _, weight = quality._fitted(table(spark, sf, "documents"), labels, "source", "lang")
            assert sorted(after) == sorted(plain_quality(list(before.values()), model, weight))
            bad = {r.doc_id for r in labels.where("quality = 0").collect()}
            assert not bad & after
        elif name == "quality_rules":
            assert after == {i for i, r in before.items() if not measures(r.text)[5]}
        elif name == "ngram_jaccard_join":
            assert after == {i for i, (_, c) in groups({i: r.text for i, r in before.items()}).items() if i == c}
        elif name == "mixing_sources":
            assert after == set(before)
            n = Counter(r.source for r in before.values())
            names = sorted(n, key=str)
            order = np.concatenate(list(mixing.interleave([-(-n[k] // mixing.BLOCK) for k in names], [n[k] ** mixing.ALPHA for k in names]))).tolist()
            seen, want = Counter(), []
            for k in (names[x] for x in order):
                want += [k] * min(mixing.BLOCK, n[k] - mixing.BLOCK * seen[k])
                seen[k] += 1
            assert [r.source for r in rows] == want
        elif name == "byte_level_bpe":
            import public_tokenizers as P

            with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
            ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert after == set(before) and all(r.token_ids == ref.encode_ordinary(r.text or "") for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert sys.modules["corpus_pipeline"].run(spark, sf).count() == len(rows)


def test_pipeline_of_odd_rows_and_of_nothing(spark, sf, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and a column more; then empty tables."""
    import corpus_pipeline

    good = [r.text for r in table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 1) for i, t in enumerate(good)]
    rows += [(100, None, "en", "s1", 0, 2), (101, "", None, None, 0, 3), (None, good[0] + " and more " * 3, None, "s1", None, 4), (None, good[1], "en", None, None, 5)]
    rows += [(2, good[2], "en", "s2", len(good[2]), 6), (102, "long words here " * 60_000, "en", "s1", 0, 7)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, block int"
    for name, part in (("some", rows), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(part, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(10)] if part else [], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "token_ids"]
        left = out.collect()
        # labels of one class reject nothing; texts without words fail the rules, as does one that repeats itself; of the rows of document 2 one stays
        gone = {measures_failed(r) for r in left}
        assert gone <= {False} and len({(r.doc_id, r.text) for r in left}) == len(left)
        if part:
            assert {r.doc_id for r in left} >= {0, 2, None} and not {100, 101, 102} & {r.doc_id for r in left} and sum(r.doc_id is None for r in left) == 2


def measures_failed(r):
    from test_text_ops import measures

    return measures(r.text)[5]
