"""Operators without SQL, value by value against plain definitions on small inputs."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest

from conftest import SF001
from ordersight.llm import resampling, secrets, url_filters
from ordersight.llm.bpe import VOCABULARY, encoding

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def brute_tree(counts: dict, p: url_filters.TreeParams) -> dict:
    """(host, shape) -> (template, purity), node by node."""
    out, leaves = {}, defaultdict(list)

    def grow(host, template, rows, prior):  # rows: (shape, rest, bad, good)
        while all(r[1] for r in rows) and len({r[1][0] for r in rows}) == 1:
            template = template + (rows[0][1][0],)
            rows = [(s, rest[1:], b, g) for s, rest, b, g in rows]
        children = defaultdict(list)
        for row in rows:
            if row[1]:
                children[row[1][0]].append(row)
            else:
                leaves[host, template].append((row, prior))
        tb, tg = sum(r[2] for r in rows), sum(r[3] for r in rows)
        below = (tb + p.strength * prior) / (tb + tg + p.strength) if tb + tg else prior
        named = defaultdict(list)
        for child, part in children.items():
            b, g = sum(r[2] for r in part), sum(r[3] for r in part)
            n, m, pooled = b + g, tb + tg - b - g, (tb + 1) / (tb + tg + 2)
            if len(children) > p.max_children and child != "**":
                name = "*"
            elif min(n, m) >= max(1, p.min_labelled) and abs(b / n - (tb - b) / m) < p.z * math.sqrt(
                pooled * (1 - pooled) * (1 / n + 1 / m)
            ):
                name = "~"
            else:
                name = child
            named[name] += [(s, rest[1:], bad, good) for s, rest, bad, good in part]
        for name, part in named.items():
            grow(host, template + (name,), part, below)

    for host in {h for h, _ in counts}:
        grow(host, (), [(s, s, b, g) for (h, s), (b, g) in sorted(counts.items()) if h == host], p.prior)
    for (host, template), rows in leaves.items():
        b, g, prior = sum(r[2] for r, _ in rows), sum(r[3] for r, _ in rows), max(q for _, q in rows)
        for (shape, *_), _ in rows:
            out[host, shape] = ("/" + "/".join(template), round((b + p.strength * prior) / (b + g + p.strength), 6))
    return out


def segment(s: str) -> str:
    extension = re.search(r"(\.[A-Za-z]{1,5}[0-9]?)$", s)
    extension = extension.group(1) if extension else ""
    stem = s[: len(s) - len(extension)]
    if re.fullmatch("[0-9]+", stem) or re.fullmatch("[0-9A-Fa-f-]{8,}", stem) or len(re.findall("[0-9]", stem)) >= 3:
        return "*" + extension
    return s


@pytest.mark.parametrize("max_children", [3, 20])
def test_url_templates(spark, max_children):
    rng = random.Random(max_children)
    urls, labelled = [None, "no scheme", "http://a.org", "http://a.org/", "http://a.org//x"], []
    for k in range(240):
        host = rng.choice(["a.org", "b.org", "sub.example.com", "x.net"])
        parts = [rng.choice(["en", "es", "fr", "buy", "x", str(rng.randint(1, 9999))]) for _ in range(rng.randint(0, 6))]
        urls.append(f"http://{host}/" + "/".join(parts) + rng.choice(["", "?q=/1", ".html"]))
        if k % 3 == 0:
            labelled.append((urls[-1], int("buy" in parts or rng.random() < 0.2)))
    urls += urls[:20]  # repeated rows
    params = url_filters.TreeParams(max_children=max_children, min_labelled=2)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge_urls(
        df, RULES, params=params, labelled_urls=spark.createDataFrame(labelled, "url string, bad int")
    ).collect()

    def parsed(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [
            (len(text), text, decision)
            for decision, text in RULES
            if (host == text.split("/")[0] or host.endswith("." + text.split("/")[0])) and path.startswith(text[text.index("/") :])
        ]
        return host, path, max(fits)[1:] if fits else (None, None), tuple(segment(s) for s in re.sub("^/", "", path).split("/"))

    counts = defaultdict(lambda: [0, 0])
    for url in urls:
        host, _, (_, decision), shape = parsed(url)
        counts[host, shape][0] += decision == "block"
        counts[host, shape][1] += decision == "allow"
    for url, bad in labelled:
        host, _, _, shape = parsed(url)
        counts[host, shape][1 - bad] += 1
    tree = brute_tree({k: tuple(v) for k, v in counts.items()}, params)
    assert len(got) == len(urls)
    for row in got:
        host, path, (rule, decision), shape = parsed(urls[row.page_id])
        template, purity = tree[host, shape]
        assert (row.host, row.path, row.rule, row.template) == (host, path, rule, template)
        assert abs(row.purity - purity) < 2e-6
        assert row.verdict == (decision or ("block" if row.purity > params.max_bad else "allow"))


def test_long_paths_without_branches_take_one_round(spark):
    def seconds(depth):
        urls = ["http://a.org/" + "/".join(["s"] * depth + [end]) for end in ("left/x", "right/y")]
        start = time.monotonic()
        got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), []).collect()
        assert {r.template for r in got} == {u[len("http://a.org") :] for u in urls}
        return time.monotonic() - start

    seconds(5)
    assert seconds(200) < 3 * seconds(5) + 2


def test_resampling_weights_and_cut(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 30]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(60, None), (61, "")] + rows[:15]  # rows that tie, at any cut among them
    labels = [(i, int(i % 3 == 0), int(i % 12 == 0)) for i in range(0, 45)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, key double")
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    target = {i for i, quality, toxic in labels if quality and not toxic}
    raw, good = Counter(), Counter()
    for i, text in rows:
        grams = resampling.buckets_of(text or "", 256).tolist()
        raw.update(grams)
        if i in target:
            good.update(grams)
    raw, good = ([c[b] + 1.0 for b in range(256)] for c in (raw, good))
    ratio = [math.log(g / sum(good)) - math.log(r / sum(raw)) for g, r in zip(good, raw)]
    for share in (0.1, 0.35, 0.9):
        got = resampling.resample(df, ldf, keep_share=share, buckets=256).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        text = dict(rows)
        for r in got:
            grams = resampling.buckets_of(text[r.doc_id] or "", 256)
            assert r.n_grams == len(grams) and abs(r.log_weight - sum(ratio[g] for g in grams.tolist())) < 1e-9
        cut = sorted((r.key for r in got), reverse=True)[round(share * len(rows)) - 1]
        assert all(r.kept == (r.key >= cut) for r in got)


def brute_secrets(text: str, enc) -> list:
    spans = []
    for kind, pattern, least, flags in (
        ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, re.I | re.A),
        ("access", "(AKIA[A-Z0-9]+)", 18, 0),
        ("hex", "([0-9a-f]+)", 16, 0),
    ):
        spans += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m.group(1)) >= least]
    base = list(spans)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        run, core = m.group(), m.group().strip("=-_+/")
        digest = len(core) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", core)
        uuid = re.fullmatch("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", core)
        if len(run) < 20 or digest or uuid or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            continue
        if any(s < m.end() and m.start() < e for s, _, e, _ in base):
            continue
        if len(run) < 2.2 * len(enc.encode_ordinary(run)):
            spans.append((m.start(), 3, m.end(), "random"))
    return sorted(spans)


def test_secrets_on_whole_texts(spark):
    enc = encoding(VOCABULARY)
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    docs = pd.read_parquet(f"{SF001}/documents.parquet", columns=["doc_id", "text"])
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)] + [(-1, None), (-2, ""), (-2, "é token: abcdefghijkl")]
    keys = {}
    for k in range(200):  # random keys in clean texts
        key = "".join(rng.choice(letters) for _ in range(rng.randint(24, 48)))
        keys[-10 - k] = key
        rows.append((-10 - k, f"the {k} of {key} and so on"))
    rows += [(-1000 - k, f"see internationalization-of-{k}-documents or docs/chapter_{k}/introduction") for k in range(50)]
    got = secrets.summary(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    want = Counter()
    for i, text in rows:
        spans = brute_secrets(text or "", enc)
        written = lambda some: ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in some)
        base = [s for s in spans if s[3] != "random"]
        count = Counter(s[3] for s in spans)
        digest = hashlib.sha256(written(base).encode()).hexdigest()
        want[i, count["assign"], count["access"], count["hex"], digest, written(spans)] += 1
    found = got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert Counter(tuple(r) for r in found) == want
    caught = [r for r in found if r.doc_id in keys and r.spans]
    clean = [r for r in found if r.doc_id <= -1000 and r.spans]
    assert len(caught) >= 0.95 * len(keys) and not clean, (len(caught), len(clean))
