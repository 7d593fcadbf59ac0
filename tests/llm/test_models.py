"""Operators whose results SQL can't state, against plain models of their definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rastrum.llm import jaccard, quality, secrets
from tests_llm_models import component_ids, kept_lines

LOWER = "abcdefghijklmnopqrstuvwxyz"


# Quality: minimum covariance determinant


def bins_of(d):
    return np.floor(16 * np.log2(d + 1e-6)).astype(int)


def distances(v, center, cov):
    d = v - center
    return np.maximum(0, np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov + np.diag(np.square(quality.FLOORS))), d))


def logdet(cov):
    return np.linalg.slogdet(cov + np.diag(np.square(quality.FLOORS)))[1]


def starts_of(v):
    order = np.sort(np.floor(v * 64), axis=0)
    low, mid, high = (order[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.5, 0.75))
    m, s = (mid + 0.5) / 64, np.maximum((high - low) / (1.349 * 64), quality.FLOORS)
    z = (v - m) / s
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    t = np.cov(np.tanh(z), rowvar=False, bias=True)
    t = t / np.maximum(np.sqrt(np.outer(np.diag(t), np.diag(t))), 1e-6)
    scale = np.outer(s, s)
    return [(m, np.diag(s * s)), (m, 5 * scale * (unit.T @ unit) / len(v)), (m, scale * t)]


def step(v, center, cov):
    b = bins_of(distances(v, center, cov))
    values, counts = np.unique(b, return_counts=True)
    before = np.cumsum(counts) - counts
    near = v[np.isin(b, values[before < quality.COVERAGE * len(v)])]
    return near.mean(axis=0), np.cov(near, rowvar=False, bias=True)


def estimates(groups):
    now = {g: starts_of(v) for g, v in groups.items()}
    for number in range(quality.STEPS):
        new = {g: [step(groups[g], *e) for e in s] for g, s in now.items()}
        fall = max(logdet(a[1]) - logdet(b[1]) for g in now for a, b in zip(now[g], new[g], strict=True))
        now = new
        if number and fall < quality.STILL:
            break
    out = {}
    for g, s in now.items():
        center, cov = min(s, key=lambda e: logdet(e[1]))
        d = np.sort(bins_of(distances(groups[g], center, cov)))
        median = 2 ** ((d[math.ceil(0.5 * len(d)) - 1] + 0.5) / 16)
        out[g] = center, cov, quality.CHI2_MEDIAN / max(median, quality.CHI2_MEDIAN)
    return out


def test_quality_agrees_with_a_plain_model(spark):
    rng = random.Random(4)
    words = [a + b for a in ("the", "of", "in", "re", "con", "s") for b in ("er", "ing", "ed", "tion", "", "a")]
    rows = []
    for k in range(900):
        lang, source = rng.choice((("en", "big"), ("en", "big"), ("en", "big"), ("de", "big"), ("de", f"s{k % 9}"), (None, "tiny")))
        if lang is None and k % 10:
            lang = "en"
        ws = rng.choices(words, k=rng.randrange(21, 300))
        if k % 7 == 0:  # more than a tenth is of another kind
            ws = [w + rng.choice(("|", "#", "")) for w in ws]
        rows.append((k, " ".join(ws) if k % 3 else "\n".join(" ".join(ws[i : i + 9]) for i in range(0, len(ws), 9)), lang, source))
    rows += [(5000 + k, "short text", "en", "big") for k in range(5)]
    out = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    base = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out}
    angle = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(b, 1))))
    vector = {i: [math.log(n + 1), math.log((c + 1) / (n + 1)), angle(y, c), math.log(d + 1) / 4, angle(r, n)] for i, (n, c, y, d, r) in base.items()}
    failed = {r.doc_id for r in out if r.base_failed}
    sizes, where = Counter(), {}
    for i, _, lang, source in rows:
        where[i] = [("own", lang, source), ("lang", lang), ("all",)]
        if i not in failed:
            sizes.update(where[i])
    judge = {i: next((k for k in keys if sizes[k] >= quality.MIN_ROWS), None) if sizes[keys[0]] else ("all",) for i, keys in where.items()}
    used = set(judge.values())
    assert {k[0] for k in used} == {"own", "lang", "all"}
    groups = {g: np.array([vector[i] for i, keys in where.items() if g in keys and i not in failed]) for g in used}
    found = estimates(groups)
    for r in out:
        center, cov, scale = found[judge[r.doc_id]]
        d = scale * distances(np.array([vector[r.doc_id]]), center, cov)[0]
        assert r.distance2 == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert r.kept == (r.doc_id not in failed and d <= quality.CUTOFF)


# Secrets: the battery and the rule over all candidates


def log_tail(z):
    return 0.0 if z <= 0 else -(-z * z / 2 - math.log(1.64 * z + math.sqrt(0.76 * z * z + 4))) / 2.302585092994046


def battery(m):
    enc = next((k for k, (p, _) in enumerate(secrets.ENCODINGS) if re.fullmatch(p, m)), len(secrets.ENCODINGS) - 1)
    alphabet = secrets.ENCODINGS[enc][1]
    s = m.lower() if enc in secrets.CASELESS else m
    k, n = len(alphabet), len(m)
    chi2 = k / n * sum(c * c for c in Counter(s).values()) - n
    two, three = secrets.coincidence(alphabet, 2), secrets.coincidence(alphabet, 3)
    text_z = (k + k * (n - 1) * two - n - chi2) / (k / n * math.sqrt(2 * n * (n - 1) * two + 4 * n * (n - 1) * (n - 2) * max(three - two * two, 0)))
    df = k - 1
    uniform_z = (math.cbrt(max(chi2, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    v = [alphabet.find(c) for c in s]
    above = [x > (k - 1) / 2 for x in v]
    expected = 2 * sum(above) * (n - sum(above)) / n + 1
    runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
    runs_z = (runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    mean = sum(v) / n
    serial_z = (sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / max(sum((x - mean) ** 2 for x in v), 1e-9) + 1 / n) * math.sqrt(n)
    kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "+"
    changes = sum(kind(a) != kind(b) for a, b in zip(m, m[1:]))
    change_z = (changes - 0.5 - secrets.CHANGES * (n - 1)) / math.sqrt(secrets.CHANGES * (1 - secrets.CHANGES) * (n - 1))
    digits = log_tail(text_z)
    if enc not in secrets.ONE_KIND:
        both = digits + log_tail(change_z)
        digits = max(0.0, both - math.log10(1 + 2.302585092994046 * both))
    passes = uniform_z <= secrets.GATE and abs(runs_z) <= secrets.GATE and abs(serial_z) <= secrets.GATE
    return enc, math.floor(2 * math.log2(n)), min(math.floor(secrets.BINS_PER_DIGIT * digits), secrets.MAX_BIN) if passes else 0


def tokens_and_runs(seed, alphabets, sizes, each):
    rng = random.Random(seed)
    tokens = {(a, n): ["".join(rng.choice(alphabets[a]) for _ in range(n)) for _ in range(each)] for a in alphabets for n in sizes}
    syllables = "the of and in to re con ing ed er tion ly al is it an on at es or".split()
    words = ["".join(rng.choices(syllables, k=rng.randrange(8, 14))) for _ in range(300)]
    paths = ["/".join("".join(rng.choices(syllables, k=rng.randrange(2, 5))) for _ in range(rng.randrange(3, 6))) for _ in range(300)]
    names = ["".join("".join(rng.choices(syllables, k=rng.randrange(2, 4))).capitalize() for _ in range(rng.randrange(3, 6))) for _ in range(300)]
    return tokens, [x for x in words + paths + names if len(x) >= secrets.MIN_RUN]


ALPHABETS = {"hex": "0123456789abcdef", "base32": LOWER.upper() + "234567", "lower": LOWER + "0123456789", "base62": LOWER + LOWER.upper() + "0123456789", "base64": LOWER + LOWER.upper() + "0123456789+/"}


def test_battery_agrees_with_a_plain_model(spark):
    tokens, ordinary = tokens_and_runs(5, ALPHABETS, (20, 32, 40, 200), 12)
    runs = [x for t in tokens.values() for x in t] + ordinary + ["1234567890" * 3, "a" * 30, "AAAAbbbb" * 5, "-" * 25]
    rows = spark.createDataFrame([(m,) for m in runs], "m string").select("m", secrets.rank_bin(F.col("m")).alias("test"))
    got = {r.m: tuple(r.test) for r in rows.collect()}
    assert got == {m: battery(m) for m in runs}
    found = secrets.least_bins(rows, 0.01)
    strata = defaultdict(list)
    for m in got:
        strata[got[m][:2]].extend([got[m][2]] * runs.count(m))
    want = {}
    for stratum, bins in strata.items():
        fit = [b for b in set(bins) if b > 0 and len(bins) * 10 ** (-b / secrets.BINS_PER_DIGIT) <= 0.01 * sum(x >= b for x in bins)]
        if fit:
            want[stratum] = min(fit)
    assert found == want


def test_single_tokens_are_found_among_ordinary_runs(spark):
    tokens, ordinary = tokens_and_runs(6, {k: ALPHABETS[k] for k in ("base62", "base64")}, (32, 40), 10)
    docs = [(k, f"see {t} there") for k, t in enumerate(x for part in tokens.values() for x in part)] + [(1000 + k, f"a {x} b") for k, x in enumerate(ordinary)]
    out = secrets.scan_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id for r in out if any(s.kind_no == 3 for s in r.spans)}
    assert len([i for i in found if i < 1000]) >= 0.85 * sum(map(len, tokens.values()))
    assert len([i for i in found if i >= 1000]) <= 0.03 * len(ordinary)


# Cells of the Jaccard join


def test_pivots_part_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_NODES", 6)
    rng = random.Random(3)
    rows = []
    for f in range(4):
        base = [f"f{f}w{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(5):
            copy = list(base)
            copy[10 * k] = f"edit{k}"
            rows.append((100 * f + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = jaccard._texts(docs, "doc_id", "text")
    known, _ = jaccard.surveyed(texts)
    nodes = {r.id: (r.node, r.n) for r in known.collect()}
    back = {node: i for i, (node, _) in nodes.items()}
    cell = spark.createDataFrame([(1, node, n, 4) for node, n in nodes.values()], "cell long, node long, n long, parts int")
    ids = spark.createDataFrame([(node, i) for i, (node, _) in nodes.items()], "node long, id long")
    parted, _ = jaccard.by_pivots(cell, lambda w: w.join(ids, "node").join(texts, "id").drop("id"))
    children = defaultdict(set)
    for r in parted.collect():
        children[r.child].add(back[r.node])
    assert max(map(len, children.values())) < len(rows)
    for f in range(4):  # members of a family meet
        for a in range(5):
            for b in range(a):
                assert any({100 * f + a, 100 * f + b} <= c for c in children.values())


# The pipeline


def test_stages_agree_with_plain_models(spark, documents):
    rng = random.Random(11)
    words = [a + b for a in ("the", "of", "in", "re", "con", "s") for b in ("er", "ing", "ed", "tion", "", "a")]
    common = "a line that many of these documents have in common, at some length"
    rows = []
    for k in range(160):
        lines = [" ".join(rng.choices(words, k=rng.randrange(6, 14))) for _ in range(rng.randrange(6, 12))]
        if k % 4 == 0:
            lines.insert(2, common)
        if k % 5 == 0:
            lines.append(f"password = {'x' * 5}{rng.randrange(10**8)} and more")
        rows.append((k, "\n".join(lines)))
    rows += [(300 + k, rows[k][1] + " tail") for k in range(10)] + [(400, rows[3][1]), (401, "too short"), (402, None)]
    docs = documents(rows)
    stages = dict(corpus_pipeline.STAGES)
    held = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    good = stages["quality_rules"](spark, docs, "")
    keep = {r.doc_id for r in quality.quality_report(docs).collect() if r.kept}
    assert held(good) == Counter(x for x in rows if x[0] in keep) and not keep & {401, 402}
    lined = stages["line_dedup"](spark, good, "")
    assert held(lined) == Counter(kept_lines(list(held(good).elements()), 40, 5))
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    apart = stages["near_duplicates"](spark, lined, "")
    texts = list(held(lined).elements())
    assert held(apart) == Counter((i, t) for i, t in texts if component_ids(texts)[i] == i)
    clean = stages["secret_scan"](spark, apart, "")
    want = Counter()
    for r in secrets.scan_report(apart).join(apart.select("doc_id", "text"), "doc_id").collect():
        merged = []
        for x in sorted(r.spans):
            if merged and x.start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x.end)
            else:
                merged.append([x.start, x.end])
        ends = [0, *(e for _, e in merged)]
        want[r.doc_id, "[SECRET]".join(r.text[a:b] for a, b in zip(ends, [*(b for b, _ in merged), len(r.text)], strict=True))] += 1
    assert held(clean) == want and any("[SECRET]" in t for _, t in want)
    packed = stages["best_fit_packing"](spark, clean, "").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want}
