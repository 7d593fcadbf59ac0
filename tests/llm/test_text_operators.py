"""Operators on texts against plain Python, on odd rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rastrum.llm import bpe, common, components, jaccard, lines, packing, quality, secrets, spans
from rastrum.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_bpe_agrees_with_the_library(spark, documents, odd_rows, tokenizer):
    random.seed(5)
    wild = ["".join(random.choice("abcdethinger  ThE'sÉßΣσςİ½²٣漢\n\t\x1c!?<|endoftext|>".split("<")[0] + " ") for _ in range(200)) for _ in range(100)]
    texts = odd_rows + [(100 + i, t) for i, t in enumerate([*wild, "a<|endoftext|>B<|startoftext|>", "'s 'll'd don't", "a" * 100])]
    docs = documents(texts)
    ids = bpe.encode(docs, TOKENIZER)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert Counter((r[0], tuple(r[1])) for r in ids.collect()) == want
    back = Counter((i, tokenizer.decode(list(x), skip_special_tokens=False)) for i, x in want.elements())
    assert rows_of(bpe.decode(ids, TOKENIZER)) == back
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows_of(bpe.digests(docs, TOKENIZER)) == Counter((i, len(x), sha(" ".join(map(str, x))), sha(tokenizer.decode(list(x), skip_special_tokens=False))) for i, x in want.elements())
    assert bpe.encode(docs.limit(0), TOKENIZER).isEmpty()


def test_automaton_by_hand():
    found = bpe.MergeAutomaton({s: i for i, s in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa"])}, [("b", "c"), ("a", "bc"), ("a", "b"), ("a", "a")])
    label = lambda w: [found.label[i] for i in found.path(map(ord, w))]
    assert label("abc") == ["abc"] and label("ab") == ["ab"] and label("aaa") == ["aa", "a"] and label("abcb") == ["abc", "b"] and label("aab") == ["a", "ab"]


def test_new_words_go_through_the_automaton_side_by_side(tokenizer, monkeypatch):
    random.seed(8)
    texts = ["".join(random.choice("abcdethinger  ThE'sÉßΣσς½²漢\u0301\u0085\n!?<|>") for _ in range(300)) + " <|endoftext|>x<|startoftext|> " + "y" * 60 for _ in range(60)]
    for name, value in {"WORDS": 40, "PIECES": 30, "ABREAST": 7, "TEXTS": 4}.items():
        monkeypatch.setattr(bpe.Encoder, name, value, raising=False)
    with open(TOKENIZER, encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    alone, calls = enc.automaton.path, []
    monkeypatch.setattr(enc.automaton, "path", lambda symbols: calls.append(symbols) or alone(symbols))
    monkeypatch.setattr(bpe.MergeAutomaton, "STATES", 500)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    found = list(enc.packed(t.encode() for t in [*texts, "", *texts]))
    assert [memoryview(x).cast("I").tolist() for x in found] == [*want, [], *want]
    assert [x for x, _ in enc.spelled(t.encode() for t in texts)] == [" ".join(map(str, w)) for w in want]
    assert all(len(x) > enc.LONGEST for x in calls) and enc.automaton.bits == 16
    assert all(len(x) <= enc.LONGEST for m in (enc.pieces, enc.words) for x in m if x not in m.passing)


def test_what_a_worker_remembers_is_small():
    with open(TOKENIZER, encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    tracemalloc.start()
    try:
        for _ in enc.packed(" ".join(map(str, range(k, k + 500))).encode() for k in range(0, 900_000, 500)):
            pass
        assert tracemalloc.get_traced_memory()[0] < 40e6
    finally:
        tracemalloc.stop()


def test_table_of_transitions_widens():
    found = bpe.MergeAutomaton({s: i for i, s in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa"])}, [("b", "c"), ("a", "bc"), ("a", "b"), ("a", "a")])
    words = ["".join(random.Random(k).choices("abc", k=9)) for k in range(50)]
    want = [found.path(map(ord, w)) for w in words]
    found.bits = 1
    found._open()
    found.filled = 0
    assert [found.path(map(ord, w)) for w in words] == want and found.bits > 4
    assert 2 * found.filled <= len(found.keys) == len(found.values) == 1 << found.bits


def test_line_dedup(spark, documents, odd_rows):
    docs = documents(odd_rows)
    split = [(i, (t or "").split("\n")) for i, t in odd_rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, ls in split:
        for x in ls:
            holders[key(x)].add(i)
    common = {k: max(h - {None}) for k, h in holders.items() if len(k) >= 40 and len(h - {None}) >= 5}
    want = Counter()
    for i, ls in split:
        kept = [x for x in ls if key(x) not in common or common[key(x)] == i]
        want[i, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    out = lines.dedup_lines(docs)
    assert rows_of(out.select("doc_id", "n_lines", "n_dropped", "text")) == want
    assert set(docs.columns) <= set(out.columns) and lines.dedup_lines(docs.limit(0)).isEmpty()


def removed_words(texts, window):
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def test_substring_dedup(spark, documents, odd_rows, monkeypatch):
    monkeypatch.setattr(spans, "SHARD", 3)  # several shards, and anchors with several parts
    random.seed(2)
    base = [random.choice("abcdefgh") + str(random.randrange(40)) for _ in range(300)]
    near = []
    for k in range(25):
        copy = list(base)
        for _ in range(4):
            copy[random.randrange(len(copy))] = f"edit{random.randrange(9)}"
        near.append((1000 + k, " ".join(copy[random.randrange(30) : random.randrange(200, 300)])))
    texts = odd_rows + near
    assert rows_of(spans.dedup_spans(documents(texts), 35)) == Counter(removed_words(texts, 35))
    assert spans.dedup_spans(documents(texts).limit(0), 35).isEmpty()


def test_suffix_automaton_counts():
    random.seed(4)
    for _ in range(40):
        runs = [[random.choice("abc") for _ in range(random.randrange(1, 30))] for _ in range(6)]
        a = spans.SuffixAutomaton()
        for r in runs:
            a.add(r, 1)
        a.close()
        for n in (1, 2, 4):
            want = Counter(tuple(r[k : k + n]) for r in runs for k in range(len(r) - n + 1))
            for r in runs:
                assert a.counts(r, n) == [want[tuple(r[k : k + n])] for k in range(len(r) - n + 1)]


def test_join_with_few(spark, monkeypatch):
    """A partner of rows that is too large to broadcast sends a bitmap, which loses none."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    rows = spark.range(5000).selectExpr("id", "'t' || id AS text")
    right = spark.range(0, 9000, 7).selectExpr("id", "-id AS other").union(spark.sql("SELECT 14L, 1L"))
    joined = common.few_join(rows, right, "id")
    want = [(k, f"t{k}", -k) for k in range(0, 5000, 7)]
    assert sorted(map(tuple, joined.collect())) == sorted([*want, (14, "t14", 1)])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_rs_map" in plan and "BROADCAST" in plan.upper()


def component_rows(texts):
    sets, parent = [], {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    known = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, s) in enumerate(known):
        for j, u in known[:x]:
            if 100 * len(s & u) >= 80 * len(s | u):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("limits", [{}, {"CELL_NODES": 6, "PIVOTS": 4, "WHOLE_REGION": 5}, {"CELL_SHINGLES": 900}])
def test_jaccard_join(spark, documents, odd_rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    random.seed(9)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    near = []
    for k in range(40):  # a chain: each a few edits away from the one before
        if k % 10 == 0:
            base = [f"w{random.randrange(500)}" for _ in range(120)]
        for _ in range(3):
            base[random.randrange(len(base))] = f"e{random.randrange(99)}"
        near.append((1000 + k, " ".join(base)))
    texts = odd_rows + near + [(2000 + k, near[7][1]) for k in range(5)]
    docs = documents(texts)
    want = component_rows(texts)
    assert rows_of(jaccard.near_duplicates(docs)) == want
    stays = jaccard.keep_first(docs)
    assert stays.columns == docs.columns
    assert Counter(r.doc_id for r in stays.collect()) == Counter(i for i, _, c in want.elements() if i is None or i == c)
    assert jaccard.near_duplicates(docs.limit(0)).isEmpty()


def test_components_of_long_paths(spark, monkeypatch):
    """A path whose least node is at the wrong end, a random graph, and few rounds for both."""
    rounds = []
    for name in {"cut", "written"} & set(vars(components)):
        monkeypatch.setattr(components, name, lambda df, f=getattr(components, name): rounds.append(1) or f(df))
    random.seed(3)
    path = [0, *range(18, 0, -1)]
    links = [*zip(path, path[1:]), *((random.randrange(100, 160), random.randrange(100, 160)) for _ in range(45)), (7, 7)]
    parent = {x: x for link in links for x in link}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for x, y in links:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.comp) for r in found.collect()} == {(x, find(x)) for x, y in {*links, *(k[::-1] for k in links)} if x != y}
    assert len(rounds) <= 10


def base_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark, documents, odd_rows):
    random.seed(3)
    key = lambda alphabet, n: "".join(random.choice(alphabet) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    told = [
        (300, f"x AKIA{key(base64[:26], 16)} AKIAAKIA1 Password: abcdefgh secret='short' token=\"{key(base64, 40)}\""),
        (301, " café " + "api_key = abc.def-ghi " * 700), (302, "a1" * 40 + " " + "0123456789abcdef" * 3), (303, f"TOKEN=={key('0123456789abcdef', 40)}"),
        (304, "verylongwordsofordinarytextwithoutanyspace " * 3),
        *[(400 + k, f"see {key(base64, 48)} here") for k in range(30)],
    ]
    texts = odd_rows + told
    docs = documents(texts)
    found = secrets.scan_report(docs)
    got = Counter((r.doc_id, tuple((s.start, s.kind_no, s.end) for s in r.spans if s.kind_no < 3)) for r in found.collect())
    assert got == Counter((i, tuple(base_spans(t or ""))) for i, t in texts)
    random_spans = {r.doc_id for r in found.collect() if any(s.kind_no == 3 for s in r.spans)}
    assert len(random_spans & set(range(400, 430))) >= 27 and not random_spans & {9, 10, 302, 304}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert after[304] == dict(told)[304] and after[1] is None and "[SECRET]" in after[303] and after[301].count("[SECRET]") == 700
    assert secrets.scan_report(docs.limit(0)).isEmpty() and secrets.redact(docs.limit(0)).isEmpty()


def test_packing(spark, documents, odd_rows, tokenizer, monkeypatch):
    import struct
    import zlib

    texts = odd_rows + [(500 + k, "word and " * (k % 700)) for k in range(150)]
    docs = documents(texts)
    rows = packing.pack(packing.pieces(docs, TOKENIZER, 512), 512, group=60).collect()
    want = Counter()
    total = 0
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[i, p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.05 * total / 512 + 4
    assert packing.pack(packing.pieces(docs.limit(0), TOKENIZER, 512), 512).isEmpty()


def test_local_search_beats_best_fit():
    lengths = [6] * 4 + [5] * 4 + [4] * 4 + [3] * 4 + [2] * 6
    assert sorted(x for b in packing.fill_bins(lengths, 14) for x in b) == sorted(lengths)
    assert len(packing.fill_bins(lengths, 14)) == -(-sum(lengths) // 14)


def stats_of(text):
    words = WORD.findall(text or "")
    held = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    twice = set()
    for k in range(len(words) - 7):
        if seen[tuple(words[k : k + 8])] > 1:
            twice.update(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(twice)


def test_quality(spark, documents, odd_rows):
    random.seed(8)
    vocabulary = [f"{a}{b}" for a in ("the", "of", "in", "on", "re") for b in ("er", "ing", "ed", "s", "")]
    plain = [(600 + k, "\n".join(" ".join(random.choices(vocabulary, k=random.randrange(5, 20))) for _ in range(random.randrange(8, 20)))) for k in range(400)]
    junk = [(2000 + k, " ".join(w + "$$$" for w in random.choices(vocabulary, k=120))) for k in range(8)]
    texts = odd_rows + plain + junk
    docs = documents(texts)
    out = quality.quality_report(docs).collect()
    want = Counter((i, *(s := stats_of(t)), s[0] < 20 or 100 * s[4] > 30 * s[0]) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    kept = {r.doc_id for r in out if r.kept}
    assert {i for i, _ in plain} <= kept and not kept & {i for i, _ in junk} and not any(r.kept and r.base_failed for r in out)
    stays = quality.keep_good(docs)
    assert stays.columns == docs.columns and {r.doc_id for r in stays.collect()} == kept
    assert quality.quality_report(docs.limit(0)).isEmpty()


def test_quality_cutoff_is_a_quantile():
    assert abs(quality.chi2_cutoff(0.01) - 15.0863) < 1e-3 and abs(quality.chi2_cutoff(0.001) - 20.5150) < 1e-3
    assert quality.CUTOFF == quality.chi2_cutoff(quality.ERROR)


def test_quality_rejects_menus(spark, documents):
    random.seed(9)
    syllables = ("the", "of", "in", "on", "re", "er", "ing", "ed", "s", "an")
    vocabulary = [a + b + c for a in syllables for b in syllables for c in syllables]
    plain = [(3 * k + 1, "\n".join(" ".join(random.choices(vocabulary, k=random.randrange(5, 20))) for _ in range(random.randrange(4, 40)))) for k in range(300)]
    menus = [(3 * k + 1, " | ".join(" ".join(random.choices(vocabulary, k=2)) for _ in range(random.randrange(20, 100)))) for k in range(1000, 1015)]
    out = {r.doc_id: r for r in quality.quality_report(documents(plain + menus)).collect()}
    assert all(out[i].kept for i, _ in plain)
    assert not any(out[i].base_failed or out[i].kept for i, _ in menus)
    assert min(out[i].distance2 for i, _ in menus) < 100


def test_local_search_works_on_large_groups():
    random.seed(1)
    lengths = [random.randint(600, 760) for _ in range(3000)]
    bins = packing.fill_bins(lengths, 2048)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 2048
    assert len(bins) <= 1.05 * sum(lengths) / 2048


def test_local_search_leaves_no_exchange():
    random.seed(2)
    for _ in range(40):
        bins = packing.fill_bins([random.randint(1, 60) for _ in range(60)], 100)
        under = [b for b in bins if sum(b) < 100]
        for i, b in enumerate(under):
            for j, other in enumerate(under):
                if i == j or sum(other) < sum(b):
                    continue
                room = 100 - sum(other)
                given = [*b, *(x + y for k, x in enumerate(b) for y in b[k + 1 :])]
                assert not any(t < g <= t + room for g in given for t in other) and min(b) > room
