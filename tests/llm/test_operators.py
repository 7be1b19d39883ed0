"""Each operator against a brute-force version on small fixtures."""

import itertools
import random
import re
import time
import tracemalloc
from math import comb

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from larkspur.llm import classify, extraction, mixing, near, packing, pii, repeats, rules, sites, tokens, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


# --- 1 --------------------------------------------------------------------------------------------


def brute_extract(pages, depth):
    seen = {}
    for page, host, text in pages:
        t = text.split()
        for i in range(len(t) - depth + 1):
            seen.setdefault((host, tuple(t[i : i + depth])), set()).add(page)
    out = {}
    for page, host, text in pages:
        t = text.split()
        gone = [False] * len(t)
        for i in range(len(t) - depth + 1):
            if len(seen[host, tuple(t[i : i + depth])]) > 1:
                gone[i : i + depth] = [True] * depth
        runs = [" ".join(w for w, _ in g) for dropped, g in itertools.groupby(zip(t, gone), lambda x: x[1]) if not dropped]
        out[page] = "\n".join(runs)
    return out


@pytest.mark.parametrize("big", [1 << 30, 400])
def test_extraction_matches_brute_force(spark, big):
    rng = random.Random(1)
    menu, foot = prose(rng, 9), prose(rng, 7)
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<p>{menu}</p><script>x = 1</script> {prose(rng, rng.randint(0, 20))} <b>{foot}</b>") for i in range(12)]
    found = extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), min_tokens=5, big_bytes=big).collect()
    wanted = brute_extract([(i, f"h{i % 2}.org", extraction.visible(h)) for i, _, h in pages], 5)
    assert {r.page_id: r.text for r in found} == wanted
    assert any(r.n_removed for r in found)


def brute_blocks(pages, depth):
    """Windows of depth tokens, and whole blocks of any length; a page is a list of blocks."""
    windows, whole = {}, {}
    for page, host, blocks in pages:
        t = " ".join(blocks).split()
        for i in range(len(t) - depth + 1):
            windows.setdefault((host, tuple(t[i : i + depth])), set()).add(page)
        for b in blocks:
            whole.setdefault((host, b), set()).add(page)
    out = {}
    for page, host, blocks in pages:
        t = " ".join(blocks).split()
        gone = [len(whole[host, b]) > 1 for b in blocks for _ in b.split()]
        for i in range(len(t) - depth + 1):
            if len(windows[host, tuple(t[i : i + depth])]) > 1:
                gone[i : i + depth] = [True] * depth
        out[page] = "\n".join(" ".join(w for w, _ in g) for dropped, g in itertools.groupby(zip(t, gone), lambda x: x[1]) if not dropped)
    return out


@pytest.mark.parametrize("big", [1 << 30, 2000])
def test_extraction_removes_short_repeated_blocks_by_default(spark, big):
    rng = random.Random(12)
    menus = {h: ([prose(rng, rng.randint(1, 2)) for _ in range(5)], prose(rng, 8), prose(rng, 11)) for h in ("h0.org", "h1.org")}
    pages, cut = [], []
    for i in range(12):
        host = f"h{i % 2}.org"
        items, ad, foot = menus[host]
        body, more = prose(rng, rng.randint(25, 60)), prose(rng, 6)
        listed = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in items)
        html = f"<nav><ul>{listed}</ul></nav><div class='ad'>{ad}</div><p>{body} <b>{ad}</b> &amp; {more}<br>{more}<footer>{foot}</footer>"
        pages.append((i, f"http://{host}/{i}", html))
        cut.append((i, host, [*items, ad, f"{body} {ad} & {more}", more, foot]))
    found = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), big_bytes=big).collect()}
    assert found == brute_blocks(cut, extraction.MIN_TOKENS)
    for i, _, b in cut:
        assert found[i] == f"{b[6]} {b[7]}"  # only the article is left, an ad's words inside it included


def test_places_of_stretches_take_little_memory(monkeypatch):
    rng = random.Random(7)
    menu = [prose(rng, rng.randint(2, 30)) for _ in range(60)]
    pages = ["".join(f"<p>{x}</p>" for x in menu) + f"<p>{prose(rng, 8)}</p>" for _ in range(2000)]
    packed = [zstandard.compress(extraction.blocks(x).encode()) for x in pages]
    n = range(len(pages))
    columns = {"page_id": pa.array(n, pa.int64()), "host": pa.array(["h" for _ in n]), "row": pa.array(n, pa.int32()), "shards": pa.array([3 for _ in n], pa.int32()), "html": pa.array(pages), "text": pa.array(packed, pa.binary())}
    batches = pa.table(columns).to_batches()

    def found():
        table = pa.Table.from_batches(list(extraction._divide(20)(iter(batches))))
        shards = [extraction._shard(20)(table.filter(pa.array([x == k for x in table["shard"].to_pylist()]))) for k in sorted(set(table["shard"].to_pylist()))]
        return sorted(set(zip(*(pa.concat_tables(shards)[c].to_pylist() for c in ("page_id", "start", "stop")))))

    for b in extraction._divide(20)(iter(batches[:1])):  # tables of powers are made once
        pass
    tracemalloc.start()
    for b in extraction._divide(20)(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 27e6
    whole = found()
    monkeypatch.setattr(extraction, "BATCH_PAGES", 300, raising=False)
    assert found() == whole


# --- 2 --------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    """Spans of (doc, text) rows from windows of whole words, is_first by the least document."""
    held = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            held.setdefault(tuple(w[i : i + length]), set()).add(d)
    out = set()
    for d, t in rows:
        w = words(t)
        for first in (True, False):
            spans = []
            for i in range(len(w) - length + 1):
                docs = held[tuple(w[i : i + length])]
                if len(docs) > 1 and (d == min(docs)) == first:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + length
                    else:
                        spans.append([i, i + length])
            out |= {(d, a, b - a, first) for a, b in spans}
    return out


def tangled(rng):
    """Texts that share passages which begin, end, branch and meet again inside one another."""
    a, b, c, d = (prose(rng, n) for n in (20, 14, 9, 30))
    texts = [f"{a} {b} {c}", f"{a} {c} {b}", f"{b} {c} {d}", f"{prose(rng, 3)} {a} {b} {prose(rng, 2)} {d}", d, f"{d} {d}", f"{a} {a} {a}", "x " * 40, "x " * 30, f"y {'x ' * 25}", "one", "", None]
    for _ in range(25):
        t = rng.choice(texts[:7]).split()
        t[rng.randrange(len(t))] = prose(rng, 1)
        cut = rng.randrange(len(t))
        texts.append(" ".join(t[cut:] if rng.random() < 0.5 else t[:cut]))
    return texts


@pytest.mark.parametrize("m, part_chars", [(3, 1 << 24), (1, 400), (7, 900)])
def test_repeats_match_brute_force(spark, m, part_chars):
    texts = tangled(random.Random(2))
    found = repeats.repeated_spans(docs_of(spark, texts), length=8, m=m, part_chars=part_chars).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.is_first) for r in found} == brute_repeats(list(enumerate(texts)), 8)
    assert len(found) == len({(r.doc_id, r.first_word, r.is_first) for r in found})


def test_repeats_of_fifty_words_by_default(spark):
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (50, 64, 120)]
    texts = [prose(rng, rng.randint(0, 90)) for _ in range(30)]
    for s in shared:
        for i in rng.sample(range(30), 4):
            texts[i] = f"{prose(rng, 7)} {s} {texts[i]}"
    texts += [texts[0], prose(rng, 49), prose(rng, 400)[:1] + texts[1]]
    found = repeats.repeated_spans(docs_of(spark, texts)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.is_first) for r in found} == brute_repeats(list(enumerate(texts)), 50) and found


def test_branches_decide_what_is_one_path(spark):
    """Three documents share u, then two of them v and another two w: without the test for branches
    paths run on from u and stand for different sets of documents."""
    rng = random.Random(4)
    u, v, w = (prose(rng, 12) for _ in range(3))
    texts = [f"{u} {v}", f"{u} {w}", f"{u} {v}", f"{u} {w}"]
    docs = docs_of(spark, texts)
    from pyspark.sql import functions as F

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    path = lambda branching: {(r.doc_id, r.start, r.n) for r in repeats.repeated_paths(keyed, 8, 3, branching=branching).collect()}
    assert path(True) == {(i, 0, 5) for i in range(4)} | {(i, 5, 12) for i in range(4)}
    assert path(False) == {(i, 0, 17) for i in range(4)}
    spans = lambda branching: {(r.doc_id, r.first_word, r.n_words, r.is_first) for r in repeats.repeated_spans(docs, length=8, m=3, branching=branching).collect()}
    assert spans(True) == brute_repeats(list(enumerate(texts)), 8) != spans(False)


# --- 3 --------------------------------------------------------------------------------------------


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    wanted = []
    for name in ("a", "b", "c"):
        lengths = rng.integers(0, 40, 30) if name != "c" else []
        ids = np.concatenate([np.zeros(0, "<u2"), *(np.r_[rng.integers(0, 50256, n), 50256].astype("<u2") for n in lengths)])
        if name == "b":
            ids = np.r_[ids, [1, 2, 3]].astype("<u2")
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
        start = 0
        for i, n in enumerate(lengths):
            wanted.append((name, i, start, int(n), True))
            start += int(n) + 1
        if name == "b":
            wanted.append((name, 30, start, 3, False))
    files = spark.createDataFrame([(str(tmp_path / n),) for n in "abc"], "file string")
    found = tokens.separator_scan(files, block_bytes=32).collect()
    assert sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in found) == sorted(wanted)


def test_token_counts_match_the_encoder():
    texts = ["", None, "hello  world", " a b\n\nc d   e", "x" * 5000, "<|endoftext|> naïve 你好 ünï", "tab\t tab  ", "a 　b"]
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    known = tokens._Known(tokens.TOKENIZER)
    assert tokens.token_counts(pa.array(texts), known).tolist() == [len(encode(t or "")) for t in texts]
    flat = tokens.token_ids(pa.array(texts), known, tokens.SEPARATOR)
    assert flat.tolist() == [t for x in texts for t in [*encode(x or ""), tokens.SEPARATOR]]


def test_tokens_of_joined_pieces_match_the_encoder():
    rng = random.Random(31)
    bits = ["a", "Bc", "12", "1234", "'s", "'", "#", "!!", "é", "中", "\u00a0", "\u3000", "\u2003", "\x1c", " ", " ", " ", " ", "  ", "\n", "\t", "\x00", "ß", "_", "don't", "x" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    known = tokens._Known(tokens.TOKENIZER)
    assert tokens.token_ids(pa.array(texts), known, tokens.SEPARATOR).tolist() == [t for x in texts for t in [*encode(x), tokens.SEPARATOR]]
    with pytest.raises(ValueError):
        tokens.token_ids(pa.array(["a"]), known, 100)


# --- 4 --------------------------------------------------------------------------------------------


def test_binomial_tail_and_choice():
    for n, k, p in ((10, 0, 0.1), (10, 3, 0.3), (50, 20, 0.5), (5, 5, 0.2)):
        assert rules.binomial_tail(n, k, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    counts = {("en", r, c): (5000, 0 if c >= 0.5 else 4000, 100, 90 if c < 1 else 10) for r in ("x", "y") for c in (0.1, 0.5, 2.0)}
    assert rules.choose(counts) == {("en", "x"): 0.5, ("en", "y"): 0.5}
    assert rules.choose({k: (20, *v[1:]) for k, v in counts.items()}) == {}  # too few labels to certify anything


def test_rules_reject_junk_and_keep_the_rest(spark):
    rng = random.Random(4)
    texts = [prose(rng, 60) if i % 4 else "### $$$ %%% &&& " * 9 for i in range(4000)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    assert all(found[i].keep == (i % 4 > 0) for i in range(4000))
    kept = rules.passing(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(4000) if i % 4}


# --- 5 --------------------------------------------------------------------------------------------


def test_classifier_is_accurate_on_held_out_documents_and_shrinks(spark):
    rng = random.Random(5)
    texts = [prose(rng, 30) + (" spam buy" * 3 if i % 2 else "") for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = sites.quality_posteriors(docs, labels).collect()
    assert np.mean([r.keep == (r.doc_id % 2 == 0) for r in found if r.doc_id >= 200]) > 0.95
    assert all(0 < r.p_host < 1 and 0 < r.p_path < 1 for r in found)


def test_site_posteriors_match_brute_force(spark):
    rng = random.Random(51)
    rows = [(i, f"h{rng.randrange(4)}", f"p{rng.randrange(3)}", rng.random()) for i in range(120)]
    truth = {i: rng.choice([0.0, 0.5, 1.0]) for i in range(0, 120, 3)}
    found = {r.doc_id: r for r in sites.site_posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double"), spark.createDataFrame(list(truth.items()), "doc_id long, y double")).collect()}
    n = {i: 1.0 if i in truth else sites.SOFT for i, *_ in rows}
    k = {i: truth.get(i, p) * n[i] for i, _, _, p in rows}

    def sums(key):
        out = {}
        for r in rows:
            a, b = out.get(key(r), (0.0, 0.0))
            out[key(r)] = a + n[r[0]], b + k[r[0]]
        return out

    def strength(groups, mean):
        total, squares = sum(a for a, _ in groups.values()), sum(a * a for a, _ in groups.values())
        spread = sum(a * (b / a - mean[g]) ** 2 for g, (a, b) in groups.items())
        chance = sum(mean[g] * (1 - mean[g]) for g in groups)
        between = (spread - chance) / max(total - squares / total, 1e-9)
        within = sum(a * mean[g] * (1 - mean[g]) for g, (a, _) in groups.items()) / total
        return min(max(within / max(between, 1e-12) - 1 if between > 0 else 1e6, 1.0), 1e6)

    hosts, paths = sums(lambda r: r[1]), sums(lambda r: (r[1], r[2]))
    prior = sum(k.values()) / sum(n.values())
    s = strength(hosts, {h: prior for h in hosts})
    p_host = {h: (b + s * prior) / (a + s) for h, (a, b) in hosts.items()}
    s = strength(paths, {g: p_host[g[0]] for g in paths})
    logit = lambda x: np.log(x / (1 - x))
    for i, h, p, q in rows:
        a, b = paths[h, p]
        p_path = (b - k[i] + s * p_host[h]) / (a - n[i] + s)
        post = 1 / (1 + np.exp(-(logit(min(max(q, 1e-6), 1 - 1e-6)) + logit(p_path) - logit(prior))))
        assert (found[i].p_host, found[i].p_path, found[i].posterior) == pytest.approx((p_host[h], p_path, post))


def test_hosts_and_folders_of_urls(spark):
    from pyspark.sql import functions as F

    urls = ["https://Me@A.org:80/x/y.html?q=/z/", "http://b.org", "http://b.org/", "no url", None]
    found = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select(sites.url_host(F.col("u")), sites.url_folder(F.col("u"))).collect()
    assert [tuple(r) for r in found] == [("a.org", "/x/"), ("b.org", ""), ("b.org", "/"), ("", ""), ("", "")]


# --- 6 --------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 12)) * rng.gamma(1, 2, (300, 1))
    v[7] = v[8]
    v[9] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [rows[3], (None, [1.0]), (400, None), (401, [float("nan")] * 12)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, block_rows=40).collect()
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -np.inf)
    wanted = {(q, int(i), r + 1) for q in range(300) for r, i in enumerate(np.lexsort((np.arange(300), -s[q]))[:5])}
    assert {(r.query_id, r.id, r["rank"]) for r in found} == wanted
    some = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, block_rows=40, every=7).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in some} == {x for x in wanted if x[0] % 7 == 0}


def test_top_k_of_wide_vectors(spark):
    rng = np.random.default_rng(61)
    v = rng.normal(size=(40, 3000))
    found = topk.top_k(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), k=3, block_rows=16).collect()
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    assert {(r.query_id, r.id, r["rank"]) for r in found} == {(q, int(i), k + 1) for q in range(40) for k, i in enumerate(np.argsort(-s[q])[:3])}


# --- 7 --------------------------------------------------------------------------------------------


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([1, 1, 1], 60)
    n = rng.integers(1, 200, 60)
    table = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(60)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    target = np.array([0.6, 0.3, 0.1])
    found = {r.doc_id: r.rate for r in mixing.solve(table, list(target), iterations=200).collect()}
    w = n / n.sum()
    r = np.ones(60)
    for _ in range(20000):  # plain projected gradient
        r = np.maximum(0, r - (p @ (p.T @ (w * r) - target) + mixing.KEEP * (r - 1)))
    got = np.array([found[i] for i in range(60)])
    worth = lambda x: ((p.T @ (w * x) - target) ** 2).sum() / 2 + mixing.KEEP / 2 * (w * (x - 1) ** 2).sum()
    assert worth(got) < worth(r) * 1.01 and worth(got) < worth(np.ones(60)) / 10
    assert np.abs(p.T @ (w * got) - p.T @ (w * r)).max() < 0.01
    residuals = []
    for _ in range(300):  # a weaker pull towards 1 meets the targets more closely
        residuals.append(p.T @ (w * mixing.rates(p, residuals, 1e-5)[1]) - target)
    assert np.abs(p.T @ (w * mixing.rates(p, residuals, 1e-5)[0]) - target).max() < 0.01


@pytest.mark.parametrize("sharp", [0.1, 1.0])
def test_rates_converge_by_default(spark, sharp):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([7 * sharp, 2 * sharp, sharp], 3000)
    n = rng.integers(1, 3000, 3000)
    table = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(3000)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    target = np.array([mixing.TARGETS[d] for d in ("good", "low", "toxic")])
    found = {r.doc_id: r.rate for r in mixing.solve(table, list(target)).collect()}
    got, w = np.array([found[i] for i in range(3000)]), n / n.sum()
    residual = p.T @ (w * got) - target
    assert np.abs(got - np.maximum(0, 1 - p @ residual / mixing.KEEP)).max() < 1e-5  # holds at the optimum only
    assert (got > 0).any()
    with pytest.raises(RuntimeError):
        mixing.solve(table, list(target), iterations=1)


def test_domains_are_a_parameter(spark):
    from pyspark.sql import functions as F

    rng = random.Random(71)
    texts = [prose(rng, 30) + (" spam buy now" * 3 if i % 2 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, "ad" if i % 2 else "text") for i in range(100)], "doc_id long, kind string")
    domains = {"ad": F.col("kind") == "ad", "text": F.col("kind") == "text"}
    found = {r.doc_id: r.rate for r in mixing.mix(docs_of(spark, texts), labels, targets={"text": 0.9, "ad": 0.1}, domains=domains).collect()}
    assert np.mean([found[i] for i in range(0, 200, 2)]) > 1.3 and np.mean([found[i] for i in range(1, 200, 2)]) < 0.6
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark, texts), labels, targets={"text": 1.0}, domains=domains)


# --- 8 --------------------------------------------------------------------------------------------


def test_pii_decoding_is_the_best_division():
    weights = pii.train().tolist()
    for text in ("mail joe@x.org or 10.0.0.1 now", "call (555) 123-4567 v1.2", "4111 1111 1111 1111."):
        t = [m.span() for m in pii._TOKEN.finditer(text)]
        spans = {}
        for i, j in pii.segments(text, t):
            on = pii.features(text, t[i][0], t[j - 1][1], j - i)
            spans[i, j] = max(sum(w[f] for f in on) for w in weights[1:])

        def best(i):
            if i == len(t):
                return 0.0
            return max([weights[0][0] + best(i + 1), *(s + best(b) for (a, b), s in spans.items() if a == i)])

        found = pii.decode(text, weights)
        ends = {(t[i][0], t[j - 1][1]): (i, j) for i, j in spans}
        inside = [ends[a, b] for a, b, _ in found]
        score = sum(spans[x] for x in inside) + weights[0][0] * (len(t) - sum(j - i for i, j in inside))
        assert found and score == pytest.approx(best(0))


def test_pii_held_out_accuracy():
    weights, rng = pii.train().tolist(), random.Random(999)
    right = wanted = made = 0
    for _ in range(400):
        text, gold = pii._generate(rng)
        found = pii.decode(text, weights)
        right += len(set(found) & set(gold))
        wanted, made = wanted + len(gold), made + len(found)
    assert right / wanted > 0.93 and right / made > 0.93


def test_pii_stretches_do_not_change_the_division(monkeypatch):
    weights, rng = pii.train().tolist(), random.Random(77)
    ibans = ["GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78"]
    texts = [f"please pay to {x} until friday" for x in ibans]
    for x, text in zip(ibans, texts):
        assert pii.masked(text, pii.decode(text, weights)) == "please pay to [ID] until friday"
    bits = [*ibans, "ABCD", "(AB)", "x-AB", "AB-x", "A B C D", "12", "a", "joe@x.org", "word", "+1", "WEST", "555 123 4567", "Z" * 5]
    texts += ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", "\u00a0", "  ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += [pii._generate(rng)[0] for _ in range(200)]
    found = [pii.decode(t, weights) for t in texts]
    monkeypatch.setattr(pii, "_stretches", lambda text: [(0, len(text))])
    assert found == [pii.decode(t, weights) for t in texts]


def test_pii_secrets_of_any_length():
    """A long hex key, a token of three parts, a key of letters alone, a block of base64 lines, and 2000
    characters in one run are found as wholes; long paths of pages aren't."""
    weights, rng = pii.train().tolist(), random.Random(81)
    low_up = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    url = low_up + "0123456789-_"
    jwt = f"eyJ{pick(url, 60)}.eyJ{pick(url, 121)}.{pick(url, 42)}x"
    lines = [pick(low_up + "0123456789+/", 63) + "x" for _ in range(4)]
    for before, secret, after in [("k ", pick("0123456789abcdef", 192), " z"), ("token: ", jwt, " end"), ("api_key=", jwt, ""), ("key ", pick(low_up, 40), " ok"), ("", pick(low_up + "0123456789+/", 1999) + "x", "")]:
        assert pii.masked(before + secret + after, pii.decode(before + secret + after, weights)) == f"{before}[SECRET]{after}"
    block = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----"
    assert not any(x in pii.masked(block, pii.decode(block, weights)) for x in lines)
    for text in ("see https://abc.org/2024/05/some-long-path-of-words-and-more-words-3-that-go-on-and-on-for-ever-more.html", "a state-of-the-art-model-with-long-name-7 here"):
        assert pii.decode(text, weights) == []


# --- 9 --------------------------------------------------------------------------------------------


def brute_classes(texts, threshold=0.6):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        if w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    linked = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold} for i in sets}
    out = {}
    for i in sets:
        reached, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        if linked[i]:
            out[i] = (min(reached), len(linked[i]))
    return out


def near_texts(seed, groups=12, most=30):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = prose(rng, rng.randint(3, 60)).split()
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = prose(rng, 1)
            texts.append(" ".join(t))
    return [*texts, "", None, "one", "one"]


#: Nodes of a few sets make buckets reach over many of them; hot = 2 settles n-grams within chunks.
@pytest.mark.parametrize("options", [{}, {"node_bytes": 2000, "part_chars": 3000}, {"hot": 2, "part_chars": 5000}])
def test_jaccard_join_matches_brute_force(spark, options):
    texts = near_texts(9)
    found = near.ngram_jaccard_join(docs_of(spark, texts), **options).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute_classes(texts) and len(found) == len({r.doc_id for r in found})


def test_signature_tree_has_levels_and_loses_no_pair():
    rng = np.random.default_rng(3)
    bases = [rng.choice(5000, rng.integers(20, 60), replace=False) for _ in range(60)]
    sets = [set(np.r_[b[: rng.integers(len(b) // 2, len(b))], rng.choice(5000, 3)].tolist()) for b in bases for _ in range(10)]
    bucket = np.arange(len(sets)) // 10 // 7
    order = np.lexsort(([len(s) for s in sets], bucket))
    sets = [sets[i] for i in order]
    grams = [np.array(sorted(s), np.uint64) for s in sets]
    size = np.array([len(s) for s in sets])
    maps = near._bitmaps(np.repeat(np.arange(len(sets)), size), np.concatenate(grams), len(sets), 1024).view(np.uint64)
    tree = near.SignatureTree(bucket[order], size, size, maps)
    assert len(tree.levels) == 3
    leaves = set(zip(*(x.tolist() for x in tree.pairs(0.6))))
    assert len(leaves) < len(tree.levels[0][0]) * (len(tree.levels[0][0]) + 1) // 4
    for i, j in itertools.combinations(range(len(sets)), 2):
        if bucket[order][i] == bucket[order][j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6:
            assert (i // near.LEAF, j // near.LEAF) in leaves


def test_the_query_builds_trees_of_several_levels(spark, monkeypatch):
    """On as few as 300 documents: the rows of one node are one tree."""
    depths = []
    real = near.SignatureTree.pairs
    monkeypatch.setattr(near.SignatureTree, "pairs", lambda self, t: depths.append(len(self.levels)) or real(self, t))
    texts = near_texts(4, 6, 60)
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        if len(w) > 4:
            sets.setdefault(frozenset(" ".join(w[j : j + 5]) for j in range(len(w) - 4)), i)
    grams = [np.unique(np.array([int.from_bytes(near.mix(np.array([hash(g) & (2**64 - 1)], np.uint64)).tobytes(), "little") for g in s], np.uint64)) for s in sets]
    size = np.array([len(g) for g in grams])
    maps = near._bitmaps(np.repeat(np.arange(len(grams)), size), np.concatenate(grams), len(grams), 1024)
    order = np.argsort(size, kind="stable")
    table = pa.table({"unit": np.zeros(len(grams), np.int64), "bucket": np.zeros(len(grams), np.int64), "sid": np.arange(len(grams)), "size": size[order].astype(np.int32), "m": np.ones(len(grams), np.int64), "side": np.zeros(len(grams), np.int32), "earlier": pa.array([[]] * len(grams), pa.list_(pa.int64())), "grams": pa.array([grams[i].tobytes() for i in order], pa.binary()), "bitmap": pa.array([maps[i].tobytes() for i in order], pa.binary())})
    found = pa.Table.from_batches(near._links(0.6)(iter(table.to_batches())))
    assert max(depths) > 1
    sets = [list(sets)[i] for i in order]
    wanted = {i: sum(len(a & b) / len(a | b) >= 0.6 for b in sets) - 1 for i, a in enumerate(sets)}
    assert dict(zip(found.column("sid").to_pylist(), found.column("links").to_pylist())) == {i: n for i, n in wanted.items() if n}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 9)] + [(20, 21), (30, 20), (20, 21), (5, 5), (None, 3), (4, None)]
    found = {r.node: r.leader for r in near.components(spark.createDataFrame(pairs, "doc_a long, doc_b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 10)}, 20: 20, 21: 20, 30: 20}
    assert near.components(spark.createDataFrame([], "doc_a long, doc_b long")).count() == 0


# --- 10 -------------------------------------------------------------------------------------------


def test_sum_of_squares_packing_matches_brute_force():
    rng = np.random.default_rng(10)
    sizes, capacity = rng.integers(1, 21, 300), 20
    gaps, wanted = [], []
    for size in sizes.tolist():
        options = []
        for place in [*sorted({g for g in gaps if g >= size}), capacity]:
            b = len(gaps) if place == capacity else gaps.index(place)
            after = [*gaps, capacity] if b == len(gaps) else list(gaps)
            after[b] -= size
            counts = np.bincount([g for g in after if g], minlength=capacity + 1)
            options.append((int((counts[1:capacity] ** 2).sum()), b == len(gaps), place, b))
        _, new, place, b = min(options)
        if new:
            gaps.append(capacity)
        wanted.append((b, capacity - gaps[b]))
        gaps[b] -= size
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    fill = np.zeros(bins.max() + 1, int)
    for b, o, s in zip(bins, offsets, sizes):
        assert fill[b] == o
        fill[b] += s
    assert fill.max() <= capacity
    assert offsets.tolist() == [o for _, o in wanted] and len(fill) == len(gaps)


def test_packing_places_every_token_once(spark):
    rows = [(i, n) for i, n in enumerate([5000, 1, 2048, 0, 2047, 4096, 300, 300])]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), shard_tokens=4000).collect()
    for i, n in rows:
        assert sum(r.n_tokens for r in found if r.doc_id == i) == n
    for seq in {r.seq_id for r in found}:
        at = 0
        for r in sorted((r for r in found if r.seq_id == seq), key=lambda r: r.seq_offset):
            assert r.seq_offset == at
            at += r.n_tokens
        assert at <= packing.CAPACITY


def test_training_sample_is_bounded(spark):
    docs = docs_of(spark, ["a b c d"] * 50)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    assert classify.train(docs, labels, F.col("quality"), 2, sample=10).shape == (2, classify.WIDTH)


def test_training_on_long_texts_takes_little_memory_of_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 30_000))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)], "doc_id long, quality int")
    row, feature = classify.text_features(pa.array(texts))
    assert len(feature) > 3_500_000  # 14 MB as the driver gets them, 28 MB for each array of a step's numbers
    docs.count()
    tracemalloc.start()
    monkeypatch.setattr(classify, "CHUNK", 1 << 17, raising=False)
    monkeypatch.setattr(classify, "PART_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(classify.fit, "__defaults__", (3, 1e-3))
    found = classify.train(docs, labels, F.col("quality"), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    docs.unpersist()
    assert peak < 20e6
    monkeypatch.setattr(classify, "CHUNK", 1 << 30)
    place = {x: i for i, x in enumerate(r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect())}
    at = np.searchsorted(row, np.arange(161))
    rows = [feature[at[i] : at[i + 1]] for i in place]
    whole = classify.fit(np.concatenate(rows), np.array([len(x) for x in rows]), np.array([int(i % 3 > 0) for i in place]), 2)
    assert np.allclose(found, whole, atol=1e-7)


def test_few_pairs_of_many_sets_in_one_bucket():
    """Pairs spread over a large bucket cost what they are, not the bucket's sets squared times its n-grams."""
    rng, n, size = np.random.default_rng(3), 6000, 60
    grams = rng.integers(1, 1 << 62, (n, size)).astype(np.uint64)
    grams[n // 2 :, :50] = grams[: n // 2, :50]  # row i and row i + n / 2 are partners: 50 of 70
    grams.sort(axis=1)
    maps = near._bitmaps(np.repeat(np.arange(n), size), grams.ravel(), n, near.BITS)
    rows = {"bucket": [7] * n, "sid": range(n), "size": np.full(n, size, np.int32), "m": [1] * n, "earlier": pa.array([[]] * n, pa.list_(pa.int64())), "unit": [0] * n, "side": [0] * n, "grams": [g.tobytes() for g in grams], "bitmap": [m.tobytes() for m in maps]}
    began = time.process_time()
    found = pa.Table.from_batches(near._links(0.6)(iter(pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in rows.items()}).to_batches())))
    assert time.process_time() - began < 20
    assert found.column("sid").to_pylist() == [*range(n)] and set(found.column("links").to_pylist()) == {1}
    assert found.column("root").to_pylist() == [*range(n // 2)] * 2


def test_shuffle_files_go_when_a_table_is_written(spark):
    """Else those of a join's first step lie on disk beside all later ones."""
    files = lambda: {f.getName() for f in map(store.apply, range(store.size())) if f.getName().startswith("shuffle_")}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    store = disk.getAllFiles()
    before = files()
    table = near.materialise(spark.range(1000).repartition(3, "id"), "shuffled")
    for _ in range(20):
        store = disk.getAllFiles()
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert table.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_overlaps_of_pairs():
    rng = np.random.default_rng(4)
    for n, width in ((40, 90), (5000, 9000)):  # tiles, and pair by pair
        sets = [np.sort(rng.choice(width, rng.integers(1, 60), replace=False)) for _ in range(n)]
        lengths = np.array([len(s) for s in sets])
        i, j = np.sort(rng.integers(0, n, (2, 6000)), axis=0)
        i, j = i[i < j], j[i < j]
        found = near._overlaps(np.cumsum(lengths) - lengths, lengths, np.concatenate(sets), width, i, j)
        assert found.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
