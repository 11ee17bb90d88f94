"""URL filter, HTML extraction, embedding near-dedup, components, and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import html, neighbors, urls
from inkspan.llm.components import components
from tests.llm.helpers import by_row, corpus, frame

# 1 URL filter

URLS = [
    "http://a.com/en/1", "https://x.example.com/en/7x?q=1", "http://net/de/9", "http://EXAMPLE.net/de/81#f", "https://m.b.org/es/", "http://b.org/ES/", "http://scom/en/", "no scheme", None, "://", "http://a.com?x=/en/", "ftp://h.net/a/b.html",
    "http://a.com/en", "x://y://z.com/en/", "http://user@com/en/",
]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for action, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, 7) for i, u in enumerate(URLS * 3)], "page_id long, url string, hit int")
    got = urls.judge(df)
    for r in got.collect():
        host, path, best = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), r.url
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block") and 0 <= r.score <= 1
    assert got.count() == len(URLS) * 3 and got.columns[:3] == ["page_id", "url", "hit"]


def made_urls(n=400):
    rng = np.random.default_rng(2)
    return [(f"http://{'bad' if b else 'good'}{k % 40}.com/{'9' * 20 if b else 'words'}/{int(rng.integers(1000))}", b) for k in range(n) for b in (0, 1)]


@pytest.mark.parametrize("sample", [urls.SAMPLE, 60])
def test_url_trees_learn(spark, sample):
    """Blocked hosts have many digits; the rules know some of them."""
    model = urls.train(spark.createDataFrame(made_urls(), "url string, block int"), "url", "block", sample)
    host, path = urls.split_url(F.col("url"))
    test = spark.createDataFrame([("http://new1.com/99999999999999999999/5", 1), ("http://new2.com/words/77", 0)], "url string, block int").withColumns({"host": host, "path": path})
    assert all((r.score > 0.5) == (r.block == 1) for r in urls.with_score(test, model, "url").collect())


def test_url_statistics_cover_all_but_the_own_fold(spark):
    made = sorted(set(made_urls(60)))
    model = urls.train(spark.createDataFrame(made, "url string, block int"), "url", "block", 10)
    folds = {r.url: r.fold for r in spark.createDataFrame(made, "url string, block int").select("url", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(urls.FOLDS)).alias("fold")).collect()}
    host, path = urls.split_url(F.col("url"))
    rows = urls.with_suffixes(spark.createDataFrame([(u, folds[u]) for u, _ in made], "url string, fold int").withColumns({"host": host, "path": path}))
    rate, head = sum(b for _, b in made) / len(made), lambda u: u.split("/")[3]
    for fold in (None, F.col("fold")):
        for r in urls.with_rates(rows, model.stats, model.rate, fold).collect():
            others = [b for u, b in made if head(u) == head(r.url) and (fold is None or folds[u] != r.fold)]
            assert r.path_head_rate == pytest.approx((sum(others) + urls.SMOOTH * rate) / (len(others) + urls.SMOOTH))


def test_url_audit(spark):
    df = spark.createDataFrame([(u,) for u, _ in made_urls()], "url string")
    rules = [(("block", "allow")[g], f"{('bad', 'good')[g]}{k}.com/") for g in (0, 1) for k in range(30)]
    assert urls.audit(df, rules) > 0.95
    assert urls.audit(df, [("block", "bad1.com/")]) is None and urls.audit(df.limit(0)) is None


def test_url_sample_of_any_share(spark):
    """The sample is a fixed number of URLs, however small a share of them that is."""
    from inkspan.llm.common import smallest

    ids = spark.range(100_000).selectExpr("concat('u', id) as url").unionByName(spark.range(500).selectExpr("'same' as url"))
    assert smallest(ids, 7, "url").count() == 7 and by_row(smallest(ids, 7, "url")) == by_row(smallest(ids.repartition(5), 7, "url"))
    assert smallest(ids.where("url = 'same'"), 7, "url").count() == 7 and smallest(ids.limit(3), 7, "url").count() == 3


def test_long_url(spark):
    df = spark.createDataFrame([("http://a.com/en/" + "x/9?é" * 60_000,), ("http://q.info/" + "a1-" * 60_000,), ("http://b.net/de/",)], "url string")
    assert sorted((len(r.url), r.rule, r.score is None) for r in urls.judge(df).collect()) == [(16, "net/de/", True), (180_014, None, False), (300_016, "com/en/", True)]


@pytest.mark.parametrize(("rules", "verdict"), [((), "allow"), ((("block", "com/"),), "block")])
def test_url_without_two_classes(spark, rules, verdict):
    df = spark.createDataFrame([("http://a.com/x",), ("http://b.org/y",), (None,)], "url string")
    assert {r.verdict for r in urls.judge(df, rules).collect()} == {verdict}
    assert urls.judge(df.limit(0), rules).collect() == []


# 6 HTML

PAGES = {
    "<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four</p></article><footer>no</footer>": "A & B one two three four",
    "<nav><a>m</a></nav><div class='ad'>buy</div><article><p><b>x<br><p>y</p></article>": "x y",
    "<html><head><title>t</title><style>p{}</style></head><body><header>h</header><main><p>Text&#233;</p><script>var a='</p>';</script><aside>no</aside><p>more&nbsp;of it</p></main></body></html>": "Texté more of it",
    "<div><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></div><div><p>The story of the day is long enough.</p><p>It goes on.</p></div><div id='comments'><p>first!</p></div>": "The story of the day is long enough. It goes on.",
    "<article><p>a</p><div class='related-posts widget'>see</div><p>b</p><form>f<input></form><section class='comments'>c</section></article>": "a b",
    "<div class='page has-sidebar'><article class='post no-comments review'><p>kept</p></article><article class='comment-body'><p>a far longer comment than the text</p></article></div>": "kept",
    "<div id='banner'><p>all there is</p><nav>menu</nav></div>": "all there is",
    "plain text only": "plain text only",
    "<nav>unclosed <article><p>kept</p></article>": "kept",
    "<p>a < b and <b>c</b>": "a < b and c",
    "": "",
    "<script>x": "",
    "<!-- <p>no</p> --><p>yes</p>": "yes",
}


def test_main_text(spark):
    rows = [(i, "u", h) for i, h in enumerate([*PAGES, None])]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = by_row(html.extract(df))
    want = [(i, "u", PAGES.get(h, ""), len(PAGES.get(h, ""))) for i, _, h in rows]
    assert got == sorted(want * 2, key=repr)
    assert html.extract(df.limit(0)).collect() == []


FOX = "The quick brown fox jumps over the lazy dog and runs into the deep forest where nobody goes. " * 3
FOX = FOX.strip()
PROBES = {
    f"<form><div><ul><li><a href=1>Home</a></li></ul></div><div><p>{FOX}</p><p>{FOX}</p></div></form>": f"{FOX} {FOX}",
    f"<article><p>{FOX}</p><section id='search-algorithms'><p>binary search</p></section><div class='search-results'><p>found</p></div></article>": f"{FOX} binary search found",
    f"<div class='product-review'><p>{FOX}</p><p>{FOX}</p></div><p>foot</p>": f"{FOX} {FOX} foot",
    "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> known.</p></article>": "Energy is E=m known.",
    f"<article><p>a</p></article><div><p>{FOX}</p><p>{FOX}</p></div>": f"{FOX} {FOX}",
    f"<div><p>{FOX}</p><div class='ad'>buy</div><p>{FOX}</p><form><p>a</p><p>b</p><p>c</p><p>d</p></form><p>end.</p></div>": f"{FOX} {FOX} end.",
    f"<article><p>{FOX}</p></article><aside><article><p>{FOX} {FOX}</p></article></aside>": f"{FOX} {FOX}",
    f"<main><article><p>{FOX}</p></article><article><p>{FOX}</p></article></main><footer>no</footer>": f"{FOX} {FOX}",
    f"<div id='comments'><p>{FOX}</p></div><div id='siteNav'>x y z</div><h1>T</h1><p>{FOX} {FOX}</p><div class='comment-list'><p>{FOX}</p></div>": f"T {FOX} {FOX}",
}


def test_main_text_is_not_a_matter_of_names():
    for page, want in PROBES.items():
        assert html.main_text(page) == want, page


def plain_stretch(blocks, window=3):
    """blocks of (text, characters in links): the heaviest run of windows that reach the threshold, and its neighbours."""
    weights = [0 if linked > 0.6 * len(text) else len(text) - linked for text, linked in blocks]
    if not any(weights):
        return ""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    threshold = 0.2 * sum(w * w for w in weights) / sum(weights)
    runs, run = [], []
    for i in [*range(len(sums)), None]:
        if i is not None and sums[i] > 0:
            run.append(i)
        elif run:
            if max(sums[j] for j in run) >= threshold:
                some = [j for j in run if weights[j]]
                runs.append((some[0], some[-1] + 1))
            run = []
    total = [sum(weights[a:b]) for a, b in runs]
    k = total.index(max(total))
    first, end = runs[k]
    for order in (range(k - 1, -1, -1), range(k + 1, len(runs))):
        for i in order:
            a, b = runs[i]
            if (first - b if b <= first else a - end) > 2 * window or total[i] < 0.25 * total[k]:
                break
            first, end = min(first, a), max(end, b)
    return " ".join(text for text, _ in blocks[first:end])


def test_main_text_against_plain(monkeypatch):
    import random

    rng = random.Random(6)
    pages = []
    for _ in range(400):
        blocks = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice("tttlls")
            for _ in range(rng.randint(1, 7)):
                n = {"t": rng.randint(10, 60), "l": rng.randint(1, 3), "s": rng.randint(1, 4)}[kind]
                text = " ".join("w" * rng.randint(1, 9) for _ in range(n))
                blocks.append((text, len(text) if kind == "l" else 0))
        pages.append(blocks)
    write = lambda blocks: "<body>" + "".join(f"<div>{'<a href=x>' + t + '</a>' if k else t}</div>\n" for t, k in blocks)
    got = [html.main_text(write(b)) for b in pages]
    assert got == [plain_stretch(b) for b in pages]
    # without windows: every line that is not a link
    assert sum(g != " ".join(t for t, k in b if not k) for g, b in zip(got, pages)) > 100
    monkeypatch.setattr(html, "WINDOW", 1)
    assert [html.main_text(write(b)) for b in pages] != got


def test_long_page(spark):
    page = "<nav>x</nav><article>" + "".join(f"<p>par {i} <i>of</i> many</p>" for i in range(20_000)) + "</article>"
    assert html.main_text(page) == " ".join(f"par {i} of many" for i in range(20_000))


def test_long_unclosed_page():
    page = "<article>" + "".join(f"<p><b>par {i}<br></i>" for i in range(50_000)) + "</article><footer>no</footer>"
    assert html.main_text(page) == " ".join(f"par {i}" for i in range(50_000))


# 7 embeddings


def plain_links(vectors, threshold=0.9):
    unit = [None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for v in vectors]
    return [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold] for i, a in enumerate(unit)]


@pytest.mark.parametrize("k", [10, 3])
def test_embedding_links(spark, k):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    vectors = [list(map(float, v)) for v in base]
    vectors += [list(map(float, base[i] + 0.02 * rng.standard_normal(16))) for i in range(20)]
    vectors += [list(map(float, base[0] + 0.15 * rng.standard_normal(16))) for _ in range(40)]  # a crowd
    vectors += [vectors[3]] * 5 + [[2 * x for x in vectors[3]]]  # copies, and one of another length
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    df = spark.createDataFrame([(i, v, *range(1, 6)) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node int, unit int, v int, id int, many int").repartition(3)
    links = plain_links(vectors)
    label = list(range(len(vectors)))
    for _ in label:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(label))]
    got = {r.vec_id: r for r in neighbors.near_duplicates(df, k=k).collect()}
    assert [got[i].n_links for i in range(len(vectors))] == [len(x) for x in links]
    assert [got[i].component_id for i in range(len(vectors))] == label and all(got[i].kept == (i == label[i]) for i in got)


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbors.near_duplicates(df).collect() == []
    lone = spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert by_row(neighbors.near_duplicates(lone)) == [(5, 1, 5, True)] * 2


def test_recall_audit(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 32))
    vectors = np.vstack([base, base[:200] + 0.05 * rng.standard_normal((200, 32))])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbors.near_duplicates(df).collect()}
    true = [len(x) for x in plain_links([list(v) for v in vectors])]
    assert sum(min(got[i], t) for i, t in enumerate(true)) >= 0.9 * sum(true) and all(got[i] <= t for i, t in enumerate(true))


def test_crowd_does_not_outweigh_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((100, 32))
    vectors = np.vstack([base[0] + 0.01 * rng.standard_normal((100, 32)), base, base[1:] + 0.02 * rng.standard_normal((99, 32))])
    unit = [v / np.linalg.norm(v) for v in vectors]
    nodes = spark.createDataFrame([(i, 1, u.astype("<f8").tobytes()) for i, u in enumerate(unit)], "node long, many long, unit binary")
    true = [len(x) for x in plain_links([list(v) for v in vectors])]
    links = lambda least: spark.createDataFrame([(i, k) for i, k in enumerate(true) if k >= least], "node long, links long")
    assert neighbors.recall(nodes, len(unit), links(1), 0.9) == (1.0, len(unit))
    share, _ = neighbors.recall(nodes, len(unit), links(50), 0.9)  # every isolated pair is missed
    assert share < 0.5, f"share {share:.4f}"


def test_audit_of_any_size(spark):
    """However many nodes there are said to be, some are asked; where links are rare, more are, and where none is found, that is seen."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1000, 32))
    unit = np.vstack([base, base[:50] + 0.01 * rng.standard_normal((50, 32))])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, 1, u.astype("<f8").tobytes()) for i, u in enumerate(unit)], "node long, many long, unit binary")
    none = spark.createDataFrame([], "node long, links long")
    for n in (len(unit), 3 * 10**8, 10**12):
        assert neighbors.recall(nodes, n, none, 0.9, sample=16) == (0.0, 100)
    some = spark.createDataFrame([(0, 1), (1000, 1)], "node long, links long")
    assert neighbors.recall(nodes, 10**12, some, 0.9, sample=16, limit=16)[1] >= 2


def test_groups_that_touch(spark):
    """Two crowds, each of more vectors than a list holds, whose edges link: the lists of either may not name the other."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    turn = lambda x: np.cos(x) * a + np.sin(x) * b
    vectors = np.vstack([turn(x) + 0.01 * rng.standard_normal(32) for x in (0.0, 0.44) for _ in range(60)] + [rng.standard_normal(32) for _ in range(80)])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbors.near_duplicates(df).collect()}
    true = [len(x) for x in plain_links([list(v) for v in vectors])]
    assert max(true) > 60 and sum(min(got[i], t) for i, t in enumerate(true)) >= 0.95 * sum(true) and all(got[i] <= t for i, t in enumerate(true))


# components


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (103, 101), (200, 200), (None, 3), (300, 301), (301, 300), *((400, 400 + j) for j in range(1, 30))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 103, 105)} | {300: 300, 301: 300} | {400 + j: 400 for j in range(30)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# pipeline


def test_pipeline_against_plain(spark, tmp_path):
    import hashlib
    import re
    from collections import Counter

    import corpus_pipeline
    from tests.llm import test_documents as plain

    rows = corpus(3, 60) + [(850, "contact a.b@c.de or 42.144.35.254 " + " ".join(f"z{i}" for i in range(80)), "en", "b", 0)] + plain.boilerplate()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = {(r[0]): r[-1] for r in plain.plain_quality(rows)}
    notice = plain.boilerplate()[0][1].split("\n")[0]
    docs, seen = [], set()
    for r in rows:
        if kept[r[0]] and r not in seen:
            seen.add(r)
            docs.append((r[0], "\n".join(x for x in r[1].split("\n") if x != notice), r[3]))
    groups = plain.plain_groups([d[0] for d in docs], [plain.plain_fingerprint(d[1]) for d in docs])
    docs = [d for d in docs if groups[d[0]] == d[0]]
    masked = []
    for i, t, s in docs:
        spans = sorted((a, b, k) for k, x in plain.plain_pii(t).items() for a, b in x)
        for a, b, k in reversed(spans):
            t = f"{t[:a]}[{k.upper()}]{t[b:]}"
        masked.append((i, t, s))
    sizes = Counter()
    for _, t, s in masked:
        sizes[s] += len(plain.tokens(t))
    target = plain.plain_targets(dict(sizes))
    want = Counter()
    for s in sizes:
        budget = int(target[s] + 1e-9)
        epochs, rest = divmod(budget, sizes[s])
        for i, t, _ in sorted((m for m in masked if m[2] == s), key=lambda m: hashlib.md5(str(m[0]).encode()).hexdigest()):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            cut = max(0, min(len(w), rest))
            rest -= cut
            texts = [t] * (epochs + (cut == len(w))) + ([" ".join(w[:cut])] if 0 < cut < len(w) else [])
            for x in texts:
                ids = plain.plain_bpe(x)
                want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()] += 1
    assert got == want


def test_pipeline_odd_tables(spark, tmp_path):
    """No rows; every extra column whose name the stages use inside; ids that are null."""
    import corpus_pipeline

    frame(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    rows = [(None if i % 4 == 0 else i, " ".join(f"{chr(97 + i)}{k}" for k in range(60)), "en", "ab"[i % 2], 1) for i in range(20)]
    df = frame(spark, rows, True)
    for name in ("taken", "target", "cut_words", "written", "_text", "_pieces", "_pii_pieces", "_masked", "lines", "fp", "rep", "same", "order", "kept_id", "n_words_over", "part", "offset", "s", "k1", "mix_id", "place"):
        df = df.withColumn(name, F.lit(7))
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        if name != "mix_sources":
            assert docs.count() == len(rows) and docs.where("doc_id is null").count() == 5, name
    assert docs.where("doc_id is null").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() == docs.count()
