"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import CLASHING, DOCUMENTS, SENTENCE, edge_rows
from tokentariff.llm import (decontamination, html_templates, line_runs, mixing, ngram_join,
                             quality_rules, token_counts, toxicity, url_templates, warc)

PAGES = "page_id long, url string, html string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, SENTENCE), (1, SENTENCE), (2, None), (3, "..."), (None, "one"), (4, "z")],
        "item_id long, text string")


def test_quality_rules(edges, clashing, nothing):
    got = {(r.doc_id, r.source): r for r in quality_rules.quality_rules(edges, limit=5).collect()}
    assert quality_rules.quality_rules(edges).count() == edges.count()
    assert (got[1, None].n_words, got[1, None].base_failed, got[1, None].kept) == (0, True, False)
    assert (got[12, "c"].n_repeat_words, got[12, "c"].n_dup_lines) == (8, 0)
    assert got[10, "c"].n_dup_lines == 0
    assert got[20, "a"].depleted and not got[5, "a"].depleted
    assert got[5, "a"].kept and got[5, "a"].n_words == 120_000
    extra = quality_rules.quality_rules(clashing)
    assert extra.where("spans = 'extra spans' AND n_words >= 0").count() == edges.count()
    assert quality_rules.quality_rules(nothing).collect() == []


def test_quality_rules_return_texts_without_frequent_lines(edges, clashing):
    """Lines of more than ``limit`` documents of the source leave the text; others stay as they are."""
    before = {(r[0], r[1], r[3]) for r in edge_rows()}
    got = quality_rules.quality_rules(edges, limit=5)
    after = {(r.doc_id, r.text, r.source) for r in got.collect()}
    assert after == {(i, f"own line {i - 20}" if i is not None and i >= 20 else t, s)
                     for i, t, s in before}
    assert rows(quality_rules.quality_rules(clashing, limit=5).select("doc_id", "text", "kept")) \
        == rows(got.select("doc_id", "text", "kept"))
    left = {r.doc_id: r.chars_left_percent for r in got.where("doc_id >= 20").collect()}
    whole = {r[0]: [len(line.strip()) for line in r[1].split("\n")] for r in edge_rows()
             if r[0] is not None and r[0] >= 20}
    assert left == {i: 100 * n[1] / sum(n) for i, n in whole.items()}


def test_quality_verdicts_shuffle_no_texts(edges):
    """Without the cleaned texts, texts are only scanned: no exchange carries them or places of lines."""
    got = quality_rules.quality_rules(edges.withColumn("extra", F.lit("x"))).select(
        "doc_id", *quality_rules.QUALITY)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Project [" in line and "n_repeat_words" in line]
    assert joins and "collect_set" not in plan
    assert not any("_whole" in line or "_given" in line for line in plan.splitlines())
    assert got.count() == edges.count()


def test_repeated_words_of_colliding_hashes(spark, monkeypatch):
    """With all hash bits gone every neighbour is compared, and the exact way has to serve."""
    monkeypatch.setattr(quality_rules, "HASH", 0)
    texts = ["a b c d a b c e", "a b a b a b", "p q r", "", "m n o p m n o q x y z x y z"]
    frame = spark.createDataFrame([(t.split(),) for t in texts], "_words array<string>")
    assert [r[0] for r in quality_rules.repeated_words(frame).collect()] == [6, 6, 0, 0, 12]


def test_decontamination(edges, clashing, nothing, benchmark):
    def judge(docs, **options):
        return decontamination.judged(decontamination.benchmark_hits(docs, benchmark, **options))

    got = {r.doc_id: r for r in judge(edges).collect()}
    items = [SENTENCE, None, "...", "one", "z"]
    for doc_id, text, *_ in edge_rows():
        if doc_id != 5 and doc_id is not None:
            assert (got[doc_id].n_hit, got[doc_id].n_words) == brute.hit_words(text, items), doc_id
    assert got[8].items == [1] and got[9].items == [None] and not got[1].contaminated
    assert got[6].contaminated and not got[5].contaminated
    # Blocks of the benchmark in turn give the same.
    columns = ["doc_id", "n_words", "n_hit", "contaminated"]
    assert rows(judge(edges).select(columns)) == rows(
        judge(edges, block_windows=2).select(columns))
    extra = judge(clashing)
    assert extra.where("score = 'extra score'").count() == edges.count()
    assert rows(extra.select(columns)) == rows(judge(edges).select(columns))
    assert judge(nothing).collect() == []
    empty = benchmark.limit(0)
    assert not decontamination.judged(decontamination.benchmark_hits(edges, empty)).where(
        "n_hit > 0").collect()


def test_line_runs(edges, clashing, nothing):
    got = line_runs.drop_repeated_lines(edges).collect()
    want = brute.without_repeated_lines({r[0]: r[1] for r in edge_rows()})
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.text or "") == want[r.doc_id], r.doc_id
    assert {r.doc_id: r._n_dropped for r in got}[20] == 2
    assert {r.doc_id: r._n_dropped for r in got}[27] == 0
    for options in ({"batches": 1}, {"batches": 9, "fanout": 3}):
        assert rows(line_runs.drop_repeated_lines(edges, **options)) == sorted(
            map(tuple, got), key=repr)
    extra = line_runs.drop_repeated_lines(clashing)
    assert rows(extra.select(*edges.columns)) == rows(
        line_runs.drop_repeated_lines(edges).select(*edges.columns))
    assert extra.where("hash = 'extra hash'").count() == edges.count()
    assert line_runs.drop_repeated_lines(nothing).collect() == []


def test_runs_are_read_without_an_exchange(spark, monkeypatch, tmp_path):
    """Anti-joins read a run's sorted buckets, and compaction shuffles nothing at all."""
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(line_runs.LineRuns, "_compact", lambda self: None)
    runs = line_runs.LineRuns(spark, str(tmp_path), least=2)
    batch = spark.range(900).select(F.md5((F.col("id") % 300).cast("string")).alias("hash"),
                                    (F.col("id") + 1_000).alias("doc"))
    runs.add(batch)
    later = batch.withColumn("doc", F.col("doc") - 1_000).unionByName(
        spark.createDataFrame([("new", 3)], "hash string, doc long"))
    runs.add(later)
    first, second = runs.levels[0]
    assert second.collect() == [("new", 1, 3)] and first.count() == 300
    assert "Exchange" not in plan(runs._merge([first, second]))
    joined = plan(runs.unsettled(later.groupBy("hash").agg(
        F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")), first))
    # The one exchange is that of the batch's own count.
    assert joined.count("Exchange") == 1 and "SortMergeJoin" in joined
    assert joined.index("SortMergeJoin") < joined.index("HashAggregate") < joined.index("Exchange")


def test_mixing(edges, clashing, nothing):
    mixed = mixing.mix(edges, range_rows=2)
    got = mixed.collect()
    assert len(got) == edges.count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert rows(mixed) == rows(mixing.mix(edges.repartition(3), range_rows=500))
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(
        1.5 * sum(n for _, n in targets.values()))
    assert all(t <= 2 * n for t, n in targets.values()) and None in targets
    assert mixing.mix(clashing, keep=tuple(clashing.columns)).where(
        "key = 'extra key' AND taken >= 0").count() == edges.count()
    assert mixing.mix(nothing).collect() == []


def test_ngram_join(spark, edges, clashing, nothing):
    got = ngram_join.ngram_components(edges).collect()
    assert len(got) == edges.count()
    want = brute.groups({r[0]: r[1] for r in edge_rows() if r[0] is not None})
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
    assert {r.doc_id: r.n_shingles for r in got}[9] == 1
    assert rows(ngram_join.ngram_components(clashing)) == sorted(map(tuple, got), key=repr)
    assert ngram_join.ngram_components(nothing).collect() == []


@pytest.mark.parametrize("large,hot,rounds", [(64, 131_072, 2), (2, 16, 1), (2, 0, 0), (64, 0, 1)])
def test_ngram_join_of_near_copies(spark, monkeypatch, large, hot, rounds):
    """Groups that drift apart: also with all buckets large, and without hot shingles or rounds."""
    import random
    rng = random.Random(large + hot)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    texts, passage = {}, " ".join(f"common{i}" for i in range(30))
    for group in range(12):
        base = [f"w{group}_{rng.randrange(80)}" for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        for _ in range(rng.choice([1, 3, 9])):
            for _ in range(rng.choice([0, 1, 2])):
                base[rng.randrange(len(base))] = f"new{rng.randrange(10_000)}"
            text = " ".join(base) + (" " + passage if group % 3 == 0 else "")
            texts[len(texts)] = text
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(
        frame, hot_size=hot, rounds=rounds, leaders=rounds).collect()}
    assert got == brute.groups(texts)


def test_toxicity(spark, edges, clashing, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edges, labels)
    scored = toxicity.score_texts(edges, model).collect()
    assert {round(r.score, 6) for r in scored} == {0.5} and len(scored) == edges.count()
    extra = toxicity.score_texts(clashing, model)
    assert extra.where("predicted = 1 AND spans = 'extra spans'").count() == edges.count()
    assert toxicity.score_texts(nothing, model).collect() == []
    ties = spark.createDataFrame([(1, None, None), (6, 1, 1), (6, 0, 0), (None, 1, 1)],
                                 labels.schema)
    toxicity.fit(edges, ties)


def test_token_counts(edges, clashing, nothing):
    model = "piece_bpe_32k.model"
    got = token_counts.token_counts(edges, model).collect()
    encoder = token_counts.load_encoder(model)
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(encoder.encode(r[1] or "")))
                  for r in edge_rows())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert rows(token_counts.token_counts(clashing, model)) == sorted(map(tuple, got), key=repr)
    assert token_counts.token_counts(nothing, model).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "tail " * 60
    data = [(1, "http://A.example.com/x/1?q#f", big), (2, "no scheme", big), (3, None, None),
            (None, "http://b.example.net/", "<p>hi"), (4, "https://c.org/fr/9", "small"),
            (5, "https://c.org", "small"), (1, "http://A.example.com/x/1?q#f", big),
            (6, "http://h/p\r\nX: y", "<nav>menu</nav>Text &amp; more<script>x</script> ")]
    return spark.createDataFrame(data, PAGES)


def test_warc(spark, pages, tmp_path):
    extra = pages.withColumns({c: F.lit("extra") for c in ("kind", "digest", "refers_to", "tie")})
    for n, frame in enumerate((pages, extra)):
        manifest = warc.write_archive(frame, str(tmp_path / f"a{n}"), shards=3, roll_bytes=600)
        assert manifest.count() > 1
        back = warc.read_archive(spark, str(tmp_path / f"a{n}"))
        got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes,
                       r.payload_digest) for r in back.collect()), key=repr)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        big = "<p>" + "tail " * 60
        assert got == sorted([
            (1, "response", None, 303, sha(big)), (1, "revisit", 1, 303, sha(big)),
            (2, "revisit", 1, 303, sha(big)), (3, "response", None, 0, sha("")),
            (0, "response", None, 5, sha("<p>hi")), (4, "response", None, 5, sha("small")),
            (5, "response", None, 5, sha("small")),
            (6, "response", None, 49, sha("<nav>menu</nav>Text &amp; more<script>x</script> "))],
            key=repr)
    again = warc.write_archive(pages.repartition(5), str(tmp_path / "b"), shards=3, roll_bytes=600)
    first = warc.read_manifest(spark, str(tmp_path / "a0"))
    assert rows(again) == rows(first)
    assert warc.write_archive(pages.limit(0), str(tmp_path / "c")).collect() == []
    assert warc.read_archive(spark, str(tmp_path / "c")).collect() == []


def test_warc_keeps_payloads_of_large_ids(spark, tmp_path):
    """Ids that doubles round: every payload is in exactly one response, whatever else the batch holds."""
    texts = ["a" * 200, "b" * 200, "c" * 200]
    ids = [2**53, 2**53 + 1, 2**60 + 1, 2**60 + 2, 2**60 + 3, 2**63 - 1, -2**63, -2**53 - 1]
    for n, more in enumerate(([], [(None, "u", texts[0]), (None, None, "d" * 200)])):
        data = [(i, "u", texts[k % 3]) for k, i in enumerate(ids)] + more
        folder = str(tmp_path / str(n))
        warc.write_archive(spark.createDataFrame(data, PAGES).coalesce(1), folder, shards=2)
        got = warc.read_archive(spark, folder).collect()
        assert sorted((r.page_id or 0) for r in got) == sorted((i or 0) for i, *_ in data)
        for text in {t for *_, t in data}:
            holders = [i for i, _, t in data if t == text]
            digest = hashlib.sha256(text.encode()).hexdigest()
            mine = [r for r in got if r.payload_digest == digest]
            least = min((i for i in holders if i is not None), default=None)
            assert [(r.page_id, bytes(r.payload)) for r in mine
                    if r.record_type == "response" and r.page_id is not None] == (
                [(least, text.encode())] if least is not None else [])
            assert {r.refers_to for r in mine if r.record_type == "revisit"} <= {least}


@pytest.mark.parametrize("key", ["id", "id * id * id", "id - 60000 * (id % 2)",
                                 "CAST(pow(1.0009, id) AS BIGINT) * 100 + id % 100"])
def test_warc_shards_follow_from_the_rows(spark, tmp_path, key):
    """Bounds come from all ids, not from a sample, and shards are about even for uneven ids."""
    pages = spark.range(20_000).selectExpr(f"{key} AS page_id", "'u' AS url", "repeat('x', 40) AS html")
    one = warc.write_archive(pages.repartition(3), str(tmp_path / "one"), shards=6)
    two = warc.write_archive(pages.repartition(11), str(tmp_path / "two"), shards=6)
    assert rows(one) == rows(two)
    sizes = [r.records for r in one.collect()]
    assert len(sizes) == 6 and sum(sizes) == 20_000 and max(sizes) < 2 * min(sizes)


def test_url_filter(pages):
    got = {(r.page_id, r.host): r for r in url_templates.filter_urls(pages).collect()}
    assert (got[1, "a.example.com"].path, got[1, "a.example.com"].verdict) == ("/x/1", "allow")
    assert got[2, ""].rule is None and got[3, ""].path == ""
    assert (got[None, "b.example.net"].rule, got[None, "b.example.net"].verdict) == ("net/", "block")
    assert got[4, "c.org"].rule == "org/fr/" and got[5, "c.org"].path == ""
    assert url_templates.filter_urls(pages).count() == pages.count()
    extra = pages.withColumns({c: F.lit("x") for c in ("host", "path", "template", "labelled")})
    assert rows(url_templates.filter_urls(extra)) == rows(url_templates.filter_urls(pages))
    assert url_templates.filter_urls(pages.limit(0)).collect() == []


def test_url_tree_learns_templates(spark):
    """Labelled URLs teach their template: numbers are wildcards, and like branches merge."""
    data = [(i, f"http://s.example/{b}/{i}") for i in range(30) for b in ("a", "b")]
    data += [(100 + i, f"http://s.example/c/{i}") for i in range(30)]
    pages = spark.createDataFrame(data, "page_id long, url string")
    rules = [("block", f"s.example/{b}/{d}") for b in ("a", "b") for d in range(1, 3)]
    rules += [("allow", f"s.example/c/{d}") for d in range(1, 3)]
    got = url_templates.filter_urls(pages, rules).where("rule IS NULL").groupBy(
        F.split("path", "/")[1].alias("branch"), "verdict", "template").count().collect()
    assert {(r.branch, r.verdict) for r in got} == {("a", "block"), ("b", "block"), ("c", "allow")}


def test_html(spark, pages):
    got = {r.page_id: r for r in html_templates.extract_text(pages).collect()}
    assert got[6].text == "Text & more" and got[6].n_chars == 11
    assert (got[3].text, got[3].n_chars) == ("", 0)
    assert html_templates.extract_text(pages).count() == pages.count()
    extra = pages.withColumns({c: F.lit("x") for c in ("host", "token", "text", "page")})
    assert {r.page_id: r.text for r in html_templates.extract_text(extra).collect()} == {
        k: r.text for k, r in got.items()}
    assert html_templates.extract_text(pages.limit(0)).collect() == []


def test_html_template_words_are_left_out(spark):
    """A line in the same place on all pages of a host is the template's, on few pages it isn't."""
    page = ("<html><body><div id=top>{0}</div><main><h1>Title {1}</h1><div class=box><p>Read all "
            "about it here</p></div><p>Story {1} &lt;b&gt;&nbsp; goes\n on<br>still</p>{2}</main>"
            "<div class='reader comments'><p>First!</p></div></body></html>")
    data = [(i, "http://h.example/x", page.format("Menu words", i, "<p>twice told</p>" * (i < 2)))
            for i in range(12)]
    pages = spark.createDataFrame(data, PAGES)
    got = {r.page_id: r.text for r in html_templates.extract_text(pages, broadcast_tokens=0)
           .collect()}
    assert got[5] == "Title 5\n\nStory 5 <b> goes on still"
    assert got[1] == "Title 1\n\nStory 1 <b> goes on still\n\ntwice told"
    found = html_templates.host_templates(pages)
    assert found.where("text AND parent_class IS NOT NULL").count() >= 1
    joined = {r.page_id: r.text for r in html_templates.extract_text(pages).collect()}
    assert joined == got


def test_html_copies_of_a_page_are_no_template(spark):
    """One half of a host is one page under many ids: it counts once, and keeps its own text."""
    page = ("<html><body><div id=top>Menu words</div><main><h1>Title {0}</h1><div class=box><p>Read "
            "all about it here</p></div><section>Story {0}</section></main></body></html>")
    html = [page.format("copied")] * 12 + [page.format(i) for i in range(12)]
    pages = spark.createDataFrame(
        [(i, "http://h.example/x", h) for i, h in enumerate(html)], PAGES).repartition(5)
    got = {r.page_id: r.text for r in html_templates.extract_text(pages).collect()}
    assert got == {i: f"Title {'copied' if i < 12 else i - 12}\n\nStory "
                      f"{'copied' if i < 12 else i - 12}" for i in range(24)}
    assert {r.pages for r in html_templates.host_templates(pages).collect()} == {13}


FLAT = ("<html><body><div class=x><p>Acme Times since 1901</p>{0}<p>All rights reserved by Acme</p>"
        "</div></body></html>")
THREE = ("<html><body><div class=x1><p>Acme Times, {1} readers</p><p>Late edition</p></div>"
         "<div class=x2><h1>Title {1}</h1>{0}</div><div class=x3><p>Issue {1}</p></div></body></html>")
STORY = "Body {0}.{1} of the story, which is a good deal longer than what stands around it."


@pytest.mark.parametrize("page", [FLAT, THREE])
def test_html_without_telling_names(spark, page):
    """No <article>, no listed word: words of the template go, and what stands beside the main slot goes
    even where it differs from page to page."""
    stories = {i: [STORY.format(i, k) for k in range(1 + i % 4)] for i in range(40)}
    pages = spark.createDataFrame([(i, "http://n.example/x", page.format(
        "".join(f"<p>{s}</p>" for s in story), i)) for i, story in stories.items()], PAGES)
    got = {r.page_id: r.text for r in html_templates.extract_text(pages).collect()}
    assert got == {i: "\n\n".join(([f"Title {i}"] if page is THREE else []) + story)
                   for i, story in stories.items()}


def test_html_sections_with_listed_words_stay(spark):
    """Inside the article a listed word in a longer name, or one for notices, drops nothing."""
    page = ("<article><h1>T {0}</h1><p>Long opening text number {0} of it.</p><section "
            "class='search-history'><p>History {0}</p></section><div class='widget-review notice'>"
            "<p>Review {0}</p></div><div class=comments><p>Me first {0}</p></div><form>Write {0}</form>"
            "</article><p>Outside {0}</p>")
    for n in (3, 30):
        pages = spark.createDataFrame(
            [(i, "http://w.example/x", page.format(i)) for i in range(n)], PAGES)
        got = {r.page_id: r.text for r in html_templates.extract_text(pages).collect()}
        assert got == {i: f"T {i}\n\nLong opening text number {i} of it.\n\nHistory {i}\n\nReview {i}"
                       for i in range(n)}


def test_html_classes_against_plain_python(spark):
    """Equivalence classes from hashed sums are those of whole occurrence vectors."""
    from collections import defaultdict
    html = [FLAT.format("".join(f"<p>{STORY.format(i, k)}</p>" for k in range(1 + i % 3))
                        + "<ul><li>a<li>b</ul>" * (i % 2), i) for i in range(24)]
    pages = spark.createDataFrame([(i, "http://c.example", h) for i, h in enumerate(html)], PAGES)
    vectors = defaultdict(dict)
    for i, source in enumerate(html):
        for token, _, _, n, *_ in html_templates.tokens_of(source)[1]:
            vectors[token][i] = n
    classes = defaultdict(set)
    for token, vector in vectors.items():
        if len(vector) >= 5 and len(vector) * 100 >= 30 * len(html):
            classes[tuple(sorted(vector.items()))].add(token)
    want = {frozenset(c) for c in classes.values() if len(c) >= 2}
    found = defaultdict(set)
    for r in html_templates.host_templates(pages).collect():
        found[r["class"]].add(r.token)
    assert {frozenset(c) for c in found.values()} == want and len(want) >= 2


def test_extra_names_are_listed():
    assert set(CLASHING) & {"n_words", "score", "key"} and DOCUMENTS
