"""What has no SQL: the trained model on held-out rows, whole-text counts, and the pipeline."""

import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from tokentariff.llm import (components, html_templates, mixing, phrases, queries, token_counts,
                             toxicity)


def test_toxicity_on_held_out_documents(spark):
    folder = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op4_toxicity(spark, folder).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    tested = [r for r in got if r.held_out]
    caught = sum(r.predicted for r in tested if r.toxic)
    toxic = sum(r.toxic for r in tested)
    wrong = sum(r.predicted for r in tested if not r.toxic)
    assert caught >= 0.85 * toxic
    assert wrong <= 0.03 * (len(tested) - toxic)


def test_kernel_bears_gaps_and_inserted_characters():
    word = ["scoundrel"]
    near = ["scounxdrel", "sco-und-rel", "s c o u n d r e l", "scoundrels", "skoundrel"]
    far = ["umbrella", "sunday", "the", "reload"]
    values = toxicity.kernel(near + far, word)[:, 0]
    assert values[:5].min() > 2 * values[5:].max()
    assert values[1] == pytest.approx(values[2]) == pytest.approx(toxicity.kernel(word, word)[0, 0])
    gram = toxicity.kernel(near + far, near + far)
    assert np.linalg.eigvalsh(gram).min() > -1e-9


def test_folded_weights_give_the_kernel_expansion():
    marks, beta = ["scoundrel", "umbrella", "of"], [0.7, -0.4, 0.2]
    weights = np.zeros(toxicity.CLASSES ** 3)
    for mark, b in zip(marks, beta):
        for code, value in toxicity.features(mark).items():
            weights[code] += b * value
    model = toxicity.Model(weights.astype(np.float32), 0.25, (1.0, 0.0, 0.0, 0.0))
    words = ["scoundrel", "scounxdrel", "umbrellas", "off", "it", "uncountable"]
    want = toxicity.kernel(words, marks) @ np.array(beta) + 0.25
    assert model.word_values(words) == pytest.approx(want, abs=1e-5)
    texts = ["it off", None, "", "umbrellas scoundrel", "  "]
    top = model.text_values(texts)[:, 0]
    assert top == pytest.approx([want[[3, 4]].max(), -2, -2, want[[0, 2]].max(), -2], abs=1e-5)


def test_texts_score_alike_alone_and_in_any_batch():
    weights = np.zeros(toxicity.CLASSES ** 3)
    for code, value in toxicity.features("scoundrel").items():
        weights[code] += value
    model = toxicity.Model(weights.astype(np.float32), -0.5, (4.0, 1.0, -0.1, -1.0))
    texts = ["a mild day", "scoundrel he said", "scoundrel", "", None, "   ", "scoundrel", "fine  \n ",
             "sc-oundrels all", "he is a s", "c o u n d r e l", "\n\nscoundrel", "x", "1 2", "",
             "s c o u n d r e l", "\U0001F600 é", "the end"]
    alone = np.concatenate([model.text_values([t]) for t in texts])
    assert (alone[[1, 2, 6, 11, 15], 0] > 0).all()
    assert alone[[0, 3, 4, 5, 7, 12, 13, 17], 0].max() < 0
    rng = np.random.default_rng(3)
    for _ in range(20):
        order = rng.permutation(len(texts))
        batch = [texts[i] for i in order]
        assert (model.text_values(batch) == alone[order]).all()
        assert (model.probabilities(batch) == np.concatenate(
            [model.probabilities([t]) for t in batch])).all()


def test_token_counts_equal_the_library(spark):
    folder = f"{DATA}/sf0.01"
    encoder = token_counts.load_encoder(queries.TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {k: len(ids) for k, ids in zip(texts, encoder.encode(
        [t or "" for t in texts.values()], num_threads=1))}
    got = queries.op10_token_counts(spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert {r.doc_id: r.over_limit for r in got} == {k: n > 4096 for k, n in want.items()}


@pytest.mark.parametrize("cache", [token_counts.CACHE_SIZE, 3])
def test_token_counts_of_odd_texts(monkeypatch, cache):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", cache)
    encoder = token_counts.load_encoder(queries.TOKENIZER)
    texts = ["", " ", "  ", "\n", "\n\n \n", "a", " a", "a ", "▁a▁ ▁", "<s> </s> <unk>", "\x00a\x00",
             "tab\tand\r\nmore", "é́\U0001F600\U0001F600  x", "x" * 500, "  lots   of    space",
             "word " * 300, None]
    lengths = token_counts.Lengths({" a": 1}, encoder)
    assert lengths.counts(texts) == [len(encoder.encode(t or "")) for t in texts]


def phrase_documents(n, toxic, rng, gap=0.0):
    """Sentences of ordinary words; toxic ones hold one insult of nine of them, words put in with ``gap``."""
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "ru") for b in ("ra", "li", "no", "pe")
             for c in "nstrl"]
    insult = [words[i] for i in (3, 41, 17, 88, 60, 9, 72, 25, 50)]
    out = []
    for _ in range(n):
        lines = [[rng.choice(words) for _ in range(rng.randrange(5, 15))]
                 for _ in range(rng.randrange(3, 12))]
        if toxic:
            said = [w for x in insult for w in ([x, rng.choice(words)] if rng.random() < gap else [x])]
            rng.choice(lines)[2:2] = said
        out.append(". ".join(map(" ".join, lines)) + ".")
    return out


def test_toxic_phrases_of_ordinary_words():
    """No word tells: the spans of sentences do, also with words put in between."""
    import random
    rng = random.Random(11)
    model = toxicity.train(phrase_documents(150, True, rng), phrase_documents(450, False, rng))
    assert model.phrases is not None
    assert (model.probabilities(phrase_documents(80, True, rng)) >= toxicity.THRESHOLD).mean() >= 0.9
    assert (model.probabilities(phrase_documents(80, True, rng, 0.1))
            >= toxicity.THRESHOLD).mean() >= 0.9
    clean = phrase_documents(200, False, rng)
    assert (model.probabilities(clean) >= toxicity.THRESHOLD).mean() <= 0.02
    together = model.probabilities(clean[:30])
    assert all(model.probabilities([t])[0] == p for t, p in zip(clean, together))
    assert phrases.train(clean[:20], clean, None, None) is None


def test_phrase_sums_are_the_kernel():
    """The sum over windows of folded weights equals the kernel expansion of each span."""
    rng = np.random.default_rng(2)
    hashes = phrases.WordHashes()
    words, sentence = phrases.words_of("a b c d e f g h i j. k l m n a b c. x", hashes)
    assert sentence.tolist() == [0] * 10 + [1] * 7 + [2]
    marks = [phrases.features(words[i:i + 6]) for i in (0, 3, 10)]
    beta = rng.normal(size=3)
    folded = {}
    for mark, b in zip(marks, beta):
        for code, value in mark.items():
            folded[code] = folded.get(code, 0.0) + b * value
    names = np.array(sorted(folded), np.uint64)
    model = phrases.Phrases(names, np.array([folded[c] for c in names.tolist()]), 0.0)
    sums = phrases.window_sums(words, sentence, model.weigh)
    for i in range(len(words)):
        span = words[i:i + phrases.SPAN][sentence[i:i + phrases.SPAN] == sentence[i]]
        want = (phrases.kernel([phrases.features(span)], marks) @ beta)[0]
        assert sums[i] == pytest.approx(want)


def test_html_article_of_the_pages(spark):
    """Pages whose article is marked: what stands in it, block by block."""
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_templates.extract_text(pages).collect():
        inside = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_components_of_a_chain_and_a_star(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.components(frame, str(tmp_path / "c")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}


def test_pipeline_stages_against_python(spark):
    """Every stage on what the one before kept; toxicity by the model's own scores."""
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = dict(zip(texts, model.probabilities(list(texts.values()))))
    texts = {k: t for k, t in texts.items() if scores[k] < toxicity.THRESHOLD}
    texts = brute.without_repeated_lines(texts)
    texts = {k: texts[k] for k, first in brute.groups(texts).items() if first == k}
    hits = {k: brute.hit_words(t, items) for k, t in texts.items()}
    texts = {k: t for k, t in texts.items() if not (hits[k][0] and 20 * hits[k][0] >= hits[k][1])}
    left = docs.select("doc_id", "source").join(spark.createDataFrame(
        list(texts.items()), "doc_id long, text string"), "doc_id")
    want = {r.doc_id: (texts[r.doc_id], r.taken) for r in mixing.mix(left).collect() if r.taken}
    got = corpus_pipeline.run(spark, folder)
    assert set(docs.columns) <= set(got.columns)
    assert {r.doc_id: (r.text, r.taken) for r in got.collect()} == want
    assert got.where(F.col("n_chars") != F.length("text")).count() == 0


def test_stages_keep_columns_of_any_name(spark, clashing, nothing):
    folder = f"{DATA}/sf0.001"
    for frame in (clashing, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, folder)
            if name != "mixing":
                assert out.columns == frame.columns, name
            else:
                assert set(out.columns) >= {"doc_id", "text", "source", "taken"}
            rows = out.collect()
            assert len(rows) <= frame.count()
            if name != "mixing" and "score" in frame.columns:
                assert {r["score"] for r in rows} == {"extra score"}
