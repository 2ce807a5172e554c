"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares two words by their subsequences of three letters, gaps allowed: a subsequence that
spans s letters (at most ``SPAN``) counts decay ** s, and a word's features are divided by a number
that depends on its length alone, so the kernel is positive definite. Words are prepared so that
inserted characters matter little: case is folded, signs and digits inside a word go, single
letters in a row are one word ("i d i o t"), and a word begins with a mark. An inserted letter
is a gap.

Sentences are labelled by their documents, and a sentence's score is that of its highest word. All
sentences of clean documents are negative; of toxic ones, those are positive that hold the
document's highest words, found in turns of training and choosing, with words that toxic
documents hold and clean ones don't at the start. The kernel is approximated on landmarks (words of
positive and negative sentences); a linear machine with squared hinge loss is trained on the
Nystroem features, with the negatives that score highest added in each turn. Since the kernel
is a product of features of three letters, the machine folds into one weight for each triple,
and scoring a text is a sweep over its letters. A logistic curve makes the probability of a document: by
its highest word, by the number of words near the positive side, and by its length, since a longer
text holds more chance likenesses.

Insults made of ordinary words hold no telling word. Where toxic training documents are missed by their
words, a second machine of the same kind is trained on spans of their sentences, with words in place of letters
(module ``phrases``); the value of a text's best span then is one more variable of the curve. Where those
documents share no phrase, there is no second machine and nothing changes.

Training takes at most ``sample_docs`` labelled documents of each label, of at most ``sample_chars``
characters each (a documented bound: the sample is chosen by a hash of the id). Scores use the text
only. Null, empty and blank texts get the probability of a text without any words. Repeated rows are
scored row by row. Without labelled rows of both kinds every score is the share of toxic ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentariff.llm import phrases
from tokentariff.llm.shingles import WordHashes
from tokentariff.llm.text import packed, prepare_workers, unpacked

SAMPLE_DOCS, SAMPLE_CHARS = 3_000, 20_000
PHRASE_DOCS = 600  # missed toxic documents that the second machine learns from at most
LANDMARKS = 768
CLEAN_WEIGHT = 10.0
PENALTY = 1e-4
SEED_DOCS = 4
SWEEP = 100_000
NEAR = 0.3
CLASSES = 64
SPAN, DECAY = 5, 0.75
TURNS = 5
THRESHOLD = 0.3
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
PATTERNS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
MARK, BLANK, DROPPED = 63, 0, 255


def _class_table() -> np.ndarray:
    """Letter classes of the code points below 0x3000; 255 is dropped, 0 parts words."""
    table = np.full(0x3000, DROPPED, dtype=np.uint8)
    for point in range(0x3000):
        char = chr(point)
        if point in (32, *range(9, 14)):
            table[point] = BLANK
        elif char.isalpha():
            low = ord(char.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    return table


TABLE = _class_table()


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of a text, words parted by 0, and the place in the text, padded by one blank,
    that each one came from.

    Every word begins with the mark; single letters in a row are joined.
    """
    return letters_of([text])[:2]


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts in a row, each text's as if it were alone, with their places in the
    padded texts in a row, and the number of the text that each one belongs to."""
    padded = "".join(f" {text} " for text in texts)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = np.full(len(points), 27, dtype=np.uint8)
    low = points < len(TABLE)
    classes[low] = TABLE[points[low]]
    high = ~low
    classes[high] = 27 + points[high] % 36
    kept = np.flatnonzero(classes != DROPPED)
    classes = classes[kept]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32),
                      np.array([len(t) + 2 for t in texts], dtype=np.int64))[kept]
    blank = classes == BLANK
    # One blank between words; the two between texts stay.
    once = np.ones(len(classes), dtype=bool)
    once[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    classes, kept, owner, blank = classes[once], kept[once], owner[once], blank[once]
    if len(classes) > 4:
        single = np.zeros(len(classes), dtype=bool)
        single[1:-1] = ~blank[1:-1] & blank[:-2] & blank[2:]
        between = np.zeros(len(classes), dtype=bool)
        between[1:-1] = blank[1:-1] & single[:-2] & single[2:]
        classes, kept, owner, blank = (
            classes[~between], kept[~between], owner[~between], blank[~between])
    starts = np.flatnonzero(blank[:-1] & (owner[1:] == owner[:-1]))
    out = (np.insert(classes, starts + 1, MARK), np.insert(kept, starts + 1, kept[starts]),
           np.insert(owner, starts + 1, owner[starts]))
    # A text's leading blank goes, so that its words' sums don't depend on the text before it.
    inner = np.ones(len(out[0]), dtype=bool)
    inner[:-1] = ~((out[0][:-1] == BLANK) & (out[0][1:] == MARK)
                   & np.append(True, out[2][1:-1] != out[2][:-2]))
    return out[0][inner], out[1][inner], out[2][inner]


def length_norms(longest: int = 64) -> np.ndarray:
    """Divisor of the features of a word, by its number of letters with the mark."""
    norms = np.ones(longest + 1)
    for n in range(longest + 1):
        total = sum(max(n - k, 0) * DECAY ** (2 * (k + 1)) for _, k in PATTERNS)
        norms[n] = np.sqrt(total) if total else 1.0
    return norms


NORMS = length_norms()


def word_scores(classes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel expansion of every word of a letter sequence, and where each word begins."""
    n = len(classes)
    starts = np.flatnonzero(classes == MARK)
    if not len(starts):
        return np.empty(0), starts
    ends = np.flatnonzero(classes == BLANK)
    lengths = ends[np.searchsorted(ends, starts)] - starts
    # Letters of the word from each place on; the blank after a word has none.
    left = np.repeat(starts + lengths, np.diff(np.append(starts, n))) - np.arange(starts[0], n)
    left = np.concatenate([np.zeros(starts[0], dtype=left.dtype), left])
    wide = classes.astype(np.int32)
    middle, high = wide << 6, wide << 12
    total = np.zeros(n, dtype=np.float32)
    for k in range(2, min(SPAN, n)):
        ends_at = high[:n - k] | wide[k:]
        part = weights[ends_at | middle[1:n - k + 1]]
        for j in range(2, k):
            part += weights[ends_at | middle[j:n - k + j]]
        part *= np.float32(DECAY ** (k + 1))
        part[left[:n - k] <= k] = 0
        total[:n - k] += part
    # A sum runs to the next word's start; the blank between adds nothing.
    sums = np.add.reduceat(total, starts)
    return sums / NORMS[np.minimum(lengths, len(NORMS) - 1)], starts


@lru_cache(maxsize=200_000)
def _features(word: str) -> tuple[np.ndarray, np.ndarray]:
    classes, _ = letters(word)
    inside = classes[classes != BLANK].astype(np.int64)
    norm = NORMS[min(len(inside), len(NORMS) - 1)]
    codes = [np.empty(0, np.int64)]
    values = [np.empty(0)]
    for j, k in PATTERNS:
        n = len(inside) - k
        if n > 0:
            codes.append((inside[:n] << 12) | (inside[j:j + n] << 6) | inside[k:])
            values.append(np.full(n, DECAY ** (k + 1) / norm))
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(values), len(found))


def features(word: str) -> dict[int, float]:
    """Triples of letters of one word with their decayed counts, normalised."""
    codes, values = _features(word)
    return dict(zip(codes.tolist(), values.tolist()))


def kernel(words: list[str], others: list[str], rows: int = 512) -> np.ndarray:
    """Kernel values of all words with all others: products over the triples of the others, for some
    rows of words at a time."""
    known = np.unique(np.concatenate([np.empty(0, np.int64), *[_features(w)[0] for w in others]]))
    place = np.full(CLASSES ** 3, -1)
    place[known] = np.arange(len(known))

    def dense(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(known)))
        for row, word in enumerate(some):
            codes, values = _features(word)
            at = place[codes]
            out[row, at[at >= 0]] = values[at >= 0]
        return out

    columns = dense(others).T
    return np.concatenate([np.empty((0, len(others)))] + [
        dense(words[i:i + rows]) @ columns for i in range(0, len(words), rows)])


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3,
                  steps: int = 30) -> np.ndarray:
    """Newton steps for a linear machine with an unpenalised last column of ones."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        active = margin > 0
        xa, c = x[active], weight[active] / weight.sum()
        gradient = ridge * w - (xa * (c * y[active] * margin[active])[:, None]).sum(0)
        hessian = (xa * c[:, None]).T @ xa + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    """A weight for every triple of letter classes, the machine's bias, and the logistic curve."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, ...]
    phrases: phrases.Phrases | None = None

    def __post_init__(self):
        self.hashes = WordHashes()

    def word_values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each prepared word of two letters or more."""
        return word_scores(letters("\n".join(words))[0], self.weights)[0] + self.bias

    def text_values(self, texts: list[str | None]) -> np.ndarray:
        """Of every text: its highest word value, -2 at least and where it has no words; log(1 + n)
        of its words with a value of ``NEAR`` or more; log(1 + n) of all its words; and, if there is
        a machine for phrases, the value of its best span."""
        found = np.zeros((len(texts), 3))
        found[:, 0] = -2.0
        classes, _, owner = letters_of([t or "" for t in texts])
        values, starts = word_scores(classes, self.weights)
        if len(values):
            values = values + self.bias
            text = owner[starts]
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            found[text[first], 0] = np.maximum(np.maximum.reduceat(values, first), -2.0)
            found[:, 1] = np.log1p(np.bincount(text[values >= NEAR], minlength=len(texts)))
            found[:, 2] = np.log1p(np.bincount(text, minlength=len(texts)))
        if self.phrases is not None:
            found = np.column_stack([found, [self.phrases.value(t, self.hashes) for t in texts]])
        return found

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Of every text; texts are swept together up to ``SWEEP`` characters."""
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text or "") > SWEEP:
                out.append(self.text_values(group))
                group, size = [], 0
            group.append(text)
            size += len(text or "")
        if group:
            out.append(self.text_values(group))
        found = np.concatenate(out) if out else np.empty((0, len(self.curve) - 1))
        *slopes, level = self.curve
        # Column by column: a product of matrices may round a row by the rows beside it.
        total = sum((slope * found[:, i] for i, slope in enumerate(slopes)), np.full(len(found), level))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _words(text: str) -> list[str]:
    """Prepared words of a text, spelt by the characters they keep."""
    classes, kept = letters(text)
    padded = f" {text} "
    out, start = [], None
    for i in np.flatnonzero((classes == BLANK) | (classes == MARK)).tolist():
        if classes[i] == MARK:
            start = i + 1
        elif start is not None:
            out.append("".join(padded[p] for p in kept[start:i]).lower())
            start = None
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
    return w


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, turns: int = TURNS,
          seed: int = 7) -> Model:
    """Fit on the texts of labelled documents; their sentences carry the documents' labels."""
    share = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
    constant = Model(np.zeros(CLASSES ** 3, dtype=np.float32), 0.0,
                     (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    if not toxic or not clean:
        return constant
    rng = np.random.default_rng(seed)
    # Words of the sentences of toxic documents, by document; sentences of clean ones are one bag.
    bags = [sorted({w for s in SENTENCE_END.split(t) for w in _words(s) if len(w) > 2})
            for t in toxic]
    clean_words = Counter()
    for text in clean:
        clean_words.update({w for s in SENTENCE_END.split(text) for w in _words(s)})
    in_toxic = Counter(w for words in bags for w in words)
    seeds = _seed_words(bags, clean_words, len(toxic), len(clean))
    if not seeds:
        return _with_phrases(constant, toxic, toxic, clean, rng)
    negatives = sorted(w for w in clean_words if len(w) > 2 and w not in seeds)
    frequent = sorted(negatives, key=lambda w: (-clean_words[w], w))[:1_000]
    chosen = list(dict.fromkeys(
        frequent + [negatives[i] for i in rng.permutation(len(negatives))[:4_000]]))
    positives = set(seeds)
    model = constant
    for turn in range(turns):
        by_use = sorted(positives, key=lambda w: (-in_toxic[w], w))
        part = landmarks // 6
        top = by_use[:part] + [by_use[part:][i] for i in rng.permutation(
            max(len(by_use) - part, 0))[:part]]
        # Most of the other landmarks are the latest words that came too near.
        late = chosen[-2 * (landmarks - len(top)) // 3:]
        rest = chosen[:len(chosen) - len(late)]
        marks = top + late + [rest[i] for i in rng.permutation(len(rest))[
            :landmarks - len(top) - len(late)]]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        names = by_use + chosen
        x = np.column_stack([kernel(names, marks) @ root, np.ones(len(names))])
        y = np.array([1.0] * len(by_use) + [-1.0] * len(chosen))
        # A clean word that scores high spoils every document that holds it: they weigh more.
        uses = np.sqrt([in_toxic[w] for w in by_use])
        held = np.sqrt([clean_words[w] for w in chosen])
        weight = np.append(uses / uses.sum(), CLEAN_WEIGHT * held / held.sum())
        # The same words with a letter put in or doubled, of half the weight together.
        spoilt = [(w, u) for w, u in zip(by_use[:landmarks], uses) if len(w) > 3]
        if spoilt:
            more = [_spoilt(w, rng) for w, _ in spoilt for _ in range(4)]
            x = np.vstack([x, np.column_stack([kernel(more, marks) @ root, np.ones(len(more))])])
            y = np.append(y, np.ones(len(more)))
            shares = np.repeat([u for _, u in spoilt], 4)
            weight = np.append(weight, 0.5 * shares / shares.sum())
        w = squared_hinge(x, y, weight, PENALTY)
        folded = np.zeros(CLASSES ** 3)
        for mark, b in zip(marks, root @ w[:-1]):
            for code, value in features(mark).items():
                folded[code] += b * value
        model = Model(folded.astype(np.float32), float(w[-1]), constant.curve)
        if turn == turns - 1:
            break
        # The negatives that come nearest, and the highest new word of every toxic document.
        scores = model.word_values(negatives)
        known = set(chosen)
        chosen += [negatives[i] for i in np.argsort(scores)[-1_500:]
                   if negatives[i] not in known and scores[i] > -0.8]
        positives = set(seeds)
        for bag in bags:
            new = [w for w in bag if w not in clean_words]
            if new and not any(w in seeds for w in bag):
                scores = model.word_values(new)
                if scores.max() > 0:
                    positives.add(new[int(scores.argmax())])
    x = np.concatenate([model.text_values([t]) for t in [*toxic, *clean]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    curve = _logistic(x, y)
    if curve[0] < 0:  # the count says it all: a higher word never makes a text less toxic
        curve = np.append(0.0, _logistic(x[:, 1:], y))
    model = Model(model.weights, model.bias, tuple(map(float, curve)))
    missed = [t for t, score in zip(toxic, model.probabilities(toxic)) if score < THRESHOLD]
    return _with_phrases(model, missed, toxic, clean, rng)


def _with_phrases(model: Model, missed: list[str], toxic: list[str], clean: list[str], rng) -> Model:
    """The model with a machine for the phrases of the missed toxic texts, if they share any."""
    some = [missed[i] for i in sorted(rng.permutation(len(missed))[:PHRASE_DOCS])]
    found = phrases.train(some, clean, lambda x, y, weight: squared_hinge(x, y, weight, PENALTY), rng)
    if found is None:
        return model
    both = Model(model.weights, model.bias, model.curve, found)
    x = np.concatenate([both.text_values([t]) for t in [*toxic, *clean]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    curve = _logistic(x, y)
    if curve[0] < 0:
        curve = np.append(0.0, _logistic(x[:, 1:], y))
    return Model(model.weights, model.bias, tuple(map(float, curve)), found) if curve[3] > 0 else model


def _spoilt(word: str, rng) -> str:
    """The word with a letter, a or z or its neighbour's, put in somewhere inside."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + (word[at - 1], "x", "a", "z")[int(rng.integers(4))] + word[at:]


def _seed_words(bags: list[list[str]], clean_words: Counter, n_toxic: int, n_clean: int) -> set:
    """Words of toxic documents that hardly any clean one holds, themselves or by their stems.

    A stem is a word's first three to six letters. Its log likelihood ratio has to be that of
    ``SEED_DOCS`` toxic documents without any clean one, which chance rarely brings about.
    """
    def stems(word):
        return {word, *(word[:n] for n in range(3, 7) if len(word) > n)}

    in_toxic = Counter()
    for bag in bags:
        in_toxic.update({("" if stem == word else "+") + stem for word in bag
                         for stem in stems(word)})
    in_clean = Counter()
    for word, n in clean_words.items():
        for stem in stems(word):
            # Words of one stem may share documents: this bounds a stem's documents from above.
            in_clean[("" if stem == word else "+") + stem] += n
    base = n_toxic / (n_toxic + n_clean)

    def ratio(stem):
        a, b = in_toxic[stem], in_clean[stem]
        p = a / (a + b)
        if p <= 0.8:
            return 0.0
        return a * np.log(p / base) + (b * np.log((1 - p) / (1 - base)) if b else 0.0)

    least = -SEED_DOCS * np.log(base)
    strong = {stem for stem in in_toxic if ratio(stem) >= least}
    return {word for bag in bags for word in bag if clean_words[word] * 20 <= in_toxic[word]
            and any(("" if stem == word else "+") + stem in strong for stem in stems(word))}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_texts(documents: DataFrame, labels: DataFrame, sample_docs: int,
                   sample_chars: int) -> DataFrame:
    """(toxic, text) of at most ``sample_docs`` documents of either label, none of them held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                         & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = documents.where(F.length("text").between(1, sample_chars)).select("doc_id", "text")
    # Twice as many ids as texts are wanted are drawn by hash; long texts drop out.
    ids = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        sample_docs * 2) for label in (1, 0)]
    rows = short.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    drawn = [rows.where(F.col("toxic") == label).orderBy(
        F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs) for label in (1, 0)]
    return drawn[0].unionByName(drawn[1]).select(F.col("toxic").cast("int").alias("toxic"), "text")


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
        sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train in one task, on the bounded sample; only the model comes back to the driver."""
    prepare_workers(documents.sparkSession)
    sample = training_texts(documents, labels, sample_docs, sample_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: tuple[list[str], list[str]] = ([], [])
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                texts[1 - int(toxic)].append(text)
        model = train(sorted(texts[0]), sorted(texts[1]))
        found = model.phrases
        yield pd.DataFrame([(model.weights.tobytes(), model.bias, list(model.curve), *(
            (found.codes.tobytes(), found.weights.tobytes(), found.bias) if found else (b"", b"", 0.0)))],
            columns=["weights", "bias", "curve", "codes", "code_weights", "code_bias"])

    row = sample.repartition(1).mapInPandas(
        run, "weights binary, bias double, curve array<double>, codes binary, code_weights binary, "
        "code_bias double").first()
    if row is None:  # no labelled row at all, so no task had any to train on
        return train([], [])
    found = phrases.Phrases(np.frombuffer(bytes(row.codes), np.uint64), np.frombuffer(
        bytes(row.code_weights), np.float64), row.code_bias) if len(row.codes) else None
    return Model(np.frombuffer(bytes(row.weights), dtype=np.float32), row.bias, tuple(row.curve), found)


def score_texts(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns with score and predicted, which replace columns of these names."""
    spark = documents.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.probabilities(list(texts)), dtype="float64")

    scored = packed(documents, "text").withColumn("_score", probability(F.col("text")))
    return scored.select(*unpacked(
        documents.columns, ("text",), score=F.col("_score"),
        predicted=(F.col("_score") >= threshold).cast("int")))
