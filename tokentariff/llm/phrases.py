"""A subsequence-kernel machine on the words of sentences, for insults made of ordinary words.

An example is a span of at most SPAN words of a sentence. The kernel compares two spans by their
subsequences of three words, gaps allowed: one that spans s words (at most REACH) counts decay ** s, and a
span's features are divided by a number that depends on its length alone. So words put into a
phrase are gaps. Negative examples are spans of clean sentences; positive is, of each toxic document, the
span with the most subsequences that toxic documents share and clean ones don't hold. The kernel
is approximated on landmarks (positive and negative spans), a linear machine with squared hinge loss is trained on
the Nystroem features, once more with the clean spans that score highest, and folds into a weight for each
subsequence of the landmarks. A text's value is that of its best span.

Words are runs of letters in lower case. A text without a known subsequence has the value NOTHING.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tokentariff.llm.shingles import WordHashes, mixed

SPAN, REACH, DECAY = 8, 6, 0.8
PATTERNS = [(j, k) for k in range(2, REACH) for j in range(1, k)]
LEAST_DOCS = 6        # toxic documents that share a subsequence, and none clean
LANDMARKS = 128
NEGATIVES, HARD = 1_500, 500
NOTHING = -2.0
MARKS_BITS = 20
_ENDS = b".!?\n\r"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    10 if b in _ENDS else b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS else 32
    for b in range(256))
_FIRST, _SECOND, _THIRD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F),
                           np.uint64(0x165667B19E3779F9))


def words_of(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the number of the sentence of each."""
    found, sizes = [], []
    for sentence in (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n"):
        words = sentence.split()
        found += words
        sizes.append(len(words))
    return hashes.of(found), np.repeat(np.arange(len(sizes)), sizes)


def codes_of(words: np.ndarray, sentence: np.ndarray, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences with these gaps, and where they begin."""
    n = len(words) - k
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(sentence[:n] == sentence[k:])
    return mixed(words[at] * _FIRST + words[at + j] * _SECOND + words[at + k] * _THIRD), at


def all_codes(words: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([codes_of(words, sentence, j, k)[0] for j, k in PATTERNS]))


def _norm(length: int) -> float:
    total = sum(max(length - k, 0) * DECAY ** (2 * (k + 1)) for _, k in PATTERNS)
    return total ** 0.5 if total else 1.0


NORMS = np.array([_norm(n) for n in range(SPAN + 1)])


def features(span: np.ndarray) -> dict[int, float]:
    """Subsequences of a span with their decayed counts, normalised."""
    found: dict[int, float] = {}
    same = np.zeros(len(span), int)
    for j, k in PATTERNS:
        for code in codes_of(span, same, j, k)[0].tolist():
            found[code] = found.get(code, 0.0) + DECAY ** (k + 1) / NORMS[len(span)]
    return found


def kernel(spans: list[dict], others: list[dict]) -> np.ndarray:
    table: dict[int, list[tuple[int, float]]] = {}
    for column, other in enumerate(others):
        for code, value in other.items():
            table.setdefault(code, []).append((column, value))
    out = np.zeros((len(spans), len(others)))
    for row, span in enumerate(spans):
        for code, value in span.items():
            for column, other in table.get(code, ()):
                out[row, column] += value * other
    return out


def window_sums(words: np.ndarray, sentence: np.ndarray, weigh) -> np.ndarray:
    """Kernel expansion of the span that begins at each word; ``weigh`` gives weights of codes."""
    n = len(words)
    by_reach = np.zeros((REACH, n))
    for j, k in PATTERNS:
        codes, at = codes_of(words, sentence, j, k)
        if len(at):
            by_reach[k][at] += weigh(codes) * DECAY ** (k + 1)
    total = np.zeros(n)
    for k in range(2, REACH):
        for d in range(0, SPAN - k):
            shifted = by_reach[k][d:]
            total[:n - d] += np.where(sentence[d:] == sentence[:n - d], shifted, 0)
    # Words from each place to the end of its sentence, at most a span.
    ends = np.searchsorted(sentence, sentence, side="right")
    return total / NORMS[np.minimum(ends - np.arange(n), SPAN)]


@dataclass
class Phrases:
    codes: np.ndarray    # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << MARKS_BITS, bool)
        self.seen[self.codes & np.uint64((1 << MARKS_BITS) - 1)] = True

    def weigh(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        at = np.flatnonzero(self.seen[codes & np.uint64((1 << MARKS_BITS) - 1)])
        if len(at):
            place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
            out[at] = np.where(self.codes[place] == codes[at], self.weights[place], 0)
        return out

    def value(self, text: str | None, hashes: WordHashes) -> float:
        words, sentence = words_of(text, hashes)
        if len(words) < 3:
            return NOTHING
        sums = window_sums(words, sentence, self.weigh)
        return max(NOTHING, float(sums.max()) + self.bias) if sums.any() else NOTHING


def train(toxic: list[str], clean: list[str], fit, rng) -> Phrases | None:
    """Learn from toxic texts that share no telling word; None if they share no phrase either.
    ``fit(x, y, weight)`` trains the linear machine."""
    hashes = WordHashes()
    held = [words_of(text, hashes) for text in toxic]
    codes = [all_codes(*one) for one in held if len(one[0]) > 2]
    if len(codes) < LEAST_DOCS:
        return None
    found, docs = np.unique(np.concatenate(codes), return_counts=True)
    found, docs = found[docs >= LEAST_DOCS], docs[docs >= LEAST_DOCS]
    if not len(found):
        return None
    clean_words = [words_of(text, hashes) for text in clean]
    in_clean = np.zeros(len(found), int)
    for words, sentence in clean_words:
        if len(words) > 2:
            mine = all_codes(words, sentence)
            at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
            in_clean[at[found[at] == mine]] += 1
    seeds = found[in_clean * 50 <= docs]
    if not len(seeds):
        return None
    chosen = Phrases(seeds, np.ones(len(seeds)), 0.0)
    positives = []
    for words, sentence in held:
        sums = window_sums(words, sentence, chosen.weigh) if len(words) > 2 else np.zeros(1)
        if sums.max() > 0:
            i = int(sums.argmax())
            positives.append(words[i:i + SPAN][sentence[i:i + SPAN] == sentence[i]])
    if len(positives) < LEAST_DOCS:
        return None
    spans = [(one, i) for one, (words, _) in enumerate(clean_words) for i in range(0, len(words), SPAN)]
    picked = [spans[i] for i in rng.permutation(len(spans))[:NEGATIVES]]

    def cut(one: int, i: int) -> np.ndarray:
        words, sentence = clean_words[one]
        return words[i:i + SPAN][sentence[i:i + SPAN] == sentence[i]]

    model = chosen
    for _ in range(2):
        hard = []
        for one, (words, sentence) in enumerate(clean_words):
            sums = window_sums(words, sentence, model.weigh) if len(words) > 2 else np.zeros(1)
            if sums.max() > 0:
                hard.append((-float(sums.max()), one, int(sums.argmax())))
        hard = [(one, i) for _, one, i in sorted(hard)[:HARD]]
        plus = [features(span) for span in positives]
        minus = [features(cut(*span)) for span in [*hard, *picked]]
        half = LANDMARKS // 2
        marks = [plus[i] for i in rng.permutation(len(plus))[:half]] + minus[:LANDMARKS - half]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        rows = plus + minus
        x = np.column_stack([kernel(rows, marks) @ root, np.ones(len(rows))])
        y = np.array([1.0] * len(plus) + [-1.0] * len(minus))
        weight = np.where(y > 0, 1.0 / len(plus), 1.0 / len(minus))
        w = fit(x, y, weight)
        folded: dict[int, float] = {}
        for mark, b in zip(marks, root @ w[:-1]):
            for code, value in mark.items():
                folded[code] = folded.get(code, 0.0) + b * value
        names = np.array(sorted(folded), np.uint64)
        model = Phrases(names, np.array([folded[c] for c in names.tolist()]), float(w[-1]))
    return model
