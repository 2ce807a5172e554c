"""Plain Python versions of what SQL can't express, or should not, at these sizes."""

import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(f"[^{BLANKS}]+", (text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def groups(texts, percent=75):
    """The smallest key of each key's group; ``texts`` maps keys to texts."""
    sets = {key: shingles(text) for key, text in texts.items()}
    leader = {key: key for key in texts}

    def find(key):
        while leader[key] != key:
            key = leader[key]
        return key

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                leader[y] = x
    return {key: find(key) for key in keys}


def without_repeated_lines(texts, shortest=40, least=5):
    """``texts`` maps document ids to texts."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders[key(line)].add(doc)
    return {doc: "\n".join(line for line in (text or "").split("\n")
                           if len(holders[key(line)]) < least or max(holders[key(line)]) == doc)
            for doc, text in texts.items()}


def clean_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hit_words(text, items, window=13):
    w, hit = clean_words(text), set()
    for item in items:
        v = clean_words(item)
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[j:j + n]:
                    hit.update(range(i, i + n))
    return len(hit), len(w)
