"""Plain versions of what the operators compute, and small tables to run them on."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


#: null and empty texts, null ids, repeated rows, ties, few words, one very long text
EDGES = [
    (1, None), (2, ""), (3, "one"), (4, "  \n\t "), (5, "one"), (5, "one"), (None, "no id here at all"), (None, None),
    (6, "word " * 30_000), (7, "é.È 日本語 <|endoftext|> don't"), (8, "a b c d"), (9, "A b C d"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = lower_words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(texts, percent=80):
    """Index of the first linked text in reach of each text."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def hits(text, items, window=10):
    """(number of hit words, sorted ids of items with occurring windows)."""
    w = alnum_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        x = alnum_words(item)
        n = min(window, len(x))
        wanted = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in wanted:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(hit), sorted(found)
