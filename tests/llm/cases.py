"""Small documents with nulls, empty and long texts, ties, repeated rows, and plain versions of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rnd, n):
    return ["".join(rnd.choice("abcdefghiklmnoprstuvwé") for _ in range(rnd.randint(2, 9))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Rows of SCHEMA: prose, exact and near copies, shared lines and passages, a long text, null and empty ones."""
    rnd = random.Random(seed)
    words = vocabulary(rnd, 900)
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, line = prose(70), "All rights of this page 2024 reserved by us."
    texts = []
    for i in range(n):
        t = prose(rnd.randint(5, 160))
        if i % 7 == 0:
            t = prose(20) + " " + passage + " " + prose(15)
        if i % 5 == 0:
            t += "\n" + line.replace("2024", str(2000 + i)) + "\n" + prose(9)
        texts.append(t)
    for i in (3, 4, 8):
        copy = texts[i].split(" ")
        copy[len(copy) // 2] = "changed"
        texts += [texts[i], " ".join(copy)]
    texts += [None, "", "   ", "one", "12 !? --", prose(5000), "\n\n a  b\tc \n", texts[0], texts[0]]
    return [(i, t, "en" if i % 3 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def bench_words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingle_set(text):
    w = text.encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows, least=0.8):
    """doc_id -> smallest doc_id of its class, all pairs compared."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(r[0], r[1], shingle_set(r[1])) for r in rows if r[1] is not None]
    for i, (a, s, x) in enumerate(known):
        for b, t, y in known[:i]:
            if s == t or (x and y and len(x & y) / len(x | y) >= least):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}
