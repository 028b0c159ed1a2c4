"""Small documents with every awkward case, and a brute-force near-duplicate search."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns carry names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, kept int, component string, row string, value string, band int, n long, block int"


def documents(spark, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))

    base, line = prose(120), [prose(9) for _ in range(12)]
    texts = [None, "", " ", "\n\n\n\n", "one", "One two", "one two", "a b c d e", base, base, base.upper(), base + " tail"]
    for _ in range(25):  # near copies at all distances
        words = base.split(" ")
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["\n".join(line[i : i + 6]) for i in range(6)] + ["x\nx\nx\nx\nx", "\n".join(line) + "\n" + "\n".join(line)]
    texts += ["token = 'abcdef123456' and AKIA" + "A1" * 12, "password: hunter2 deadbeef" + "0123456789abcdef" * 2, "ſecret=abcdefgh é" + " token=abcdefgh", "AKIA" + "Z9" * 10]
    texts += ["<|endoftext|> don't  stop\t\n ok\x1c\x85　x ½ é İ 漢字 🙂", "é" * 3000, prose(20000), "a" * 5000, prose(40) + " | | | |", "BUY!! NOW!! " * 30, "for " * 90]
    texts += [prose(rnd.randrange(1, 60)) for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        lang = rnd.choice(["en", "de", "fr", None])
        rows.append((i * 3 + 1, t, lang, rnd.choice(["s0", "s1", None]), None if t is None else len(t)))
    rows += [rows[8], rows[8], (None, base, "en", "s0", 1), (None, None, None, None, None)]  # repeated rows, null ids
    rnd.shuffle(rows)
    return spark.createDataFrame([(*r, 7, "clash", 1, "c", "r", "v", 2, 3, 4) for r in rows], SCHEMA).repartition(4)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(texts):
    """{id: smallest id reachable} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}
