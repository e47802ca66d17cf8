"""Small documents with every awkward case, and plain versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", row string, size long, label long, copies string, `k` int, mark int"


def prose(rnd, n, words="the of and stone river light under water over green morning house walk quiet long bridge paper seven".split()):
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", "s", "ing", "er", "ly", "est"]) for _ in range(n))


def awkward(seed=1, n=40):
    """(doc_id, text) with nulls, empty and white-space texts, repeated rows, ties and one long text."""
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.randint(1, 120))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, "No id here at all, only a text."), (None, None), (103, "Ünïcödé 'tis 日本語 <|endoftext|> naïve\r\n"), (104, "!!! ... ###")]
    rows += [(105, prose(rnd, 9000)), (106, rows[3][1]), (107, rows[3][1].upper()), (108, rows[4][1] + " tail"), rows[5], rows[5]]
    return rows


def frame(spark, rows, extra=False):
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    if extra:
        return spark.createDataFrame([(*r, "x", 1, 2, "c", 3, 4) for r in full], EXTRA)
    return spark.createDataFrame(full, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def classes(sets, similar):
    """Smallest index reachable from each set by pairs that are similar."""
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(sets))]
