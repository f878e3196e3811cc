"""Plain Python versions of the operators' contracts, and rows that ask for trouble."""

import hashlib
import random
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n, size=400):
    return " ".join(rng.choice(WORDS[:size]) for _ in range(n))


_rng = random.Random(5)
WORDS = ["".join(_rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(_rng.randint(2, 7))) for _ in range(2000)]


def changed(rng, text, share):
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = rng.choice(WORDS)
    return " ".join(words)


def odd_documents(seed=1, groups=6):
    """Documents with nulls, empties, repeats, a long text, copies and near copies."""
    rng = random.Random(seed)
    rows = [(None, None, None, None, None), (1, None, "en", "s1", None), (2, "", "en", None, 0), (3, " \t\n\x0b ", None, "s1", 5),
            (4, "one two", "en", "s2", 7), (5, "one two", "en", "s2", 7), (5, "one two", "en", "s2", 7), (6, "ONE  two", "de", "é", 8),
            (7, "w " * 20000, "en", "s1", 40000), (8, prose(rng, 30000), "fr", "s1", 0), (None, "x y z v w q", "en", "s3", 1)]
    for g in range(groups):
        base = prose(rng, rng.randint(30, 200), 2000)
        for k in range(rng.randint(1, 9)):
            rows.append((100 * (g + 1) + k, changed(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.08])), "en", f"s{g % 3}", 1))
    return rows


def shingles(text):
    words = SPACED.findall((text or "").translate(UPPER))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    """(doc_id, set size, component) per row: rows are nodes, so repeated ids do no harm."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), ids.get(find(i))) for i, r in enumerate(rows)]


def contamination(rows, items):
    windows = {}
    for item, text in items:
        words = BENCH.findall((text or "").translate(UPPER))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text, *_ in rows:
        words = BENCH.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i:i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[w]
        n = len(hit)
        out.append((doc, len(words), n, sorted(found), n > 0 and 20 * n >= len(words)))
    return out


def base_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    triples = {}
    for i in range(len(words) - 2):
        triples.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {p + k for v in triples.values() if len(v) > 1 for p in v for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def key(row):
    return repr(row)
