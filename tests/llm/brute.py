"""Plain-Python versions of the training-data operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACED.findall(text or "")


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def jump_key(*parts):
    text = "".join("n" if p is None else f"{len(str(p))}:{p}" for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:16], 16)


def repeats(rows, window):
    """rows: (doc_id, text). -> [(doc_id, n_words, n_removed, kept)] in the rows' order."""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i:i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def benchmark_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(rows, items, window=10):
    """-> [(doc_id, n_words, n_hit, sorted item ids)]"""
    found = defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found[tuple(w[i:i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, ids = benchmark_words(text), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in found:
                    hit.update(range(i, i + n))
                    ids |= found[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(ids)))
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    w = words(text)
    grams = Counter(zip(*[w[i:] for i in range(5)]))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def shingles(text, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(rows, percent=85):
    """-> [(doc_id, n_shingles, component_id, kept)]; ids must be distinct and not null."""
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(doc, len(sets[doc]), root(doc), root(doc) == doc) for doc, _ in rows]


def drop_lines(pages, ratio_percent=10, least=10):
    """pages: (id, host, lines). -> [(id, kept lines)]"""
    total, shown = Counter(), Counter()
    for _, host, lines in pages:
        total[host] += 1
        for line in {x.strip(" ") for x in lines or []} - {""}:
            shown[host, line] += 1
    common = {k for k, n in shown.items() if total[k[0]] >= least and n * 100 > total[k[0]] * ratio_percent}
    return [(i, [x for x in lines or [] if (host, x.strip(" ")) not in common]) for i, host, lines in pages]
