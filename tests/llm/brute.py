"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import xxhash

VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, shingle=3):
    words = VISIBLE.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, radius=3):
    """doc_id -> smallest id reachable."""
    marks = [(i, simhash(t)) for i, t in docs]
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(marks):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(marks)}


def decontaminate(items, docs, window=10):
    """(n_words, n_hit, ids as sorted strings) of each text."""
    windows = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[k:k + window]), set()).add(item)
    out = []
    for text in docs:
        words = ALNUM.findall(lower(text))
        hit, found = [0] * len(words), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                ids = windows.get(tuple(words[k:k + size]))
                if ids:
                    found |= ids
                    hit[k:k + size] = [1] * size
        out.append((len(words), sum(hit), sorted(str(i) for i in found if i is not None)))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = VISIBLE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if VISIBLE.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k:k + 3]), []).append(k)
    repeat = {k + d for ks in places.values() if len(ks) > 1 for k in ks for d in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat)


def water_fill(budget, children):
    """{key: tokens} from {key: (weight, cap)}: full children leave their rest to the others."""
    open_, given = {k: v for k, v in children.items() if v[0] > 0}, {k: 0 for k in children}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, cap) in open_.items() if cap * total <= budget * w]
        if not full:
            return given | {k: budget * w // total for k, (w, _) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[1]
            budget -= given[k]
    return given


def mixture(rows, levels, weights, share, epochs, seed):
    """[(doc_id, epoch)] from rows (doc_id, text, value of each level); weights: one function per level."""
    tokens = [len(VISIBLE.findall(r[1] or "")) for r in rows]
    paths = [tuple("-" if v is None else f"={v}" for v in r[2:]) for r in rows]

    def spread(prefix, budget):
        depth = len(prefix)
        if depth == levels:
            return {prefix: budget}
        children = {}
        for r, p, n in zip(rows, paths, tokens):
            if p[:depth] == prefix:
                w, cap = children.get(p[:depth + 1], (0, 0))
                children[p[:depth + 1]] = (weights[depth](r[2 + depth]), cap + n * epochs)
        out = {}
        for child, given in water_fill(budget, children).items():
            out |= spread(child, given)
        return out
    picked = []
    for leaf, given in spread((), int(sum(tokens) * share)).items():
        own = [(r, n) for r, p, n in zip(rows, paths, tokens) if p == leaf]
        total = sum(n for _, n in own)
        whole = given // total if total else 0

        def key(r):
            h = hashlib.md5(f"{seed}/{whole}/{'' if r[0] is None else r[0]}".encode()).hexdigest()
            return int(h[:15], 16), r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()
        upto = 0
        peers = {}
        for r, n in own:
            peers.setdefault(key(r), []).append((r, n))
        for k in sorted(peers):
            upto += sum(n for _, n in peers[k])
            extra = whole < epochs and upto <= given - whole * total
            for r, _ in peers[k]:
                picked += [(r[0], e) for e in range(whole + extra)]
    return picked
