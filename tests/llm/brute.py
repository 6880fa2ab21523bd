"""Plain versions of what the operators compute, for small tables."""

import re
from collections import Counter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER) if lower else text or "")


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_components(docs, k):
    """{doc_id: (set size, component)} for unique ids."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in docs}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text, lower=False)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    lines = [s for s in (text or "").split("\n") if words(s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def without_repeats(docs, least=2, least_words=10):
    """{doc_id: (text left, sentences removed)} for unique ids: every run of least sentences and least_words words, of any length, is
    looked up; all its places but the first lose their sentences."""
    parts = {}
    for i, text in docs.items():
        text = text or ""
        found = [(m.group().translate(UPPER), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        sents, own = [], []
        for n, (w, _, end) in enumerate(found):
            own.append(w)
            after = found[n + 1][1] if n + 1 < len(found) else None
            if w[-1] in ".!?" or after is None or "\n" in text[end:after]:
                sents.append((own, found[n - len(own) + 1][1]))
                own = []
        parts[i] = sents
    seen, gone = set(), {i: set() for i in docs}
    for i in sorted(docs):
        for p in range(len(parts[i])):
            run, n = 0, 0
            for e, (own, _) in enumerate(parts[i][p:], p + 1):
                for w in own:
                    run = hash((run, w))
                n += len(own)
                if e - p >= least and n >= least_words:
                    if run in seen:
                        gone[i].update(range(p, e))
                    seen.add(run)
    out = {}
    for i, text in docs.items():
        s = parts[i]
        cuts = [0] + [at for _, at in s[1:]] + [len(text or "")]
        out[i] = ("".join((text or "")[cuts[n] : cuts[n + 1]] for n in range(len(s)) if n not in gone[i]) if s else text or "", len(gone[i]))
    return out
