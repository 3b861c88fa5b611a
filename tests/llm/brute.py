"""Plain Python versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w),
    }


def secrets(text):
    text, spans = text or "", []
    assign = re.compile(
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    spans += [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private(text):
    text, spans = text or "", []
    spans += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [
        ("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m))
    spans += [
        ("phone", m) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]
    return [(k, m.start(), m.end()) for k, m in spans]


def sha_of_spans(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Source -> target from source -> size, by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, fixed = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**fixed, **share}
        fixed.update({s: cap * sizes[s] for s in over})
        open_ -= over
        if not open_:
            return fixed


def shingles(text, width=3):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def linked(texts, width=3, percent=90):
    """Position -> smallest position reachable by links."""
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders[x] if j < i}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def repeats(texts, length=400):
    """Per text: n_bytes, n_removed, n_spans and digest of the remaining bytes."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def trie(rows):
    """Node rows from (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return [
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    ]


def phrases(rows, least=100, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text) rows."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = defaultdict(int)
    for (lang, g), a in found.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i : i + k]] = max(inside[lang, g[i : i + k]], a)
    out = defaultdict(list)
    for (lang, g), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        if 100 * inside[lang, g] < 100 * a:
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return [
        (lang, i, g.decode(), -a, l, r, n[lang], -s)
        for lang, rest in out.items() for i, (s, a, g, l, r) in enumerate(sorted(rest)[:top], 1)
    ]


def edits(rows):
    """(doc_id, text, edited text, next text) per different row, from (doc_id, text, tie) rows in descending id, null last."""
    kept = sorted({(d is None, -(d or 0), tie, t or "") for d, t, tie in rows})
    out = {}
    for (no_id, d, _, t), (*_, after) in zip(kept, kept[1:] + kept[:1], strict=True):
        half = len(t) // 2
        out[None if no_id else -d, t] = (t[: len(t) - half] + after[:half], after)
    return out


def word_shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def passage_words(texts, length=50):
    """Per text: words in runs of ``length`` words that start twice or more in all texts."""
    lists = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for w in lists:
        hit = {i + k for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for k in range(length)}
        out.append(len(hit))
    return out
