"""Plain versions of the operators, a document at a time or a pair at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

PLAIN = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeated_bytes(docs, least=200):
    texts = [(doc, (t or "").encode()) for doc, t in docs]
    seen = Counter(t[s : s + least] for _, t in texts for s in range(len(t) - least + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - least + 1):
            if seen[t[s : s + least]] > 1:
                gone[s : s + least] = b"\1" * least
        spans = len(re.findall(b"\1+", gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality_counts(text):
    words = PLAIN.findall(text or "")
    lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def fingerprint(text, size=4):
    words = PLAIN.findall((text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, most=4, size=4):
    prints = [fingerprint(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least.setdefault(find(i), []).append(doc)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(doc, f"{prints[i]:016x}", known[find(i)]) for i, (doc, _) in enumerate(docs)]


def licenses(text, phrases):
    words = ALNUM.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def byte_grams(text, n):
    raw = f" {text.lower()} ".encode("utf-8", "surrogatepass")
    raw = raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ")
    return [int.from_bytes(raw[i : i + n], "big") for i in range(len(raw) - n + 1)]


def language_grams(labelled, sizes, min_share):
    """language -> (size, n-gram) of those that make up min_share of its n-grams and are there twice at least."""
    out = {}
    for language in {x for _, x in labelled}:
        for n in sizes:
            counts = Counter(g for text, x in labelled if x == language for g in byte_grams(text, n))
            least = max(2, sum(counts.values()) * min_share)
            out.setdefault(language, []).extend((n, g) for g, times in counts.items() if times >= least)
    return out


def gram_cells(gram, n, cells, hashes):
    mask = (1 << 64) - 1
    x = (gram + (n << 56)) * 0x9E3779B97F4A7C15 & mask
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 32
    return [((x & 0xFFFFFFFF) + k * (x >> 32 | 1) & mask) % cells for k in range(hashes)]


def language(text, languages, table, sizes, hashes):
    """table: cell -> set of languages' numbers. An n-gram at a time."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    cells = len(table)
    false = [(sum(i in x for x in table) / cells) ** hashes for i in range(len(languages))]
    hits, total = [0] * len(languages), 0
    for n in sizes:
        for g in byte_grams(text, n):
            total += 1
            for i in set.intersection(*(table[c] for c in gram_cells(g, n, cells, hashes))):
                hits[i] += 1
    real = [max(0.0, (h - f * total) / (1 - min(f, 0.999))) for h, f in zip(hits, false, strict=True)]
    best = max(range(len(languages)), key=lambda i: (real[i], -i))
    return languages[best], min(1.0, real[best] / sum(real)) if sum(real) else 0.0


def license_labels(text, rules, phrases, base_weight=0.6):
    """Every rule over the whole text, and every detection against every other."""
    words = ALNUM.findall((text or "").translate(LOWER))
    joined, found = " " + " ".join(words) + " ", []
    for order, label, priority, weight, pattern in rules:
        for m in re.finditer(pattern, joined):
            first = joined[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" ") + 1, label, priority, weight, order))
    rank = lambda x: (-x[3], x[0] - x[1], x[5], x[0])
    kept = []
    for x in sorted(found, key=rank):
        if not any(y[0] <= x[0] and y[1] >= x[1] for y in kept):
            kept.append(x)
    base = [label for phrase, label in phrases.items() if f" {phrase} " in joined]
    return ",".join(sorted({x[2] for x in kept} | set(base))), max([x[4] for x in kept] + [base_weight] * bool(base), default=0.0)


def url_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence(docs, min_docs=10, top=10):
    """docs: (text, lang, source). Every group over every kept term."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        often = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in often.items() if n >= min_docs)
        counts = {s: Counter(t for _, x, w in own if x == s for t in w) for s in {d[1] for d in own}}
        counts[None] = sum(counts.values(), Counter())
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in set(counts) - {None}:
            pairs = [(sum(f(p[s][t], p[x][t]) for t in kept), x) for x in set(counts) - {None, s}]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return out


def slipped(docs, least=7):
    """Words and their counts, with a letter left out of every 31st run."""
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, ratio=10):
    """Every word against every other."""
    form, near = {}, {}
    for w, n in words.items():
        own = [x for x in words if abs(len(x) - len(w)) < 2 and one_apart(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        near[w], form[w] = len(own), best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def jaccard(docs, size=3, percent=90):
    """Every document against every other."""
    sets = []
    for _, text in docs:
        w = PLAIN.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and percent * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    members = {}
    for i, (doc, _) in enumerate(docs):
        members.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)]


def near_copies(docs):
    """(id, least id of its group): fingerprints of five-word shingles within 4 bits, or 0.8 of five-word shingles. Ids are distinct."""
    root = {doc: doc for doc, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for doc, _, least in [*simhash(docs, size=5), *jaccard(docs, 5, 80)]:
        a, b = sorted((find(doc), find(least)))
        root[b] = a
    return [(doc, find(doc)) for doc, _ in docs]
