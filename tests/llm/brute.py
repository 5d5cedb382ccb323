"""Plain versions of the contracts over lists of (doc_id, text), for small fixtures."""

import bisect
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

W = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words_removed(docs):
    """op3."""
    named = [(i, W.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in named:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in named:
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def bytes_removed(docs):
    """op5."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def contamination(docs, items):
    """op4."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, own = word.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return out


def near(docs):
    """op10."""
    sets = []
    for i, t in docs:
        w = W.findall(low(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            r = sets[b][1]
            if s and r and 100 * len(s & r) >= 75 * len(s | r):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(s), least.get(find(a)), i == least.get(find(a))) for a, (i, s) in enumerate(sets)]


def lines(docs, shingle=9, percent=75):
    """op1 for docs with ids."""

    def norm(x):
        return " ".join(W.findall(low(x)))

    first = {}
    for i, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            if norm(x):
                first[norm(x)] = min(first.get(norm(x), (i, p)), (i, p))
    sets = {x: {x[k : k + shingle] for k in range(len(x) - shingle + 1)} or {x} for x in first}
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(first)
    for a, x in enumerate(names):
        for y in names[:a]:
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    best = {}
    for x in names:
        best[find(x)] = min(best.get(find(x), (1 << 60, 0)), first[x])
    out = []
    for i, t in docs:
        n, less, kept = 0, 0, []
        for p, x in enumerate((t or "").split("\n")):
            if norm(x):
                n += 1
                if best[find(norm(x))] != (i, p):
                    less += 1
                    continue
            kept.append(x)
        out.append((i, n, less, sha("\n".join(kept) if less else t or "")))
    return out


def quality(docs):
    """op7's base columns."""
    out = []
    for i, t in docs:
        t = t or ""
        w, full = W.findall(t), [x for x in t.split("\n") if W.search(x)]
        c, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                covered |= set(range(k, k + 8))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    return out


def base_pii(docs):
    """op2's base columns."""
    kinds = (
        (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda x: True),
        (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda x: all(int(p) <= 255 for p in x.split("."))),
        (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d)),
        (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
    )

    def luhn(d):
        total = 0
        for k, c in enumerate(d[::-1]):
            x = int(c) * (1 + k % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    names, out = ("email", "ip", "card", "phone"), []
    for i, t in docs:
        found = sorted((m.start(), k, m.end()) for k, (r, ok) in enumerate(kinds) for m in r.finditer(t or "") if ok(m[0]))
        out.append((i, *(sum(x[1] == k for x in found) for k in range(4)), sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found))))
    return out


def unigram(docs):
    """op6's base columns; a null id is no held-out one."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    tokens = [[*W.findall(low(t)), "<end> "] for _, t in docs]
    c = Counter(x for h, w in zip(held, tokens) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for (i, _), h, w in zip(docs, held, tokens)]


def similar(docs, shingle=4, percent=85):
    """op11."""
    sets = []
    for i, t in docs:
        w = W.findall(low(t))
        sets.append((i, {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()))
    component = list(range(len(sets)))
    for a, (_, s) in enumerate(sets):
        for b in range(a):
            r = sets[b][1]
            if s and r and 100 * len(s & r) >= percent * len(s | r):
                component = [component[b] if c == component[a] else c for c in component]
    ids = lambda c: [i for (i, _), x in zip(sets, component) if x == c and i is not None]
    return [(i, len(s), min(ids(c), default=None)) for (i, s), c in zip(sets, component)]


def clusters(vectors, k=16, rounds=3):
    """op12."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{r[0]}"), r[1]))[:k]]
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for r in range(rounds + 1):
        own = [min((gap(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            mine = [[v for (_, v), (_, n) in zip(kept, own) if n == c] for c in range(len(centroids))]
            centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    return [(i, n, d, sum(x for x, y in own if y == n), sum(x for x, _ in own), sha(",".join(map(str, centroids[n])))) for (i, _), (d, n) in zip(kept, own)]


def alignment(docs, a_path, b_path):
    """op13, with the libraries' own encoders and by byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    side_a, side_b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    side_a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def ranges(tokens):
        ends = list(itertools.accumulate(map(len, tokens)))
        return list(zip([0, *ends], ends))

    out, counts = [], Counter()
    for i, t in docs:
        a = side_a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = side_b.encode(t) if t else []
        of_a = [bytes(letter[c] for c in side_a.id_to_token(x)) for x in a]
        of_b = [piece(side_b.IdToPiece(x)) for x in b]
        if not t or b"".join(of_a) != (" " + t).encode() or b"".join(of_b) != (" " + t).encode():
            out.append((i, [], [], [], []))
            continue
        ra, rb = ranges(of_a), ranges(of_b)
        links, start = [], 0
        for x, (s, e) in enumerate(ra):
            while rb[start][1] <= s:
                start += 1
            y = start
            while y < len(rb) and rb[y][0] < e:
                links.append((a[x], b[y]))
                y += 1
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        ga, gb = ([bisect.bisect_left([e for _, e in r], c) + 1 for c in cuts] for r in (ra, rb))
        groups = [(a[p:x], b[q:y]) for p, x, q, y in zip([0, *ga], ga, [0, *gb], gb)]
        counts.update(links)
        out.append((i, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(i, len(a), len(b), len(g), len(n), sum(counts[x] == best[x[1]] for x in n), sum(counts[x] for x in n), sha(text(g)) if g else "") for i, a, b, g, n in out]
