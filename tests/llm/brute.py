"""Plain single-machine versions of the text operators."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def words_of(text):
    return WORDS.findall(text or "")


def base_rules(text):
    text = text or ""
    words = words_of(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def ids_digest(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def round_trip(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(ids_digest(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def stored(tokenizer, rows):
    start, out = 0, {}
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), zlib.crc32(ids_digest(ids)))
        start += len(ids)
    return out


def shingles(text, width):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in words_of(text)]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def smallest(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_classes(rows, width, percent=80):
    """doc_id -> (set size, component) by comparing all sets that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    index = {i: k for k, i in enumerate(sorted(sets))}
    ids = sorted(sets)
    common = np.zeros((len(ids), len(ids)), dtype=np.int32)
    for members in by.values():
        if len(members) > 1:
            at = np.array([index[m] for m in members])
            common[np.ix_(at, at)] += 1
    n = np.array([len(sets[i]) for i in ids])
    linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (common > 0)
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked)) if a < b]
    component = smallest(pairs, ids)
    return {i: (len(sets[i]), component[i]) for i in ids}


def removed_lines(rows, width=5, percent=80, min_words=1):
    """(doc_id, line) of lines with an earlier line of that similarity; rows is (doc_id, text)."""
    lines = []
    for doc_id, text in sorted((i, t) for i, t in rows if i is not None and t is not None):
        for n, line in enumerate(text.split("\n")):
            words = words_of(line)
            if len(words) >= min_words:
                grams = frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
                lines.append((doc_id, n, grams))
    by, gone = defaultdict(list), set()
    for k, (doc_id, n, grams) in enumerate(lines):
        common = Counter(e for g in grams for e in by[g])
        if any(100 * c >= percent * (len(grams) + len(lines[e][2]) - c) for e, c in common.items()):
            gone.add((doc_id, n))
        for g in grams:
            by[g].append(k)
    return gone


TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text):
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t]


def best_run(equal, percent=80):
    score = count = best = 0
    for e in equal:
        score += 100 - percent if e else -percent
        count += e
        if score < 0:
            score = count = 0
        best = max(best, count)
    return best


def overlaps(rows, items, masks, min_equal=10, percent=80):
    """(doc_id, item_id) -> most equal tokens, by trying every alignment with a spaced-seed hit."""
    seeds = defaultdict(set)
    texts = {}
    for item_id, text in sorted(items, reverse=True):
        texts[tuple(tokens_of(text))] = item_id
    for h, item_id in texts.items():
        for m, mask in enumerate(masks):
            for p in range(len(h) - len(mask) + 1):
                seeds[(m, *[h[p + i] for i, c in enumerate(mask) if c == "1"])].add((item_id, h, p))
    out = {}
    for doc_id, text in rows:
        d, seen = tokens_of(text), set()
        for m, mask in enumerate(masks):
            at = [i for i, c in enumerate(mask) if c == "1"]
            for p in range(len(d) - len(mask) + 1):
                for item_id, h, q in seeds.get((m, *[d[p + i] for i in at]), ()):
                    seen.add((item_id, h, p - q))
        for item_id, h, shift in seen:
            equal = [d[i + shift] == h[i] for i in range(len(h)) if 0 <= i + shift < len(d)]
            n = best_run(equal, percent)
            if n >= min(min_equal, len(h)):
                out[doc_id, item_id] = max(n, out.get((doc_id, item_id), 0))
    return out


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    """(kind, start, end) of the base formats."""
    out = []
    for kind, pattern in PII:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out
