"""Plain Python versions of the operators, written for clarity and run on small inputs only."""

import hashlib
import math
import re

import numpy as np
import xxhash

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in GAP.split(text or "") if w]


def fingerprint(text, words=3):
    tokens = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def wide_fingerprint(text, words=5):
    """256 bits as a number."""
    tokens = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    votes = sum(np.array([int(c) for c in "".join(f"{xxhash.xxh3_128(s.encode(), seed=k).intdigest():0128b}" for k in (1, 2))]) * 2 - 1 for s in shingles)
    return int("".join("1" if v > 0 else "0" for v in votes), 2) if shingles else 0


def classes(prints, radius=3):
    """Smallest id reachable, from {id: fingerprint}."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    words = max(1, max(-(-int(p).bit_length() // 64) for p in prints.values()) if prints else 1)
    values = np.array([[int(prints[i]) >> 64 * w & (1 << 64) - 1 for w in range(words)] for i in ids], dtype=np.uint64).reshape(-1, words)
    for k, i in enumerate(ids):
        for j in np.nonzero(np.bitwise_count(values[k + 1 :] ^ values[k]).sum(axis=1, dtype=int) <= radius)[0]:
            a, b = root(i), root(ids[k + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words_of(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in windows if windows.count(g) > 1} if len(windows) < 800 else {g for g, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, g in enumerate(windows) if g in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


FURNITURE = (
    "all rights reserved|accept cookies|uses cookies|cookie policy|privacy policy|terms of service|terms of use|enable javascript|javascript is disabled|"
    "subscribe to our newsletter|sign up for our newsletter|click here to|share on facebook|share on twitter|skip to content|skip to main content|back to top|lorem ipsum"
)


def line_fails(line):
    n = len(words_of(line))
    count = lambda pattern: len(re.findall(pattern, line))
    return n > 0 and (
        (n >= 3 and count("[#*$%&|<>]") > 0.3 * n)
        or (n >= 3 and count("!!") > 0.3 * n)
        or (count("[|»›•·]") >= 3 and count("[|»›•·]") > 0.25 * n)
        or (n <= 20 and re.search(FURNITURE, line, re.I) is not None)
        or (n < 3 and re.search(r"""[.!?…。！？:;]["')\]”’»]*[\x20\x09-\x0D]*$""", line) is None)
    )


def cleaned(text):
    """The text without its failed lines; None if the document is rejected."""
    if quality(text)[-1]:
        return None
    left = "\n".join(x for x in (text or "").split("\n") if not line_fails(x))
    return left if len(words_of(text)) - len(words_of(left)) <= 0.5 * len(words_of(text)) else None


def redacted(text):
    """Base kinds and marked secrets replaced by their kinds; the first of overlapping spans names the replacement."""
    secrets = [("secret", m.start(1), m.end(1)) for m in re.finditer(r"""token = "([A-Za-z0-9+/_-]{32,})""", text)]
    out, at = "", 0
    for kind, start, end in sorted(base_spans(text) + secrets, key=lambda s: s[1]):
        if start >= at:
            out += f"{text[at:start]}<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


def draws(ids_sources, temperature=0.5, seed=1):
    """Copies of each (doc_id, source)."""
    counts = {}
    for _, s in ids_sources:
        counts[s] = counts.get(s, 0) + 1
    aims = {s: n**temperature for s, n in counts.items()}
    rates = {s: aims[s] * len(ids_sources) / sum(aims.values()) / n for s, n in counts.items()}
    out = []
    for i, s in ids_sources:
        u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rates[s])
        total = p
        while total < u:
            k += 1
            p *= rates[s] / k
            total += p
        out.append(k)
    return out
