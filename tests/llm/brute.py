"""Plain Python versions of the queries, straight from their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[low(t)].append(i)
    return {(i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in docs}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(docs):
    sets = [shingles(t) for _, t in docs]
    owners = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            owners[x].append(k)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for o in owners[x]:
                if o < k:
                    shared[o] += 1
        for o, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[o]) - n):
                root[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(docs)}


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contamination(docs, benchmark):
    owners = defaultdict(set)
    for item, text in benchmark:
        w = words10(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            owners[tuple(w[i : i + 10])].add(item)
    sizes = {len(x) for x in owners}
    out = set()
    for i, text in docs:
        w = words10(text)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = owners.get(tuple(w[k : k + n]))
                if found:
                    items |= found
                    hit.update(range(k, k + n))
        told = ",".join(sorted(map(str, items)))
        out.add((i, len(w), len(hit), len(items), hashlib.sha256(told.encode()).hexdigest(), bool(hit)))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
