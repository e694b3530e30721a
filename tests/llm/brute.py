"""Plain single-process versions of the operators, from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, percent):
    """doc_id: (n_shingles, component_id)."""
    sets, holders, shared = {}, defaultdict(list), Counter()
    for i, text in docs.items():
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    for own in holders.values():
        shared.update((a, b) for k, b in enumerate(own) for a in own[:k])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = smallest_reachable(docs, links)
    return {i: (len(sets[i]), found[i]) for i in docs}


def substring(docs, size=13):
    """doc_id: (n_words, kept words)."""
    first, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        covered = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k : k + size]), i) < i:
                covered[k : k + size] = [True] * size
        out[i] = (len(w), [x for x, c in zip(w, covered, strict=True) if not c])
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def url(value):
    """host and path."""
    if value is None or "://" not in value:
        return "", ""
    rest = re.split(r"[?#]", value.split("://", 1)[1], maxsplit=1)[0]
    cut = rest.find("/") if "/" in rest else len(rest)
    return rest[:cut].translate(LOWER), rest[cut:]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_em(patterns, n, kinds, rounds, silence, start=None):
    """EM in loops: the log likelihood, and the chance of good for each pattern."""
    r, total = len(patterns[0]), sum(n)
    fires = [[0.02] * r, [0.5] * r] + [[0.9 if j == k else 0.05 for j in range(r)] for k in kinds]
    share = [0.85, 0.05] + [0.1 / len(kinds) for _ in kinds]
    share = [s / sum(share) for s in share]
    first = [list(f) for f in fires]
    usual = [(sum(c for p, c in zip(patterns, n) if p[j] == 0) + 1) / (total + 2) for j in range(r)]
    abstains = [list(usual) for _ in fires]
    if start:
        share, fires = list(start[0]), [list(f) for f in start[1]]

    def chances():
        out, likely = [], 0.0
        for p, c in zip(patterns, n):
            own = []
            for s, f, t in zip(share, fires, abstains):
                for v, x, y in zip(p, f, t):
                    x = min(max(x, 1e-6), 1 - 1e-6)
                    s *= x * (1 - y) if v == -1 else (1 - x) * (1 - y) if v == 1 else y
                own.append(s)
            out.append([x / sum(own) for x in own])
            likely += c * math.log(sum(own))
        return out, likely

    now, likely = chances()
    for _ in range(rounds):
        held = [sum(c * w[k] for c, w in zip(n, now)) for k in range(len(share))]
        share = [(h + 1) / (total + len(share)) for h in held]
        for k in range(len(fires)):
            for j in range(r):
                hits = sum(c * w[k] for p, c, w in zip(patterns, n, now) if p[j] == -1)
                misses = sum(c * w[k] for p, c, w in zip(patterns, n, now) if p[j] == 1)
                if k:
                    fires[k][j] = (hits + 2 * first[k][j]) / (hits + misses + 2)
                else:
                    fires[k][j] = min((hits + 1e-3) / (hits + misses + 1), 0.5)
                if silence:
                    abstains[k][j] = (held[k] - hits - misses + 2 * usual[j]) / (held[k] + 2)
        for k, own in enumerate(kinds):
            fires[k + 2][own] = max(fires[k + 2][own], 0.5)
        before = now
        now, likely = chances()
        if max(abs(a - b) for x, y in zip(before, now) for a, b in zip(x, y)) < 1e-9:
            break
    return likely, [w[0] for w in now], (share, fires)


def posteriors(patterns, n, rounds=500):
    """The chance of good for each pattern of votes that n documents have; kinds of junk are chosen one by one."""
    r = len(patterns[0])
    kinds, (best, _, state) = [], _plain_em(patterns, n, [], rounds, True)
    while True:
        rest = [k for k in range(r) if k not in kinds and any(p[k] == -1 for p in patterns)]
        found = [(_plain_em(patterns, n, sorted(kinds + [k]), rounds, True)[0], -k) for k in rest]
        if not found or max(found)[0] - best <= (2 * r + 1) / 2 * math.log(max(sum(n), 2)):
            return _plain_em(patterns, n, kinds, rounds, False, state)[1]
        kinds = sorted(kinds + [-max(found)[1]])
        best, _, state = _plain_em(patterns, n, kinds, rounds, True)


def kd_tree(units, shards, hash_bits):
    """unit: shard, for units (name, weight, coordinates)."""
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update((name, first) for name, _, _ in own)
            return
        widths = [(max(u[2][d] for u in own) >> hash_bits) - (min(u[2][d] for u in own) >> hash_bits) for d in range(len(own[0][2]))]
        d = widths.index(max(widths))
        at, goal = Counter(), sum(u[1] for u in own) * (n // 2) / n
        for u in own:
            at[u[2][d]] += u[1]
        for value in sorted(at):
            if at[value] >= goal:
                break
            goal -= at[value]
        cut = value if goal >= at[value] / 2 else value - 1
        split([u for u in own if u[2][d] <= cut], first, n // 2)
        split([u for u in own if u[2][d] > cut], first + n // 2, n - n // 2)

    split(units, 0, shards)
    return out


def ppm_bits(learned, text, order=3):
    """The code length of a text's bytes after those of the learned texts, by PPM (method C, no exclusions)."""
    seen = defaultdict(Counter)
    start = b"\n" * order
    for t in learned:
        data = start + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, start + text.encode()
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            own = seen.get(data[i - k : i])
            if own:
                total = sum(own.values()) + len(own)
                if data[i] in own:
                    bits -= math.log2(own[data[i]] / total)
                    break
                bits -= math.log2(len(own) / total)
    return bits
