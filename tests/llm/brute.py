"""Plain-Python versions of the operators: lists, dictionaries, all pairs."""

import hashlib
import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict

import regex
import xxhash

from quarry.llm import packing, pii, quality, simhash

SPACE = " \t\n\x0b\f\r"


def failed_rules(text):
    t = text or ""
    words = regex.findall(f"[^{SPACE}]+", t)
    n, kinds = len(words), [unicodedata.category(c) for c in t]
    letters, lines = sum(k[0] == "L" for k in kinds), t.split("\n")
    tests = {
        "empty": n == 0,
        "symbols": n > 0 and sum(c in "#$%&*!|~^<>{}=" for c in t) > 0.04 * len(t),
        "shouting": n > 0 and letters >= 20 and sum(k == "Lu" for k in kinds) > 0.5 * letters,
        "tables": n > 0 and t.count("|") > 0.2 * n,
        "repeats": n >= 10 and sum(a == b for a, b in zip(words, words[1:])) > 0.2 * n,
        "dup_lines": n > 0 and len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines),
        "word_length": n > 0 and sum(map(len, words)) > 30 * n,
    }
    return [r for r in quality.RULES if tests[r]]


def good(rows):
    """The (id, text, host) rows that pass."""
    bad = [failed_rules(t) for _, t, _ in rows]
    hosts = defaultdict(lambda: (0, Counter()))
    for (_, _, h), f in zip(rows, bad):
        n, c = hosts[h]
        hosts[h] = n + 1, c + Counter(f)
    worst = dict.fromkeys(hosts, 0.0)
    for rule in quality.RULES:
        rates = [c[rule] / n for n, c in hosts.values()]
        mu, m = sum(rates) / len(rates), sum(c[rule] for _, c in hosts.values()) / sum(n for n, _ in hosts.values())
        v = sum((r - mu) ** 2 for r in rates) / (len(rates) - 1) if len(rates) > 1 else 0
        centre, strength = (mu, mu * (1 - mu) / v - 1) if v > 0 and 0 < mu < 1 and mu * (1 - mu) > v else (m, 1.0)
        for h, (n, c) in hosts.items():
            worst[h] = max(worst[h], (c[rule] + centre * strength) / (n + strength))
    return [r for r, f in zip(rows, bad) if not f and round(worst[r[2]], 6) <= quality.HOST_LIMIT]


def groups(lanes):
    """Least place of the connected group of each of ``lanes``."""
    root = list(range(len(lanes)))
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    near = [(i, j) for j in range(len(lanes)) for i in range(j) if lanes[i] and lanes[j] and bits(lanes[i][0], lanes[j][0]) + bits(lanes[i][1], lanes[j][1]) <= simhash.TOTAL]
    while True:
        before = list(root)
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


def one_each(rows):
    """(id, text, ...) rows without near copies of others."""
    make = simhash.Fingerprinter()
    lanes = [make.lanes(r[1]) if r[0] is not None else None for r in rows]
    of = groups(lanes)
    stays = {}
    for k, r in enumerate(rows):
        if lanes[k]:
            key = (r[0], _signed(xxhash.xxh64_intdigest(r[1], 42)), k)
            stays[of[k]] = min(stays.get(of[k], key), key)
    return [r for k, r in enumerate(rows) if not lanes[k] or stays[of[k]][2] == k]


def _signed(x):
    return x if x < 1 << 63 else x - (1 << 64)


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def seed_types(value):
    digits, out = regex.sub(r"\D", "", value), []
    if regex.fullmatch(r"\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}", value) and luhn(digits):
        out.append("card")
    if regex.fullmatch(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", value):
        out.append("email")
    if regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", value) and max(map(int, value.split("."))) <= 255:
        out.append("ip")
    if regex.fullmatch(r"\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}", value):
        out.append("phone")
    if regex.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", value):
        out.append("ssn")
    return out


def fine(value):
    s = regex.sub(r"\p{L}+", "a", value)
    if "@" in s:
        s = regex.sub(r"@[a\d.\-]+", "@h", regex.sub(r"[a\d._%+\-]+@", "m@", s))
    return regex.sub(r"\d+", lambda m: "<long>" if len(m[0]) > 19 else f"<{chr(96 + len(m[0]))}>" if len(m[0]) > 3 else "d", s)


def coarse(value):
    return regex.sub(r"\d+", "d", regex.sub(r"\p{L}+", "a", value))


def mentions(text):
    """(mention, value, left, right, start, end)"""
    if not text or not regex.search(r"[\d@]", text):
        return []
    found, out = list(regex.finditer(pii.CANDIDATE, text)), []
    for k, m in enumerate(found):
        before = text[found[k - 1].end() if k else 0 : m.start()]
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        left, right = regex.findall(r"\p{L}+", before), regex.findall(r"\p{L}+", after)
        out.append((k, m[0], left[-1].lower() if left else "", right[0].lower() if right else "", m.start(), m.end()))
    return out


def identifiers(texts):
    """value -> (type, score, seeded)"""
    patterns = defaultdict(set)
    for t in texts:
        for _, v, left, right, *_ in mentions(t):
            patterns[("s", fine(v))].add(v)
            if left:
                patterns[("l", coarse(v), left)].add(v)
            if right:
                patterns[("r", coarse(v), right)].add(v)
            if left and right:
                patterns[("c", left, right)].add(v)
    patterns = {p: vs for p, vs in patterns.items() if len(vs) >= (pii.CONTEXT_SUPPORT if p[0] == "c" else pii.SUPPORT)}
    values = {v for t in texts for _, v, *_ in mentions(t)}
    seeds = {(v, k) for v in values for k in seed_types(v)}
    best = {(v, kind, ty): 1.0 for v, ty in seeds for kind in pii.KINDS}
    for _ in range(pii.ROUNDS):
        new = {(v, kind, ty): 1.0 for v, ty in seeds for kind in pii.KINDS}
        for p, vs in patterns.items():
            for ty in pii.TYPES:
                conf = sum(max(best.get((v, a, ty), 0.0) for a in pii.APART[p[0]]) for v in vs) / (len(vs) + 1.0)
                if conf >= pii.ACCEPT:
                    for v in vs:
                        new[v, p[0], ty] = max(new.get((v, p[0], ty), 0.0), conf)
        best = new
    out = {}
    for v in values:
        scored = [(-max(best.get((v, k, ty), 0.0) for k in pii.KINDS), ty) for ty in pii.TYPES]
        s, ty = min(scored)
        if s < 0:
            out[v] = (ty, round(-s, 6), (v, ty) in seeds)
    return out


def redacted(texts):
    known, out = identifiers(texts), []
    for t in texts:
        for _, v, _, _, a, b in reversed(mentions(t)):
            if v in known:
                t = f"{t[:a]}[{known[v][0].upper()}]{t[b:]}"
        out.append(t)
    return out


def copies(rows, temperature=0.5, weights=None, budget=None):
    """Of each (id, text, source) row, how often it is drawn."""
    per = defaultdict(list)
    for k, (_, _, s) in enumerate(rows):
        per[s].append(k)
    size = [math.sqrt(len(t or "") + 1) for _, t, _ in rows]
    w = {s: (len(ks) ** temperature if weights is None else weights.get(s, 0.0)) for s, ks in per.items()}
    budget = len(rows) if budget is None else budget
    exact = {s: w[s] / sum(w.values()) * budget for s in per}
    share = {s: math.floor(x) for s, x in exact.items()}
    spare = round(sum(exact.values())) - sum(share.values())
    for s in sorted(per, key=lambda s: (-round(exact[s] - math.floor(exact[s]), 9), "\0null" if s is None else s))[:spare]:
        share[s] += 1
    out = [0] * len(rows)
    for s, ks in per.items():
        total = sum(size[k] for k in ks)
        ranked = []
        for k in ks:
            e = round(share[s] * size[k] / total, 9)
            out[k], f = math.floor(e), e - math.floor(e)
            who = "null" if rows[k][0] is None else str(rows[k][0])
            u = (int(hashlib.md5(who.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if f > 0:
                ranked.append((u / (1 - u) * ((1 - f) / f), -(2**63) if rows[k][0] is None else rows[k][0], _signed(xxhash.xxh64_intdigest(rows[k][1] or "", 42)) if rows[k][1] is not None else 42, k))
        for *_, k in sorted(ranked)[: share[s] - sum(out[k] for k in ks)]:
            out[k] += 1
    return out


def lay(lengths, capacities, cost, opened=None):
    """Bins (lists of places), by scanning all of them for each length."""
    caps, bins, supply, promised = sorted(capacities), [], Counter(lengths), Counter()
    for k, n in enumerate(lengths):
        if promised[n]:
            promised[n] -= 1
        else:
            supply[n] -= 1
        open_ = [b for b in bins if b[0] >= n]
        if open_:
            b = min(open_, key=lambda b: b[0])
            # of bins with the same room, the one whose room became that last
            b = max((x for x in open_ if x[0] == b[0]), key=lambda x: x[2])
        else:
            best = None
            for c in [c for c in caps if c >= n]:
                room, fill = c - n, Counter()
                for x in sorted((x for x in supply if supply[x] > 0), reverse=True):
                    t = min(supply[x], room // x)
                    fill[x], room = t, room - t * x
                held = c - room
                each = cost(caps[bisect_left(caps, held)]) / held
                if best is None or each < best[0]:
                    best = each, c, fill
            c = best[1] if opened is None else min(c for c in caps if c >= max(n, opened))
            if opened is None:
                supply -= best[2]
                promised += best[2]
            b = [c, [], 0]
            bins.append(b)
        b[0] -= n
        b[1].append(k)
        b[2] = k
    return [b[1] for b in bins]


def packed(rows, capacities=packing.CAPACITIES, cost=packing.cost):
    """(id, copy, piece, n_tokens, bin, offset, capacity) of (id, text) rows in one shard."""
    with open(packing.VOCABULARY, "rb") as f:
        bpe = packing.Tokens(f.read()).bpe
    seen, pieces, caps = Counter(), [], sorted(capacities)
    for i, t in rows:
        n = len(bpe.encode_ordinary(t)) if t else 0
        mark = _signed(xxhash.xxh64_intdigest(t or "", 42))
        copy, seen[i, t] = seen[i, t], seen[i, t] + 1
        pieces += [(-min(caps[-1], n - a), i is not None, i or 0, mark, copy, a // caps[-1], i) for a in range(0, n, caps[-1])]
    pieces.sort(key=lambda p: p[:6])
    lengths = [-p[0] for p in pieces]
    full = lambda b: next(c for c in caps if c >= sum(lengths[k] for k in b))
    tried = [lay(lengths, capacities, cost, o) for o in (None, *reversed(caps))]
    bins = min(tried, key=lambda bs: sum(cost(full(b)) for b in bs))
    out = []
    for at, b in enumerate(bins):
        used = 0
        for k in b:
            out.append((pieces[k][6], pieces[k][4], pieces[k][5], lengths[k], at, used, full(b)))
            used += lengths[k]
    return out


def passages(rows, length):
    """(id, first, end, drop) runs of repeated passages of (id, text) rows."""
    docs = {(i, t): [w.lower() for w in regex.findall(r"[^\W_]+", t)] for i, t in rows if i is not None and t}
    held = defaultdict(set)
    for (i, _), w in docs.items():
        for a in range(len(w) - length + 1):
            held[tuple(w[a : a + length])].add(i)
    out = set()
    for (i, _), w in docs.items():
        for drop in (False, True):
            on = [a for a in range(len(w) - length + 1) if len(h := held[tuple(w[a : a + length])]) > 1 and (not drop or min(h) < i)]
            runs = []
            for a in on:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = a + length
                else:
                    runs.append([a, a + length])
            out |= {(i, a, b, drop) for a, b in runs}
    return out
