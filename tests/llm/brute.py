"""Plain forms of what the operators must give, one text or one small table at a time."""

from __future__ import annotations

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        checked = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(checked) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def secrets(text):
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near(texts, n, percent=80):
    """Size of the set and smallest id reachable, by id."""
    sets = {k: shingle_set(t, n) for k, t in texts.items()}
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def without_repeats(texts, least):
    """What stays, bytes removed and runs removed of each text of a list."""
    often = collections.Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if often[t[i:i + least]] > 1:
                gone[i:i + least] = [True] * least
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def cosines(texts, examples):
    """TF-IDF cosine of every text with every example, on all words."""
    counts = {k: collections.Counter(re.findall(r"[^\W_]+", t.lower())) for k, t in texts.items()}
    df = collections.Counter(w for c in counts.values() for w in c)
    vectors = {k: {w: (1 + math.log(n)) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, n in c.items()} for k, c in counts.items()}
    size = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    return {k: {e: sum(x * vectors[e].get(w, 0) for w, x in v.items()) / (size[k] * size[e]) for e in examples} for k, v in vectors.items()}
