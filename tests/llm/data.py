"""Awkward documents, and plain Python twins of what the operators compute."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, ld_id long, mm_id string, rs_b int, qr_kept string, key int, uf_url string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 8))) for _ in range(300)] + ["the", "of", "and"] * 40
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(1, 200)
    near = base.replace(base.split()[50], "changed", 1)
    shared = "This very line stands in several documents of the table.\n"
    texts = [
        base, near, base, base.upper(), None, "", "  \n\t ", "one", "one", "ONE", "two words", shared + prose(2, 80), shared.upper() + prose(3, 80), " " + shared + prose(4, 80) + "\n" + shared,
        "▁literal ▁ mark  and   blanks \x00 \x85 \u2028 日本語 \U0001f600", prose(5, 20000), prose(6, 60) + "\n" + prose(6, 60), "a" * 50000, "\n".join(["repeat me please, I am a long line"] * 40), "\r\n\x0b\x0c x\r\n",
        "mail a.b@c.de or +49 (30) 1234-5678, 192.168.0.1, 4111 1111 1111 1111", "x@y", "#" * 300 + " $$ %%",
    ]
    rows = [(i * 10, t, None if i % 3 else "en", i, "x", i, "y", 1, None) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[7], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (-5, prose(9, 70), "fr", 1, "z", 1, "n", 2, "u")]


def components(sets: dict, percent: int = 80) -> dict:
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(x), root(y)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def shingle_set(text: str | None, k: int) -> set:
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def dedup_lines(rows: list[tuple]) -> dict:
    """doc_id, text to (lines, dropped, kept text)."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(h := holders.get(key(x), set())) >= 3 and i != max(h))]
        out[i, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def hits(text: str | None, items: list[tuple], width: int = 13) -> tuple[int, int, list[str]]:
    w, covered, found = item_words(text), set(), set()
    for i, t in items:
        v = item_words(t)
        for s in range(max(1, len(v) - width + 1)) if v and i is not None else ():
            x = v[s : s + width]
            for at in range(len(w) - len(x) + 1):
                if w[at : at + len(x)] == x:
                    covered.update(range(at, at + len(x)))
                    found.add(str(i))
    return len(w), len(covered), sorted(found)


def repeated(words: list[str]) -> int:
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({p + d for at in seen.values() if len(at) > 1 for p in at for d in range(3)})
