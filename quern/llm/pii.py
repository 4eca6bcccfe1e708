"""PII: fixed patterns, plus spans that high-recall generators propose and boosted trees select.

The trees learn from labelled spans (personal data and secrets in many spellings against dates, prices, versions, order
numbers, checksums and the like) in made-up sentences and planted in pieces of the documents' own texts, as no table labels
spans; their number is a parameter. Thresholds are calibrated by kind on held-out proposals for a stated precision.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import boosting
from quern.llm.common import table

#: The first BASE kinds have fixed patterns; the others are only proposed.
KINDS, BASE = ("email", "ip", "card", "phone", "iban", "national_id", "secret"), 4
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A run of the characters that ip, card and phone matches are made of; no match crosses its ends.
ZONE = re.compile(r"[0-9+][0-9+\x20().-]*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Generators: more than the trees will let through.
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,4}", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}", re.I),
    "card": re.compile(r"[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}"),
    "phone": re.compile(r"(?:\([0-9]{1,5}\) ?|00[0-9]{1,3}[ .-]?)[0-9]{4,10}(?:[ ./-][0-9]{2,5}){0,4}|(?:\([0-9]{1,5}\) ?|00[0-9]{1,3}[ .-]?)?[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,5}"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b", re.I),
    "national_id": re.compile(r"\b(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]|[0-9]{8}-?[A-Z])\b"),
}
#: A secret: what is assigned to a name like these, a run of a known form, or any long run of letters and digits.
NAMED = re.compile(r"(?:key|token|secret|passw(?:or)?d|passwd|pwd|credentials?|bearer|authorization)\b[\"']?\s{0,3}(?:[:=]|is)?\s{0,3}[\"']?([^\s\"',;<>]{8,})", re.I)
FORMED = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,40}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]{0,20}PRIVATE KEY-----)?")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
HINTS = {
    "email": ("mail", "contact", "write", "reach", "schreib", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "ping", "login", "serveur", "adresse"),
    "card": ("card", "visa", "master", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "ruf", "appel", "llam", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "national_id": ("ssn", "social", "insurance", "national", "nino", "dni", "passport", "identity", "tax"),
    "secret": ("key", "token", "secret", "passw", "pwd", "bearer", "credential", "auth"),
}
#: Last labels of many addresses, and words that often stand before "at" or "@" without being an address.
TOP = frozenset("com org net edu gov info io co de fr es it nl ch at be uk us eu pl pt se no dk fi cz jp cn in br ca au".split())
PLAIN = frozenset("us me him her it them look meet is are was available found hosted visit live more sold read only from and the of in".split())
AGAINST = ("date", "version", "order", "isbn", "page", "price", "invoice", "total", "section", "year", "id", "$", "€", "#", "v.", "no.")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost and non-overlapping by kind; a match that fails its check goes
    without another try."""
    out, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            s = m.start()
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                done = m.end()
                out.append((s, 0, done))
    for z in ZONE.finditer(text):
        a, b = z.span()
        if b - a < 7:
            continue
        zone = z.group()
        if zone.count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text, a, b) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        if b - a >= 12:
            for m in CARD.finditer(text, a, b):
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in zone:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text, a, b) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every generator, overlapping as they come; of an email that may run on into the next
    sentence, also what stands before that."""
    out = []
    for m in LOOSE["email"].finditer(text):
        out.append((m.start(), 0, m.end()))
        out += [(m.start(), 0, k.start()) for k in NEXT.finditer(text, *m.span()) if LOOSE["email"].fullmatch(text, m.start(), k.start())]
    out += [(m.start(), 1, m.end()) for m in LOOSE["ip"].finditer(text)]
    for z in DIGITS.finditer(text):
        a, b = z.span()
        if sum(map(str.isdigit, z.group())) >= 7:
            out += [(m.start(), 2, m.end()) for m in LOOSE["card"].finditer(text, a, b)]
            out += [(m.start(), 3, m.end()) for m in LOOSE["phone"].finditer(text, a, b)]
    # An account number may run on into the words behind it: every part of it up to the end of a group.
    out += [(m.start(), 4, m.start() + g.end()) for m in LOOSE["iban"].finditer(text) for g in GROUP.finditer(m.group()) if g.end() >= 15]
    out += [(m.start(), 5, m.end()) for m in LOOSE["national_id"].finditer(text)]
    formed = [m.span() for m in FORMED.finditer(text)]
    secrets = {m.span(1) for m in NAMED.finditer(text)} | {m.span() for m in RUN.finditer(text) if any(map(str.isdigit, m.group()))}
    # A part of a secret of known form is none of its own.
    at = [a for a, _ in formed]
    within = lambda a, b: (k := bisect_right(at, a)) and b <= formed[k - 1][1]
    return out + [(a, 6, b) for a, b in sorted({x for x in secrets if not within(*x)} | set(formed))]


#: Where a sentence may end inside a loose email.
NEXT = re.compile(r"\. ")
GROUP = re.compile(r"[A-Za-z0-9]+")
DIGITS = re.compile(r"[0-9(][0-9\x20()./_-]{6,}")


def address(s: str, kind: int) -> list[float]:
    """Format of a loose email: its last label, its first word, and how "at" and "." are written."""
    if kind:
        return [0.0] * 7
    last, low = re.search("[A-Za-z0-9-]*$", s).group(), s.lower()
    return [float(last.lower() in TOP), float(last[:1].isupper() and not last.isupper()), float(len(last)), float(re.match("[a-z]*", low).group() in PLAIN), float("@" in s), float(bool(NEXT.search(s))), float(" dot " in low)]


def iban_holds(s: str) -> bool:
    """Two letters, two check digits, and a remainder of 1 by 97."""
    s = re.sub("[ -]", "", s).upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def randomness(s: str) -> list[float]:
    """Bits a character, shares of hexadecimal digits, digits and capitals, changes of character class, and whether the
    form is known."""
    n, kinds = len(s), ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    bits = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    return [bits, sum(c in "0123456789abcdefABCDEF" for c in s) / n, kinds.count("d") / n, kinds.count("u") / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(bool(FORMED.match(s)))]


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a span."""
    s = text[start:end]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 8].lower()
    digits = "".join(filter(str.isdigit, s))
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    seps = set(re.findall("[^0-9A-Za-z]", s))
    hint = [float(any(w in before for w in HINTS[k])) for k in KINDS]
    return [
        float(kind), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        len(seps), float("(" in s), float("." in s), float("/" in s), float("-" in s), float(" " in s), float(luhn(digits)) if digits else 0.0, float(s.startswith("00")), float(s.startswith("(")),
        *hint, hint[kind], float(any(w in before for w in AGAINST)), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in "-/.:" and after[1:2].isdigit()), float(bool(re.search(r"[\[({](at|dot)", s, re.I))),
        *address(s, kind), *(randomness(s) if kind == 6 else [0.0] * 6), float(kind == 4 and iban_holds(s)),
        float(len(groups) == 3 and groups[0] in (2, 4) and groups[1] == 2), float(all(int(g) <= 255 for g in re.findall("[0-9]+", s)[:4])) if groups else 0.0,
    ]


def sound_iban(r: random.Random, good: bool) -> str:
    land, body = r.choice(["DE", "FR", "GB", "ES", "NL", "IT"]), "".join(r.choice("0123456789") for _ in range(r.choice([14, 18, 20])))
    s = next(x for c in r.sample(range(2, 99), 97) if iban_holds(x := f"{land}{c:02d}{body}") == good)
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s


def made_up(n: int, seed: int, pieces: list[str] | None = None) -> list[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, label): proposals in sentences of which personal data are known; half of them, if there are
    pieces of real texts, in the middle of one."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    out = []
    while len(out) < n:
        kind = r.randrange(len(KINDS))
        good = r.random() < 0.5
        if kind == 0:
            at, dot = r.choice(["[at]", "(at)", "{at}", " at ", " [at] ", " (at) ", "@", " @ "]), r.choice(["[dot]", "(dot)", "{dot}", " dot ", " [dot] ", "."])
            case = r.choice([str, str, str.upper, str.title])
            name, top = r.choice([f"{w()}.{w()}", w(), f"{w()}{d(2)}"]), r.choice(["com", "org", "net", "de", "fr", "co.uk"])
            if good:
                s = f"{name}{case(at)}{w()}{case(dot)}{top.replace('.', case(dot))}"
            else:
                s = r.choice([f"{w()} at {w()} dot {w()}", f"{w()} at {w()}. {w().title()}", f"{w()} at {w()}. {w()}", f"{w()} @ {w()}. {w().title()}", f"{w()} at {w()}.{w().title()}", f"{r.choice(sorted(PLAIN))} {r.choice(['at', '@'])} {w()}.{top}"])
        elif kind == 1:
            sep = r.choice(["[.]", "(.)", "[dot]", "(dot)", "[Dot]", "(DOT)"])
            s = sep.join(str(r.randint(0, 255) if good else r.randint(256, 999)) for _ in range(4))
        elif kind == 2:
            sep = r.choice("./_")
            digits = d(15)
            last = next(c for c in "0123456789" if luhn(digits + c) == good)
            s = sep.join((digits + last)[i : i + 4] for i in range(0, 16, 4))
        elif kind == 4:
            s = sound_iban(r, good)
        elif kind == 5:
            area = r.choice([x for x in range(1, 900) if x != 666]) if good else r.choice([0, 666, 900, 950])
            s = r.choice([f"{area:03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", f"{r.choice('ABCEGHJKLMNOPRSTWXYZ')}{r.choice('ABCEGHJKLMNPRSTWXYZ')} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{d(8)}{r.choice('ABCDEFGH')}"]) if good else r.choice([f"{area:03d}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}"])
        elif kind == 6:
            x = lambda k, a: "".join(r.choice(a) for _ in range(k))
            low, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
            if good:
                s = r.choice([x(40, low), x(32, low), x(r.randint(20, 44), alnum), "AKIA" + x(16, alnum[:26] + "0123456789"), "ghp_" + x(36, alnum), "sk-" + x(32, alnum), x(r.randint(8, 16), alnum + "!#$%&*")])
            else:
                s = r.choice(["-".join(w() for _ in range(6)) + d(2), f"{w()}/{w()}/{w()}{d(4)}/{w()}", w() * 3, d(24), f"{w()}_{w()}_{w()}_{w()}{d(1)}", x(40, low), "=" * 20 + d(1), f"{w()}.{w()}(1)"])
        elif good:
            sep = r.choice(" -.")
            s = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}) {d(7)}", f"00{d(2)} {d(9)}"])
        else:
            s = r.choice([f"{r.randint(1900, 2040)}-{r.randint(10, 12)}-{r.randint(10, 31)}", f"{r.randint(10, 31)}/{r.randint(10, 12)}/{r.randint(1900, 2040)}", f"{d(3)} {d(3)} {d(3)}", f"{d(5)}-{d(5)}", f"978-{d(2)}-{d(4)}-{d(3)}", f"{d(4)} {d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(5)} {d(4)} {d(5)} {d(3)}"])
        named = kind == 6 and not FORMED.match(s)  # a random run alone may be a checksum; what it is called tells
        cue = r.choice(HINTS[KINDS[kind]]) if good and (kind == 3 or named or r.random() < 0.6) else r.choice((*AGAINST, "commit", "sha", "checksum", "file", "path")) if not good and r.random() < 0.6 else w()
        link = r.choice([": ", " ", " is ", " = ", '="', ': "'] if kind == 6 else [": ", " ", " is "])
        head, tail = " ".join(w() for _ in range(r.randint(1, 6))) + f" {cue}{link}", r.choice([" ", ", ", ". ", "\n"] if kind < 6 else [" ", "\n", '"\n']) + w()
        if pieces and r.random() < 0.5:
            piece = r.choice(pieces)
            cut = r.randint(0, len(piece))
            head, tail = piece[:cut] + r.choice([" ", "\n", ". "]) + head, tail + r.choice([" ", "\n"]) + piece[cut:]
        text, own = head + s + tail, (len(head), len(head) + len(s))
        # Of a real text only what touches the planted span is known.
        out += [(text, a, k, b, int(good and k == kind and (a, b) == own)) for a, k, b in proposals(text) if a < own[1] and own[0] < b]
    return out[:n]


#: Proposals that the trees learn from, and pieces of documents that half of them are planted in.
ROWS, PIECES, PIECE_CHARS = 14_000, 256, 240


def pieces_of(docs: DataFrame) -> list[str]:
    """PIECES pieces of documents, of PIECE_CHARS characters each from a place told by a hash; the documents are those of
    smallest hash, at any partitioning the same."""
    h = F.xxhash64("text")
    text = F.substring("text", F.pmod(h, F.greatest(F.lit(1), F.length("text") - PIECE_CHARS)).cast("int") + 1, F.lit(PIECE_CHARS))
    rows = docs.filter(F.length("text") > 0).select(h.alias("h"), text.alias("piece")).orderBy("h", "piece").limit(PIECES).collect()
    return [r.piece for r in rows]


def train(rows: int = ROWS, precision: float = 0.98, seed: int = 7, pieces: list[str] | None = None) -> dict:
    """Trees and a threshold by kind, from `rows` proposals; a third of them, held out, calibrate."""
    data = made_up(rows, seed, pieces)
    x, y = np.array([features(t, a, k, b) for t, a, k, b, _ in data], float), np.array([q for *_, q in data], float)
    n = len(y) * 2 // 3
    model = boosting.fit(x[:n], y[:n])
    p, kind = boosting.predict(model, x[n:]), x[n:, 0]
    return model | {"thresholds": [max(0.5, boosting.threshold(p[kind == k], y[n:][kind == k], precision)) for k in range(len(KINDS))]}


class Taken:
    """Spans that don't overlap each other, in order; whether another span overlaps one is found by halving."""

    def __init__(self, spans=()):
        self.spans: list[tuple[int, int]] = []
        for a, b in sorted(spans):  # overlapping ones are merged
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.spans, (b,))  # the first that begins at b or later; only the one before it can reach into a
        return k > 0 and self.spans[k - 1][1] > a

    def add(self, a: int, b: int) -> None:
        insort(self.spans, (a, b))


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; others ignored): doc_id, n_email, n_ip, n_card, n_phone (base spans by
    kind), base_sha256, spans ("kind:start:end" by start, then kind, comma-joined; code points, end exclusive), n_iban,
    n_national_id, n_secret, n_added (all that the trees chose).

    Spans are the base ones, all of them, and selected proposals that overlap none of them; of overlapping proposals the
    more probable one stays, then the longer, then the first. Null and empty texts have none. Whole texts are searched;
    repeated rows alike. No shuffle but of the few pieces that spans are planted in; the trees are trained on the driver and
    are a few kilobytes.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or train(pieces=pieces_of(docs)))
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[BASE:]), "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            counts, shas, base, asked, x, taken = [[] for _ in range(BASE)], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for i, t in enumerate(texts):
                own = base_spans(t) if t else []
                base.append(own)
                for k in range(BASE):
                    counts[k].append(sum(s[1] == k for s in own))
                shas.append(hashlib.sha256(join_spans(own).encode()).hexdigest())
                taken.append(Taken((a, b) for a, _, b in own))
                for a, k, b in proposals(t) if t else []:
                    if not taken[i].meets(a, b):
                        asked.append((i, a, k, b))
                        x.append(features(t, a, k, b))
            p = boosting.predict(model, np.array(x, float).reshape(len(x), -1)) if x else []
            added: list[list] = [[] for _ in texts]
            for q, (i, a, k, b) in sorted(zip(p, asked, strict=True), key=lambda v: (-v[0], v[1][1] - v[1][3], v[1])):
                if q >= model["thresholds"][k] and not taken[i].meets(a, b):
                    taken[i].add(a, b)
                    added[i].append((a, k, b))
            spans = [join_spans(sorted(s + more)) for s, more in zip(base, added, strict=True)]
            more = [[sum(k == kind for _, k, _ in found) for found in added] for kind in range(BASE, len(KINDS))]
            number = lambda c: pa.array(c, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(number, counts), pa.array(shas), pa.array(spans), *map(number, more), number(list(map(len, added)))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, then counts of the further kinds; see find_pii."""
    return find_pii(table(spark, sf_dir, "documents"))
