"""Personal data: spans and redaction (operator 1).

Method: candidate gradient boosting. High-recall generators propose spans that
may overlap: the strict patterns; addresses whose marks are written out, put in
brackets or set apart; IPv6 addresses, also compressed ones, and IPv4 with its
dots in brackets; every run of digit groups that could be a card or telephone
number, with every choice of its first and last group. Boosted trees score each
from its format and its context, and a threshold for each kind, calibrated on
held-out candidates for ``PRECISION``, selects. Spans of the strict patterns
that pass their test always stay; a selected span is added where it overlaps
none of them and no better one.

There are no labelled spans. The trees learn from ``EXAMPLES`` made texts in
four languages, in which the true span is known (every other candidate in them
is a false one), and from candidates of at most ``SAMPLE`` documents of the
table itself (at most ``CANDIDATES`` of them), which count as false where no
cue of their kind stands before them. Every fifth text of either is held out
for the thresholds.

Null and empty texts have no spans. Offsets count code points, ends are
exclusive. Rows are kept one for one; ``redact`` passes all other columns
through, ``find`` returns the key and its own columns only.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Trees, fit
from .textbatch import text_slices

KINDS = ("email", "ip", "card", "phone")
PRECISION, EXAMPLES, SEED = 0.99, 8_000, 11
SAMPLE, CANDIDATES = 4_000, 20_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: The at sign and the dot, written out in four languages (fixed values).
_AT, _DOT = "at|arobase|arroba|ät", "dot|point|punkt|punto"
AT = re.compile(rf"(?i)(?<!\s)(?:\s*+[(\[{{<]\s*+(?:{_AT}|@)\s*+[)\]}}>]\s*+|\s++(?:{_AT})\s++|\s*+@\s*+)")
REST = re.compile(rf"(?i)[a-z0-9-]++(?:(?:\s*+[(\[{{<]\s*+(?:{_DOT}|\.)\s*+[)\]}}>]\s*+|\s++(?:{_DOT})\s++|\.)[a-z0-9-]++)+")
SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
FANGED = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:\s?[(\[{{]\s?(?:\.|{_DOT})\s?[)\]}}]\s?[0-9]{{1,3}}){{3}}(?![0-9])")
GROUPS = re.compile(r"[0-9]++(?:[\x20\t\xa0().\-/_]{1,3}[0-9]++)*+")
GROUP = re.compile(r"[0-9]++")

#: Words that announce a kind, in four languages (fixed values).
HELPS = {
    "email": re.compile(r"(?i)\b(?:e-?mails?|mail|contact|write|reach|courriel|écri\w*|schreib\w*|correo|escrib\w*|contacta\w*|kontakt\w*)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|ipv[46]|host|server|client|gateway|adresse|address|dirección|serveur|servidor|rechner)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|payment|carte|crédit|paiement|karte|kreditkarte|zahlung|tarjeta|crédito|pago)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|telephone|tel|call|mobile|cell|fax|ring|dial|whatsapp|téléphone|tél|appel\w*|portable|telefon|anruf\w*|handy|ruf\w*|mobil|teléfono|llam\w*|móvil)\b"),
}
HURTS = re.compile(r"(?i)\b(?:version|isbn|issn|order|invoice|serial|ticket|pages?|item|lot|part|model|ref|doi|date|score|v|commande|facture|numéro|bestell\w*|rechnung|seite|pedido|factura|página|token|id)\b")
TAILS = frozenset("com org net edu gov info io de fr es eu uk co at ch it nl".split())
FEATURES = (
    "kind", "length", "digits", "marks", "spaces", "luhn", "first", "distinct", "groups", "plus", "bracket", "bracketed_at", "dots", "last_group", "email_cue", "ip_cue", "card_cue", "phone_cue", "cue_distance",
    "hurts", "letter_before", "letter_after", "cut_before", "cut_after", "longest_word", "equal_marks", "known_tail", "hex_letters", "double_colon", "dots_in_digits",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one @: its local part is the run before it, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns that pass their test, by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """From each written-out at sign back over the whole run before it and on over the names after it."""
    end = 0
    for m in AT.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start and text[start - 1] in LOCAL:
            start -= 1
        if any(c.isalnum() for c in text[start : m.start()]) and (rest := REST.match(text, m.end())):
            yield start, (end := rest.end())


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in SIX.finditer(text):
        try:
            ipaddress.IPv6Address(m.group())
        except ValueError:
            continue
        yield m.span()
    for m in FANGED.finditer(text):
        if all(int(x) <= 255 for x in GROUP.findall(m.group())):
            yield m.span()


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Every run of neighbouring digit groups with enough digits; a plus or bracket before it belongs to it."""
    for run in GROUPS.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            begin, n = start, 0
            while begin and text[begin - 1] in "+(" and start - begin < 2:
                begin -= 1
            for a, b in groups[i:]:
                n += b - a
                if n > 19:
                    break
                if 7 <= n <= 15:
                    yield "phone", begin, b
                if n >= 13:
                    yield "card", start, b


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the looser generators; they may overlap."""
    yield from (("email", *s) for s in _loose_emails(text))
    if ":" in text or DIGIT.search(text):
        yield from (("ip", *s) for s in _addresses(text))
        yield from _numbers(text)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 4]
    d = _digits(s)
    groups = re.findall("[0-9A-Za-z]+", s)
    marks = [c for c in s if not c.isalnum() and c != " "]
    cues = [[m.end() for m in HELPS[k].finditer(before)] for k in KINDS]
    own = cues[KINDS.index(kind)]
    return [
        KINDS.index(kind), len(s), len(d), len(marks), s.count(" "), len(d) > 1 and luhn(d), int(d[0]) if d else -1, len(set(d)), len(groups), s.startswith(("+", "00", "(+", "(00")), "(" in s,
        bool(re.search(r"(?i)[(\[{<]\s*(?:at|arobase|arroba|ät|@)\s*[)\]}>]", s)), len(re.findall(r"(?i)\b(?:dot|point|punkt|punto)\b", s)), len(groups[-1]) if groups else 0, *map(bool, cues), len(before) - own[-1] if own else 60,
        bool(HURTS.search(before[-24:])), before[-1:].isalpha(), after[:1].isalpha(), bool(re.search(r"[0-9][\x20\t\xa0().\-/_]{0,3}$", before)), bool(re.match(r"[\x20\t\xa0().\-/_]{0,3}[0-9]", after)), max(map(len, groups), default=0),
        len(set(marks)) <= 1, bool(groups) and groups[-1].lower() in TAILS, sum(c in "abcdefABCDEF" for c in s), "::" in s, bool(re.search(r"[0-9]\.[0-9]", s)),
    ]


def _clear(span, others) -> bool:
    return all(span[2] <= a or span[1] >= b for _, a, b in others)


@dataclass
class Selector:
    trees: Trees
    thresholds: dict[str, float]
    measured: dict[str, tuple[float, float]]  # precision and recall of each kind on held-out candidates

    def spans_of(self, texts: list[str]) -> list[tuple[list, list]]:
        """Strict spans, and strict spans with selected candidates, of each text; by start, then kind."""
        base = [base_spans(t) for t in texts]
        good: list[list] = [[] for _ in texts]
        held: list = []

        def weigh():
            score = self.trees.predict(np.array([features(texts[i], *c) for i, c in held], np.float64))
            for (i, c), s in zip(held, score.tolist()):
                if s >= self.thresholds[c[0]]:
                    good[i].append((s, c))
            held.clear()

        for i, t in enumerate(texts):
            for c in candidates(t):
                if _clear(c, base[i]):
                    held.append((i, c))
                    if len(held) == 8192:
                        weigh()
        if held:
            weigh()
        out = []
        for own, more in zip(base, good):
            taken: list = []
            for _, c in sorted(more, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
                if _clear(c, taken):
                    taken.append(c)
            out.append((own, sorted(own + taken, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return self.spans_of([text])[0][1]


#: Words around made examples, in four languages: helpful ones by kind, misleading ones, neutral ones (fixed values).
GOOD = {
    "email": "email|e-mail me|contact|write to|mail|courriel|écrivez à|schreiben Sie an|Kontakt|correo|contacte con|reach me".split("|"),
    "card": "card|visa card|credit card|payment card|carte|carte de crédit|Kreditkarte|tarjeta|pay with".split("|"),
    "phone": "phone|call|tel|tel.|mobile|fax|téléphone|tél|appelez|Telefon|Anruf|Handy|teléfono|llame al|móvil".split("|"),
    "ip": "ip|from host|server|client|adresse ip|Rechner|dirección ip|gateway".split("|"),
}
BAD = "version|isbn|order|invoice|serial|ticket|item|ref|part|commande|facture|Bestellnummer|Rechnung|pedido|factura|page|model|score".split("|")


def made(n: int = EXAMPLES, seed: int = SEED) -> Iterator[tuple[str, tuple[str, int, int] | None]]:
    """Texts and the true span in each, if it has one: real items, and others that look like them."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("aeiourstlnmdpc") for _ in range(rng.randint(2, 9)))
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    parts = lambda d, sizes, mark: mark.join(d[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    def checked(k: int, right: bool) -> str:
        while luhn(d := pick("3456" if right else "0123456789") + number(k - 1)) != right:
            pass
        return d

    def email(real: bool) -> tuple[str, bool]:
        marked = [(x, False) for x in (" (at) ", "(at)", " [at] ", "[at]", "{at}", " <at> ", " (arobase) ", " [arroba] ", " (AT) ", " [@] ")]
        at, plain = pick(marked * (real or rng.random() < 0.1) + [(x, True) for x in (" at ", " at ", " AT ", "\tat ", " arobase ", " @ ")])
        dot = pick((".", ".", " dot ", " (dot) ", "[dot]", " [punkt] ", " (point) ", " punto ") if not plain or at.strip() == "@" else (" dot ", " dot ", " punkt ", " point ", "."))
        tail = pick(sorted(TAILS)) if real or plain and rng.random() < 0.4 else word() + word()
        name = word() + pick(("", "." + word(), number(2), "_" + word(), word() * rng.randint(1, 9))) if real else word()
        return name + at + word() + (dot + word() if rng.random() < 0.2 else "") + dot + tail, plain

    def phone(real: bool) -> tuple[str, bool]:
        mark = pick((" ", "-", ".", "/", " "))
        forms = [
            lambda: "(" + number(3) + ")" + pick((" ", "-", "")) + number(3) + pick("- .") + number(4),
            lambda: parts(number(10), [3, 3, 4], mark), lambda: number(10), lambda: "0" + number(rng.randint(8, 10)), lambda: parts("0" + number(9), [2, 2, 2, 2, 2], mark),
            lambda: "00" + pick(("44", "49", "33", "34", "1")) + pick((" ", "-")) + parts(number(10), [2, 4, 4], pick((" ", "-"))), lambda: "0" + number(2) + pick((" ", "/", "-")) + number(rng.randint(5, 8)),
            lambda: "(0" + number(2) + ") " + number(rng.randint(5, 8)), lambda: parts(number(9), [3, 3, 3], mark), lambda: number(3) + "-" + number(4), lambda: "00" + number(rng.randint(9, 12)),
        ]
        false = [lambda: f"{pick(('19', '20'))}{number(2)}-{number(2)}-{number(2)}", lambda: f"{number(1)}.{number(rng.randint(6, 9))}", lambda: parts(number(12), [4, 4, 4], mark), lambda: number(rng.randint(7, 15)), lambda: parts(number(13), [3, 1, 5, 3, 1], "-"), lambda: f"{number(3)} {number(3)} {number(3)}"]
        return pick(forms if real or rng.random() < 0.5 else false)(), True

    def card(real: bool) -> tuple[str, bool]:
        k = pick((13, 14, 15, 16, 16, 16, 19))
        d = checked(k, real)
        cut = [4, 6, 5] if k == 15 else [4] * (k // 4) + [k % 4] * (k % 4 > 0)
        return (parts(d, cut, pick((" ", ".", "/", "  ", "--", "_", "-"))) if rng.random() < 0.6 else d), k == 13

    def ip(real: bool) -> tuple[str, bool]:
        part = lambda: "".join(pick("0123456789abcdef") for _ in range(rng.randint(1, 4)))
        if not real:
            return pick((lambda: f"{pick('abcdef')}::{pick('abcdef')}", lambda: "::", lambda: pick(("add", "bee", "face", "dead")) + "::" + pick(("add", "bed", "face"))))(), False
        if rng.random() < 0.25:
            return "".join(str(rng.randint(0, 255)) + pick(("[.]", "(.)", " [dot] ")) for _ in range(3)) + str(rng.randint(0, 255)), False
        head, tail = [pick(("2001", "fe80", "2a02", part()))] + [part() for _ in range(rng.randint(1, 4))], [part() for _ in range(rng.randint(1, 2))]
        return pick((lambda: ":".join(part() for _ in range(8)), lambda: ":".join(head) + "::" + ":".join(tail), lambda: ":".join(head) + "::"))(), False

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(n):
        kind, real = pick(KINDS), rng.random() < 0.5
        s, bare = makers[kind](real)  # a bare form is told from others by what stands around it only
        cue, lead = rng.random(), word()
        if real and (bare or cue < 0.6):
            lead = pick(GOOD[kind])
        elif not real and cue < 0.35:
            lead = pick(BAD)
        elif not real and not bare and cue < 0.45:
            lead = pick(GOOD[kind])
        gap = pick((" ", ": ", " is ", " ", ":", " : ", " " + word() + " ", " me: ")) if lead in GOOD[kind] else pick((" ", ": ", " "))
        head = " ".join(word() for _ in range(rng.randint(0, 6))) + " " * (rng.random() < 0.9) + lead + gap
        tail = pick(("", ".", " ", ". ", ", ")) + pick(("", word() + " " + word(), word()))
        yield head + s + (" " + tail if tail[:1].isalnum() else tail), (kind, len(head), len(head) + len(s)) if real else None


def _made_rows(n: int) -> tuple[list, list, list]:
    x, y, text = [], [], []
    for i, (t, truth) in enumerate(made(n)):
        base = base_spans(t)
        for c in candidates(t):
            if _clear(c, base):
                x.append(features(t, *c))
                y.append(float(c == truth))
                text.append(i)
    return x, y, text


def _document_rows(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Features of false candidates of some documents, those with the smallest hashes of their key."""
    wanted = docs.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(wanted), "k", "left_semi")

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column(1)):
                held = []
                for t in texts:
                    base = base_spans(t)
                    for c in candidates(t):
                        if _clear(c, base) and not HELPS[c[0]].search(t[max(0, c[1] - 40) : c[1]]):
                            held.append([float(v) for v in features(t, *c)])
                            if len(held) == 4096:
                                yield pa.RecordBatch.from_pydict({"x": held}, schema=schema)
                                held = []
                yield pa.RecordBatch.from_pydict({"x": held}, schema=schema)

    schema = pa.schema([("x", pa.list_(pa.float64()))])
    rows = some.mapInArrow(run, "x array<double>").orderBy(F.xxhash64("x"), "x").limit(CANDIDATES).collect()
    return np.array([r.x for r in rows], np.float64).reshape(len(rows), len(FEATURES))


@functools.lru_cache(1)
def _made_arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, text = _made_rows(EXAMPLES)
    return np.array(x, np.float64), np.array(y), np.array(text) % 5 == 0


def selector(docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Selector:
    """Trees and thresholds; ``docs`` adds false candidates from a bounded sample of documents."""
    x, y, out = _made_arrays()
    more = _document_rows(docs, key, text) if docs is not None else np.zeros((0, len(FEATURES)))
    x, y, out = np.concatenate((x, more)), np.concatenate((y, np.zeros(len(more)))), np.concatenate((out, np.arange(len(more)) % 5 == 0))
    trees = fit(x[~out], y[~out], rounds=60, depth=5)
    score, limits, measured = trees.predict(x[out]), {}, {}
    for i, kind in enumerate(KINDS):
        mine = x[out][:, 0] == i
        s, t = score[mine], y[out][mine]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.5, float(s[order][fine[-1]])) if len(fine) else 2.0
        chosen = s >= limits[kind]
        measured[kind] = (float(t[chosen].sum() / max(1, chosen.sum())), float(t[chosen].sum() / max(1, t.sum())))
    return Selector(trees, limits, measured)


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, chosen: Selector, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the strict spans, and all spans, for each row."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column(1)):
                found = chosen.spans_of(texts)
                count = lambda k: pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), *map(count, KINDS), pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_join(e) for _, e in found], pa.string())],
                    names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans) -> str:
    """The text with each span, or each run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, chosen: Selector, text: str = "text") -> DataFrame:
    """``df`` with personal data replaced in the text; null texts stay null, other columns pass through."""
    names, at = df.columns, df.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column(at)):
                part = batch.slice(lo, len(texts))
                clean = [redacted(t, every) if every else t for t, (_, every) in zip(texts, chosen.spans_of(texts))]
                column = pa.array([c if v else None for c, v in zip(clean, part.column(at).is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(part.columns)], names=names)

    return df.mapInArrow(run, df.schema)
