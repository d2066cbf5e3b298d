"""Personal data: rules for e-mail addresses, IP addresses, cards and phone numbers, and boosted trees over further candidates.

The rules' spans always stay. Generators of high recall propose more, which may overlap: addresses spelt with "at" and "dot" and each
shorter form of them, IPv6 and defanged IPv4 addresses, and all runs of neighbouring digit groups that may be a card or a phone number.
Gradient-boosted trees score each candidate by its format and context; their scores are calibrated on findings that the trees
did not see, a kind's threshold is the lowest with the asked precision there, and of candidates that overlap the most likely
stays. The trees learn from labelled findings, or from planted ones: data of known truth, and what looks like it, put into
passages of the corpus."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, table

KINDS = ("email", "ip", "card", "phone")
#: Passages of the corpus that carry planted findings, findings planted, trees, depth, rate, bins, precision asked of added spans.
CARRIERS, PLANTED, TREES, DEPTH, RATE, BINS, PRECISION = 2000, 9000, 60, 4, 0.25, 32, 0.98
#: The rules (fixed patterns; possessive where that changes no match, so that no text takes more than linear time).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS, _NOT_DIGIT = re.compile("[0-9]+"), re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the rules find: leftmost matches of each kind without overlaps, less those that fail the kind's check."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", at + 1)
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for k, pattern, least, most in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (k == 3 or luhn(digits)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


# Generators

_DOT = r"(?:\.|\s\.\s?|\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?|[ _-](?:dot|punkt|punto)[ _-])"
_AT = re.compile(r"@|(?<![a-z])at(?![a-z])", re.IGNORECASE)
_OPENED, _CLOSED = re.compile(r"(?:\s?[\[({<]\s?|[ _-])$"), re.compile(r"\s?[\])}>]\s?|[ _-]")
_BEFORE = re.compile(rf"(?<![\w.%+-])\w[\w.%+-]{{0,63}}(?:{_DOT}\w[\w.%+-]{{0,63}})?$", re.IGNORECASE)
_HOST = re.compile(rf"\w[\w-]{{0,62}}(?:{_DOT}\w[\w-]{{0,62}}){{1,4}}", re.IGNORECASE)
_DOT_RE = re.compile(_DOT, re.IGNORECASE)
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\s\.\s?|\sdot\s)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_GAP = re.compile("[ .\\-/()_  \n]{1,3}")
#: Words before a finding, by what they suggest, and last parts of host names (fixed values).
WORDS = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt", "contacto", "write", "schreib", "adresse"),
    "ip": ("ip", "ipv4", "ipv6", "host", "server", "address", "adresse", "from", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta", "payment", "cc"),
    "phone": ("phone", "tel", "telephone", "telefon", "call", "mobile", "handy", "fax", "cell", "whatsapp", "sms", "ruf", "appelez", "teléfono", "móvil", "téléphone", "number", "nummer"),
    "other": ("order", "invoice", "isbn", "issn", "version", "date", "total", "price", "page", "pages", "line", "id", "ref", "code", "tracking", "serial", "iban", "chapter", "section", "bestellung", "rechnung", "seite", "pedido", "factura", "commande", "facture", "year", "count", "sum", "since", "between"),
}
_TLDS = frozenset("com org net edu gov info io de fr es uk it eu ch at nl us co dev app me biz".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")


def _groups(text: str):
    """Runs of digit groups with short gaps of separators: lists of (start, end)."""
    run: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        if run and not (m.start() - run[-1][1] <= 3 and _GAP.fullmatch(text, run[-1][1], m.start())):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def _spelt(text: str):
    """(start, end) of what may be addresses spelt in some way, and of their shorter forms with a dot."""
    for m in _AT.finditer(text):
        i, j = m.span()
        if m.group() == "@":
            i, j = i - text[i - 1 : i].isspace(), j + text[j : j + 1].isspace()
        elif (opened := _OPENED.search(text[max(0, i - 3) : i])) and (closed := _CLOSED.match(text, j)):
            i, j = i - len(opened.group()), closed.end()
        else:
            continue
        if (host := _HOST.match(text, j)) and (local := _BEFORE.search(text[max(0, i - 140) : i])):
            ends = [d.start() for d in _DOT_RE.finditer(text, j, host.end())]
            yield from ((i - len(local.group()), e) for e in (*ends[1:], host.end()))


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, apart from the rules'; they may overlap."""
    out = {(s, 0, e) for s, e in _spelt(text)}
    if text.count(":") > 1:
        out.update((m.start(), 1, m.end()) for m in _V6.finditer(text))
    if not _DIGITS.search(text):
        return sorted(out)
    out.update((m.start(), 1, m.end()) for m in _DEFANGED.finditer(text))
    for run in _groups(text):
        for i, (start, _) in enumerate(run):
            digits, before = "", text[max(0, start - 2) : start]
            first = start - len(before) + before.index("+") if "+" in before and before.strip("+( ") == "" else start - 1 if before[-1:] in ("(", "+") else start
            for j in range(i, min(len(run), i + 19)):
                digits += text[run[j][0] : run[j][1]]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn(digits):
                    out.add((start, 2, run[j][1]))
                if 7 <= len(digits) <= 15 and j - i < 8:
                    out.add((first, 3, run[j][1]))
    return sorted(out)


FEATURES = (
    *(f"is_{k}" for k in KINDS), "chars", "digits", "digit_share", "groups", "first_group", "last_group", "longest_group", "shortest_group", "luhn", "plus", "paren", "closed", "spaces", "dashes", "dots", "slashes", "brackets", "zero", "double_zero",
    "at_sign", "at_bracket", "dot_word", "dot_spaced", "tld", "labels", "local", "host", "valid_v6", "hex_groups", "colons", "parts_255", "date", "three_three_four", "fours", "repeats",
    "own_word", "other_word", "any_word", "before_letter", "before_digit", "before_mark", "after_letter", "after_digit", "after_group", "before_group", "near_digits", "currency", "line_start", "in_base",
)
_DATE = re.compile(r"(?:19|20)\d\d[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ](?:19|20)?\d\d")


def features(text: str, span: Span, base: list[Span]) -> list[float]:
    """FEATURES of a candidate; base: the text's rules' spans, in order."""
    start, kind, end = span
    c = text[start:end]
    groups = _DIGITS.findall(c)
    digits, sizes = "".join(groups), [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 40) : start], text[end : end + 12]
    words = {w.lower() for w in _WORD.findall(before)[-4:]}
    has = lambda k: float(any(w in words for w in WORDS[k]))
    labels = [w for w in re.split(r"[^\w-]+", c) if w and w.lower() not in ("dot", "at", "punkt", "punto", "point")] if kind == 0 else []
    v6 = False
    if kind == 1 and ":" in c:
        try:
            ipaddress.IPv6Address(c)
            v6 = True
        except ValueError:
            pass
    at = bisect_left(base, (start,))
    inside = any(b[0] < end and b[2] > start for b in base[max(0, at - 8) : at + 4])
    return [
        *(float(kind == k) for k in range(4)), float(len(c)), float(len(digits)), len(digits) / len(c), float(len(groups)), float(sizes[0]), float(sizes[-1]), float(max(sizes)), float(min(sizes)), float(kind == 2 or (len(digits) > 11 and luhn(digits))),
        float(c[0] == "+"), float("(" in c), float(c.count("(") == c.count(")")), float(c.count(" ")), float(c.count("-")), float(c.count(".")), float(c.count("/")), float(sum(c.count(b) for b in "[{<")), float(digits[:1] == "0"), float(digits[:2] == "00"),
        float("@" in c), float(re.search(r"[\[({<]\s?(?:at|@)", c, re.I) is not None), float(re.search(r"\b(?:dot|punkt|punto|point)\b", c, re.I) is not None), float(re.search(r"\s\.|\.\s", c) is not None), float(bool(labels) and labels[-1].lower() in _TLDS), float(len(labels)),
        float(len(labels[0]) if labels else 0), float(len(labels[-1]) if labels else 0), float(v6), float(len(re.findall(r"[0-9A-Fa-f]+", c)) if kind == 1 else 0), float(c.count(":")), float(all(int(g) <= 255 for g in groups) if kind == 1 and groups and max(sizes) < 5 else 0),
        float(_DATE.fullmatch(c) is not None), float(sizes[-3:] == [3, 3, 4]), float(all(s == 4 for s in sizes)), max((digits.count(d) for d in set(digits)), default=0) / max(1, len(digits)),
        has(KINDS[kind]), has("other"), float(any(has(k) for k in KINDS)), float(before[-1:].isalpha()), float(before[-1:].isdigit()), float(before.rstrip()[-1:] in ("=", ":", "#")), float(after[:1].isalpha()), float(after[:1].isdigit()),
        float(re.match(r"[ .\-/()_]{1,3}[0-9]", after) is not None), float(re.search(r"[0-9][ .\-/()_]{1,3}$", before) is not None), float(sum(x.isdigit() for x in before + after)), float(any(x in "$€£%" for x in (before[-2:] + after[:2]))),
        float(start == 0 or before[-1:] == "\n"), float(inside),
    ]


# Planted findings

_NAMES = ("anna", "j.smith", "maria.lopez", "peter_k", "info", "li.wei", "s.mueller", "office", "tom99", "ceo")
_HOSTS = ("example", "mail", "uni-web", "gmail", "company", "post")
#: Where findings stand; an empty one has no telling word (fixed values).
_PLACES = {
    0: ("mail: {}", "write to {} today", "contact {}", "email {}", "Kontakt: {}", "correo {}", "{}", "{} said"),
    1: ("ip {}", "from {} port 22", "host {}", "login by {}", "{}"),
    2: ("card {}", "visa: {}", "Kreditkarte {}", "tarjeta {}", "payment by {} on", "{}"),
    3: ("call {}", "tel. {}", "phone: {}", "Telefon {}", "fax {}", "mobile {} or", "llame al teléfono {}", "number {}", "{}"),
    4: ("order {}", "invoice {}", "isbn {}", "version {}", "page {}", "ref {}", "total {}", "since {}", "tracking {}", "{}", "id {}", "between {} and"),
}


def planted(passages: list[str], n: int = PLANTED, seed: int = 0) -> list[tuple[str, int, int, int]]:
    """n (text, start, end, kind): findings put into those passages that hold none, kind -1 for what only looks like one."""
    rng = np.random.default_rng(seed)
    passages = [p for p in passages if not base_spans(p) and not candidates(p)] or ["some words of a text that go on for a while and end here"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: pick(("house", "room", "table", "point", "market", "thion", "ander", "casa"))

    def card(k=16) -> str:
        d = pick("3456") + num(k - 2)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def cut_up(d: str, sizes, sep: str) -> str:
        at = np.cumsum([0, *sizes])
        return sep.join(d[a:b] for a, b in zip(at, at[1:]))

    def real(kind: int) -> tuple[str, bool]:
        """Data of a kind, and whether it needs no telling word."""
        if kind == 0:
            at, dot = pick((" at ", " [at] ", "(at)", " (at) ", " AT ", "[at]", " @ ", "{at}")), pick((" dot ", "[dot]", "(dot)", " [dot] ", ".", " DOT ", " . "))
            return pick(_NAMES) + at + pick(_HOSTS) + num(int(rng.integers(0, 2))) + dot + pick(sorted(_TLDS)), True
        if kind == 1:
            if rng.random() < 0.5:
                return pick(("[.]", "(.)", " . ", "[dot]", " dot ")).join(str(int(x)) for x in rng.integers(0, 256, 4)), True
            parts = [f"{int(x):x}" for x in rng.integers(0, 65536, 8)]
            return pick((":".join(parts), f"2001:db8::{parts[0]}", f"fe80::{':'.join(parts[:4])}", f"{parts[0]}:{parts[1]}::{parts[2]}")), True
        if kind == 2:
            form = int(rng.integers(6))
            if form == 0:
                return cut_up(card(), (4, 4, 4, 4), pick((".", "/", "_", " ", "  ", " - "))), True
            if form == 1:
                return cut_up(card(15), (4, 6, 5), pick((".", "/", " "))), True
            if form == 2:
                return card(13), False
            return pick((card(), cut_up(card(), (4, 4, 4, 4), " "), card(15))), True
        area, a, b = str(int(rng.integers(200, 990))), num(3), num(4)
        strong = (f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"({area}){a}-{b}", f"1-{area}-{a}-{b}", f"00{int(rng.integers(30, 60))} {num(2)} {num(7)}", f"+{int(rng.integers(30, 60))} (0){num(2)}/{num(7)}", f"+1 ({area}) {a}-{b}", f"({area}) {a} {b}")
        weak = (f"{area}.{a}.{b}", f"{area} {a} {b}", f"0{num(2)} {num(7)}", f"0{num(2)}/{num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{a}-{b}", f"{pick('679')}{num(2)} {num(3)} {num(3)}", f"0{num(3)}-{num(6)}", f"{area}{a}{b}")
        return (pick(strong), True) if rng.random() < 0.5 else (pick(weak), False)

    def unreal() -> str:
        y = str(int(rng.integers(1900, 2030)))
        fails = num(15)
        fails += next(c for c in "0123456789" if not luhn(fails + c))
        forms = (
            lambda: f"{y}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{y}", lambda: f"{num(2)}/{num(2)}/{y} {num(2)}:{num(2)}", lambda: f"{y} {int(y) + 1} {int(y) + 2}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(3)}-{num(4)}-{num(2)}",
            lambda: f"{num(1)} {num(3)} {num(3)}", lambda: f"1.{num(3)}.{num(3)},{num(2)}", lambda: num(9), lambda: num(10), lambda: num(12), lambda: fails, lambda: cut_up(fails, (4, 4, 4, 4), " "), lambda: f"{num(2)}-{num(7)}", lambda: f"{num(4)} {num(4)} {num(3)}",
            lambda: f"{num(3)}.{num(2)} {num(3)}.{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: ":".join(f"{int(x):02x}" for x in rng.integers(0, 256, 6)), lambda: f"v{num(1)}.{num(2)}.{num(3)}.{num(4)}", lambda: f"std::{word()}", lambda: f'"{"".join(f"{int(x):x}" for x in rng.integers(0, 16, 40))}"', lambda: f"DE{num(20)}",
            lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()}. At {word()}. {word()}", lambda: f"{word()} at {word()} . {word()}", lambda: f"{word()}. At {word()}.{word()}", lambda: f"@{word()}.{word()}", lambda: f"{word()}@{word()}", lambda: f"{word()} @ {num(2)}.{num(2)}",
            lambda: f"meet at {num(1)}.{num(2)}", lambda: f"{word()} at the {word()}. In {word()}", lambda: f"{num(3)}-{num(3)}", lambda: " ".join(num(2) for _ in range(7)), lambda: f"({y}) {num(3)}-{num(3)}", card, lambda: f"{num(4)}-{num(4)}-{num(4)}", lambda: f"{num(5)}/{num(4)}/{num(3)}",
            lambda: f"look at {word()}.{pick(sorted(_TLDS))}", lambda: f"{word()} at {word()} dot to dot {word()}",
        )
        return pick(forms)()

    out = []
    for k in range(n):
        kind = k // 2 % 4 if k % 2 else -1
        finding, alone = real(kind) if kind >= 0 else (unreal(), True)
        places = _PLACES[kind] if kind >= 0 else _PLACES[4] + _PLACES[1] * (":" in finding)
        place = pick(places if alone else [p for p in places if p[0] != "{"])
        if kind < 0 and luhn(_NOT_DIGIT.sub("", finding) or "1"):
            place = pick([p for p in places if p[0] != "{"])
        if kind in (2, 3) and rng.random() < 0.2:  # beside another one
            place = pick(("{} " + real(kind)[0], real(kind)[0] + " {}", f"{{}} {finding}", f"{finding} {{}}"))
        passage = pick(passages)
        at = int(rng.integers(len(passage) + 1))
        head, tail = passage[:at].rpartition(" ")[0], passage[at:].partition(" ")[2]
        lead, _, rest = place.partition("{}")
        start = len(head) + 1 + len(lead)
        out.append((f"{head} {lead}{finding}{rest}{pick((' ', ', ', '. ', chr(10)))}{tail}", start, start + len(finding), kind))
    return out


def labelled_candidates(findings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kinds) of the candidates that overlap the given (text, start, end, kind): 1 where a candidate is one of its
    kind exactly, else 0."""
    x, y, kinds = [], [], []
    for text, start, end, kind in findings:
        base = base_spans(text)
        for s in candidates(text):
            if s[0] < end and s[2] > start and s not in base:
                x.append(features(text, s, base))
                y.append(float(s == (start, kind, end)))
                kinds.append(s[1])
    return np.array(x).reshape(-1, len(FEATURES)), np.array(y), np.array(kinds, int)


class Boosted:
    """Gradient-boosted trees for log loss over binned features; trees are complete, nodes 2 k + 1 and 2 k + 2 below k."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.depth, self.start = depth, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], axis=1)  # bin k: at most cuts[k]
        n_nodes, d = 2**depth - 1, x.shape[1]
        self.feature, self.cut, self.leaf = np.zeros((trees, n_nodes), int), np.full((trees, n_nodes), np.inf), np.zeros((trees, 2**depth))
        score = np.full(len(y), self.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                gains = np.full((many, d, bins), -np.inf)
                for f in range(d):
                    at = (node - first) * bins + binned[:, f]
                    gl, hl = (np.bincount(at, w, many * bins).reshape(many, bins).cumsum(axis=1) for w in (g, h))
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gains[:, f] = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf)
                best = gains.reshape(many, -1).argmax(axis=1)
                f, b = best // bins, best % bins
                ok = np.isfinite(gains.reshape(many, -1).max(axis=1))
                self.feature[t, first : first + many] = f
                self.cut[t, first : first + many] = [cuts[i][j] if o and j < len(cuts[i]) else np.inf for i, j, o in zip(f, b, ok)]
                node = 2 * node + 1 + (x[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            leaf = node - n_nodes
            self.leaf[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            score += self.leaf[t, leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows, all trees at once."""
        rows, trees, node = np.arange(len(x))[:, None], np.arange(len(self.leaf)), np.zeros((len(x), len(self.leaf)), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)


class Selector:
    """Boosted trees with their calibration: per kind a scale and a shift of the log odds, and the least probability that selects."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = PRECISION):
        held = np.arange(len(y)) % 3 == 0
        self.trees = Boosted(x[~held], y[~held]) if y[~held].any() else None
        self.scale, self.shift, self.least = np.ones(4), np.zeros(4), np.full(4, 1.1)
        for k in range(4) if self.trees else ():
            here = held & (kinds == k)
            if not y[here].any():
                continue
            s, t = self.trees.score(x[here]), y[here]
            a, b = 1.0, 0.0
            for _ in range(50):  # Newton steps of a logistic fit of the label on the score
                p = 1 / (1 + np.exp(-(a * s + b)))
                w = p * (1 - p) + 1e-9
                hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
                step = np.linalg.solve(hess, [((t - p) * s).sum() - 1e-3 * (a - 1), (t - p).sum() - 1e-3 * b])
                a, b = a + step[0], b + step[1]
                if np.abs(step).max() < 1e-6:
                    break
            self.scale[k], self.shift[k] = a, b
            p = 1 / (1 + np.exp(-(a * s + b)))
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
            ends = np.append(p[order][1:] < p[order][:-1], True)  # only where all of one probability are in
            good = np.flatnonzero(ends & (right >= precision))
            if len(good):
                self.least[k] = max(0.5, p[order][good[-1]])

    def chances(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[kinds] * self.trees.score(x) + self.shift[kinds]))) if self.trees else np.zeros(len(x))

    def select(self, text: str) -> tuple[list[Span], list[tuple[int, int, int, float]]]:
        """(the rules' spans, all spans with their chances, the rules' ones with 1), both in order."""
        base = base_spans(text)
        known = set(base)
        more = [s for s in candidates(text) if s not in known]
        out = [(*s, 1.0) for s in base]
        if not more:
            return base, out
        kinds = np.array([s[1] for s in more])
        p = self.chances(np.array([features(text, s, base) for s in more]), kinds)
        taken = sorted((s[0], s[2]) for s in base)
        for k in np.lexsort((np.arange(len(more)), -np.array([s[2] - s[0] for s in more]), -p)):
            start, kind, end = more[k]
            if p[k] < self.least[kind]:
                continue
            at = bisect_left(taken, (start, end))
            if all(e <= start or s >= end for s, e in taken[max(0, at - 8) : at + 1]):  # rules of four kinds may overlap at one place
                taken.insert(at, (start, end))
                out.append((start, kind, end, float(p[k])))
        return base, sorted(out)


def passages_of(docs: DataFrame, text_col: str = "text", n: int = CARRIERS, chars: int = 400) -> list[str]:
    """Passages of `chars` characters from at most n texts, picked by a hash of the text."""
    rows = docs.select(F.col(text_col).alias("t")).filter("t <> ''").select(F.xxhash64("t").alias("h"), F.expr(f"substring(t, 1 + cast(pmod(xxhash64(t, 1), greatest(length(t) - {chars}, 1)) as int), {chars})").alias("t"))
    return [r["t"] for r in least_hashed(rows, F.col("h"), n, None, "t").select("t").collect()]  # n passages


def learn(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text", sample: int = PLANTED) -> Selector:
    """A selector from labelled (text, start, end, kind) findings, at most `sample` of them by a hash; else from planted ones."""
    if labelled is None:
        return Selector(*labelled_candidates(planted(passages_of(docs, text_col), sample)))
    place = {k: n for n, k in enumerate(KINDS)}
    rows = least_hashed(labelled, F.xxhash64("text", "start", "end"), sample, None, "text", "start", "end", "kind").select("text", "start", "end", "kind").collect()
    return Selector(*labelled_candidates([(r["text"], r["start"], r["end"], place.get(r["kind"], -1)) for r in rows]))


_SPANS = "array<struct<kind:string,start:long,end:long,chance:double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, redact: bool = False) -> DataFrame:
    """A row for each row of docs: id, base and spans, arrays of (kind, start, end, chance) by start and then kind, in code points with the
    end exclusive; with `redact` also the text with each span, or several that overlap, replaced by its kind in brackets.

    base: what the rules find; spans: those and what the trees add, which overlaps none of them. labelled: (text, start, end, kind)
    findings, of another kind what isn't one; planted ones by default. Null and empty texts have no spans and an empty redacted text.
    Rows that repeat an id each get a row; other columns are ignored, whatever their names; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled, text_col))  # some trees
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def run(batches):
        selector = shared.value
        for b in batches:
            both, texts = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                base, spans = selector.select(t)
                both.append([[{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "chance": s[3] if len(s) > 3 else 1.0} for s in part] for part in (base, spans)])
                if redact:
                    texts.append(redacted(t, spans))
            cols = [pa.array([x[k] for x in both], struct) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *([pa.array(texts, pa.string())] if redact else [])], names=["id", "base", "spans", *(["redacted"] if redact else [])])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base {_SPANS}, spans {_SPANS}" + (", redacted string" if redact else ""))
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list) -> str:
    out, end = [], 0
    for start, kind, stop, *_ in spans:
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *many, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
