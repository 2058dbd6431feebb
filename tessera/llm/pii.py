"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Everything on the rows is an expression of built-in functions. Base patterns (strict formats) always count.
Generators propose further spans in loose formats, which may overlap; each has features of its own form and
of the text around it. Trees boosted on generated labelled samples score them: the trees are fitted once on
the driver and compiled into CASE expressions. A kind's threshold is the least score at which held-out
samples, which another generator makes, are right often enough. No proposal that meets a base span stays, and of
overlapping ones of two kinds that of the kind with the stricter format.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, running
from tessera.llm import cluster

KINDS = ("email", "ip", "card", "phone")

#: The strict formats. Possessive and guarded against long runs, they find what the plain patterns find:
#: a match starts where a run starts or the last match ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be worth a scan.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

_AT, _DOT = r"(?:\[at\]|\(at\)|\{at\}|\x20at\x20|\x20@\x20)", r"(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)"
#: Loose formats: (kind, pattern, what a text must match for it to be worth a scan). Valid in Java and in Python.
GENERATORS = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}\x20?{_AT}\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?{_DOT}\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}(?![A-Za-z0-9-])", r"[\[({\x20](?:at|@)[\])}\x20]"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])", r"[0-9][\x20./-]?[0-9][\x20./-]?[0-9][\x20./-]?[0-9]"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])", r"[0-9]\)?[\x20.-]{1,2}[0-9]"),
)
CONTEXT = 24
#: Code points of a piece of a text from which parts are cut.
CHUNK = 1024

#: Features: of the match (m), of the text before it (b) or after it (a). Counts first, then tests.
COUNTS = (("digits", "[0-9]"), ("marks", r"[\x20./-]"), ("letters", "[A-Za-z]"), ("colons", ":"))
TESTS = (
    ("m", r"\[at\]|\(at\)|\{at\}"),
    ("m", r"\[dot\]|\(dot\)|\{dot\}|\x20dot\x20"),
    ("m", r"(?:\.|\x20dot\x20|\[dot\]|\(dot\)|\{dot\})\x20?(?:com|org|net|edu|gov|io|info|co|uk|de|fr|es|eu)$"),
    ("m", r"\.\x20"),
    ("m", r"[0-9].*(?:\[at\]|\(at\)|\x20at\x20)|[._].*(?:\[at\]|\(at\)|\x20at\x20)"),
    ("m", r"^\("),
    ("m", r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"),
    ("m", r"^0"),
    ("m", r"^(?:4|5[1-5]|34|37|6011|35)"),
    ("m", r"^(?:[0-9]{4}[\x20./-]){3}[0-9]{1,7}$|^[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{5}$"),
    ("m", r"[A-Fa-f]"),
    ("m", r"^(?:19|20)[0-9]{2}[.-]"),
    ("b", r"(?i)(?:tel|phone|call|fax|mobile|cell|ring|whatsapp|téléphone|teléfono|telefon)[^A-Za-z]{0,6}$"),
    ("b", r"(?i)(?:mail|contact|write|reach|address|correo|courriel)[^A-Za-z]{0,6}(?:to|us|me)?[^A-Za-z]{0,3}$"),
    ("b", r"(?i)(?:card|visa|mastercard|amex|credit|debit|pay|karte|carte|tarjeta)[^0-9]{0,12}$"),
    ("b", r"(?i)(?:ip|ipv6|host|server|address|addr|client|from)[^A-Za-z0-9]{0,4}$"),
    ("b", r"(?i)(?:isbn|issn|doi|order|invoice|version|serial|id|no\.?|number|ref|page|vol|code|sku|total)[^A-Za-z]{0,4}$"),
    ("b", r"[$€£#%=_/]\x20?$"),
    ("a", r"^[%€$£_/=]"),
    ("a", r"^[.,;)]?(?:\s|$)"),
)
N_FEATURES = len(COUNTS) + len(TESTS) + 2  # and Luhn's sum, and the length


def luhn_value(text: str) -> bool:
    digits = [int(c) for c in text if c.isascii() and c.isdigit()]
    return bool(digits) and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def luhn(digits: Column) -> Column:
    """Luhn's test of a string of digits."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.nullif(F.right(p, F.lit(3)), F.lit("")), F.lit("0")).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


_SPAN = "struct<kind:string,start:int,end:int>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _places(text: Column, matches: Column, pattern: str) -> Column:
    """start and end of each match, in code points: running sums of the lengths of matches and of what lies between them."""

    def spans(between: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        return F.transform(F.arrays_zip(running(steps, lambda a, b: a + b).alias("end"), matches.alias("match")), lambda z: F.struct((z["end"] - F.length(z["match"])).alias("start"), z["end"].alias("end"), z["match"].alias("match")))

    return let(F.split(text, pattern, -1), spans)


def _chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in chunks, without a walk from the text's beginning."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    low, high = start - i * CHUNK, end - j * CHUNK
    first, last = F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, j), F.lit(""))
    between = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(end <= start, "").when(i == j, F.substring(first, low + 1, high - low)).otherwise(F.concat(F.substring(first, low + 1, F.lit(CHUNK)), between, F.substring(last, F.lit(1), high)))


# The trees


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Node:
    feature: int
    limit: float  # left: at most this
    left: Node | Leaf
    right: Node | Leaf


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float = 1.0, least: float = 8.0) -> Node | Leaf:
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            for limit in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= limit
                gl, hl = grad[left].sum(), hess[left].sum()
                if min(left.sum(), (~left).sum()) >= least:
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    if gain > best[0]:
                        best = (gain, f, float(limit))
    if best[1] is None:
        return Leaf(float(-g / (h + ridge)))
    left = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], _grow(x[left], grad[left], hess[left], depth - 1, ridge, least), _grow(x[~left], grad[~left], hess[~left], depth - 1, ridge, least))


def _apply(tree: Node | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.limit, _apply(tree.left, x), _apply(tree.right, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.4) -> list[Node | Leaf]:
    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), depth)
        trees.append(tree)
        score += rate * _apply(tree, x)
    return trees


RATE = 0.4


def value_features(kind: str, match: str, before: str, after: str) -> list[float]:
    counts = [min(len(re.findall(p, match)), 40) for _, p in COUNTS]
    where = {"m": match, "b": before, "a": after}
    return [*map(float, counts), *(float(bool(re.search(p, where[w]))) for w, p in TESTS), float(luhn_value(match)), float(min(len(match), 80))]


def _features(match: Column, before: Column, after: Column) -> Column:
    where = {"m": match, "b": before, "a": after}
    counts = [F.least(F.lit(40), F.regexp_count(match, F.lit(p))).cast("double") for _, p in COUNTS]
    tests = [F.when(where[w].rlike(p), 1.0).otherwise(0.0) for w, p in TESTS]
    digits = _digits(match)
    return F.array(*counts, *tests, F.when((F.length(digits) > 0) & luhn(digits), 1.0).otherwise(0.0), F.least(F.lit(80), F.length(match)).cast("double"))


def _compiled(tree: Node | Leaf, f: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(RATE * tree.value)
    return F.when(F.get(f, F.lit(tree.feature)) <= tree.limit, _compiled(tree.left, f)).otherwise(_compiled(tree.right, f))


def labelled_samples(seed: int, each: int = 700) -> dict[str, list[tuple[str, str, str, float]]]:
    """(match, before, after, is personal) of each kind, generated: loose forms of personal data, and what looks like them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    prose = lambda: " ".join(word() for _ in range(5)) + " "
    cue = {"email": ["mail: ", "contact us ", "write to ", "reach me "], "phone": ["tel ", "phone: ", "call ", "fax "], "card": ["card ", "visa ", "credit card number ", "paid with amex "], "ip": ["ip ", "host ", "server ", "client "]}
    decoy = ["isbn ", "order no. ", "invoice ", "version ", "id ", "ref ", "page ", "serial ", "total $"]
    ends = ["com", "org", "net", "de", "fr", "es", "io"]
    after = lambda: rng.choice([" ", ". ", ", ", " " + word()])

    def card(n: int, good: bool) -> str:
        lead = rng.choice(["4", "51", "55", "34", "37", "6011"])
        body = lead + digits(n - len(lead) - 1)
        last = next(d for d in "0123456789" if luhn_value(body + d))
        return body + (last if good else str((int(last) + rng.randrange(1, 10)) % 10))

    def split(d: str, mark: str) -> str:
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email(yes: bool):
        if yes:
            at, dot = rng.choice([("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), ("{at}", "{dot}"), (" (at) ", " (dot) ")])
            name = word() + rng.choice(["", "." + word(), digits(2), "_" + word()])
            return f"{name}{at}{word()}{dot}{rng.choice(ends)}", rng.choice([prose(), prose(), *cue["email"]]), after()
        m = rng.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()}. {word().title()}"])
        return m, rng.choice([prose(), prose(), *cue["email"]]), after()

    def phone(yes: bool):
        if yes:
            m = rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(3)} {digits(3)} {digits(4)}"])
            return m, rng.choice([prose(), *cue["phone"], *cue["phone"]]), after()
        m = rng.choice([f"{rng.randrange(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(2)} {digits(3)} {digits(2)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        return m, rng.choice([prose(), *decoy, *decoy]) if not re.fullmatch(r"[0-9]{3}-[0-9]{3}-[0-9]{4}", m) else rng.choice(decoy), rng.choice([after(), "%", "/" + digits(2), "_"])

    def number(yes: bool):
        n = rng.choice([13, 14, 15, 15, 16])
        if yes:
            d = card(n, True)
            m = rng.choice([d, split(d, " "), split(d, "-")]) if n < 16 else rng.choice([split(d, "."), split(d, "/")])
            return m, rng.choice([prose(), *cue["card"], *cue["card"]]) if n in (15, 16) else rng.choice(cue["card"]), after()
        d = rng.choice([card(n, False), "9" + digits(n - 1), "978" + digits(10), digits(n)])
        return rng.choice([d, d, split(d, " "), split(d, "-"), split(d, ".")]), rng.choice([prose(), prose(), *decoy]), after()

    def address(yes: bool):
        hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(4))
        if yes:
            return ":".join([rng.choice(["2001", "fe80", "2a02", "fd00"]), *(hexa() for _ in range(7))]), rng.choice([prose(), *cue["ip"]]), after()
        return rng.choice([":".join(digits(2) for _ in range(4)), ":".join(hexa()[:2] for _ in range(6)), ":".join(digits(1) for _ in range(5))]), rng.choice([prose(), *decoy]), after()

    makers = {"email": email, "phone": phone, "card": number, "ip": address}
    return {k: [(*make(bool(i % 2)), float(i % 2)) for i in range(each)] for k, make in makers.items()}


def field_samples(seed: int, each: int = 600) -> dict[str, list[tuple[str, str, str, float]]]:
    """Samples of another make than labelled_samples, on which thresholds are calibrated: lines of forms, logs, imprints and tables in four languages, with names of words and the look-alikes that stand there."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    first, last = "anna maria jean luis otto clara hugo ines karl emma".split(), "meier garcia dupont weber lopez martin braun petit ramos klein".split()
    house, tops = "nordlicht bluewave casaverde atelier stadtwerk openlab viajes moulin".split(), "com org net eu info de es fr co".split()

    def placed(match: str, lines: list[str]) -> tuple[str, str, str]:
        before, after = pick(lines).split("{}")
        return match, before, after

    def checked(body: str) -> str:
        return body + next(d for d in "0123456789" if luhn_value(body + d))

    def email(yes: bool):
        if yes:
            user = pick((f"{pick(first)}.{pick(last)}", f"{pick(first)}{digits(2)}", f"{pick(first)[0]}_{pick(last)}", "info", "office"))
            at, dot = pick(((" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)"), (" at ", " dot "), ("{at}", ".")))
            return placed(f"{user}{at}{pick(house)}{dot}{pick(tops)}", ["Kontakt: {}\n", "Escriba a {} hoy", "| {} | ventas |", "Redaction : {}, Paris", "author {} wrote", "reply to {}.", "Impressum\n{}\nTelefon"])
        return placed(pick((f"dinner at {pick(house)}. {pick(first).title()}", f"{pick(first)} at {pick(house)}.{pick(last)}", f"born at {pick(last)}. {pick(house)}", f"looked at {pick(house)} dot {pick(last)}")), ["They had {} came", "the {} and", "In May {} left", "when {} was"])

    def phone(yes: bool):
        if yes:
            number = pick((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(4)} {digits(3)}", f"0{digits(1)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"0{digits(2)} {digits(3)} {digits(3)}"))
            return placed(number, ["Tel.: {}\n", "Telefon {}, Mo-Fr", "appelez le téléphone {}.", "Teléfono: {} (casa)", "Fax {} | Mobil", "call me: {} after six", "mobile {}\n"])
        number = pick((f"{rng.randrange(1950, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 29):02d}.{rng.randrange(1, 13):02d}.{rng.randrange(1950, 2030)}", f"{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}-{digits(3)}-{digits(4)}"))
        return placed(number, ["invoice {}\n", "Serial no. {} rev B", "ISBN {}, 2nd ed.", "order {} shipped", "ref {}/7", "= {} %", "page {}_a"])

    def card(yes: bool):
        if yes:
            sixteen, amex = checked(pick(("4", "52", "54")) + digits(pick((14, 13)))), checked(pick(("34", "37")) + digits(12))
            grouped = ".".join(sixteen[k : k + 4] for k in range(0, len(sixteen), 4))
            return placed(pick((amex, f"{amex[:4]} {amex[4:10]} {amex[10:]}", f"{amex[:4]}-{amex[4:10]}-{amex[10:]}", grouped)), ["Karte {}, gültig", "tarjeta {} ok", "paid by card {} exp", "Visa {}\n", "carte {} du", "amex: {}."])
        body = pick(("17", "16", "90", "10")) + digits(pick((11, 12, 13)))
        return placed(pick((body, " ".join(body[k : k + 4] for k in range(0, len(body), 4)), "97" + digits(11))), ["order {} sent", "ts={} ms", "id {}\n", "tracking no. {}", "EAN {}, box", "sku {} x"])

    def ip(yes: bool):
        if yes:
            part = lambda: f"{rng.randrange(0x1000, 0x10000):x}"
            found = ":".join((pick(("2001", "2a00", "fe80", "fd12")), *(part() for _ in range(7))))
            return placed(pick((found, found.upper())), ["from {} port 22", "host {}\n", "ip: {}, up", "client {} GET", "server {} ok", "addr {} dev"])
        mac = ":".join(f"{rng.randrange(256):02x}" for _ in range(6))
        return placed(pick((mac, f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(1)}:{digits(1)}:{digits(1)}")), ["ether {} txq", "at {} UTC", "ratio {} of", "eth0 {}\n", "time {}, lap"])

    makers = {"email": email, "phone": phone, "card": card, "ip": ip}
    return {k: [(*make(bool(i % 2)), float(i % 2)) for i in range(each)] for k, make in makers.items()}


@functools.cache
def detector(precision: float = 0.98) -> dict[str, tuple[tuple, float]]:
    """Per kind the trees and the threshold on their sum: the least at which samples of another make above it are personal so often."""
    out = {}
    fit, held = labelled_samples(11), field_samples(12)
    for kind in KINDS:
        x, y = (np.array(a) for a in zip(*((value_features(kind, m, b[-CONTEXT:], a[:CONTEXT]), t) for m, b, a, t in fit[kind])))
        trees = boost(x, y, rate=RATE)
        hx, hy = (np.array(a) for a in zip(*((value_features(kind, m, b[-CONTEXT:], a[:CONTEXT]), t) for m, b, a, t in held[kind])))
        score = sum(RATE * _apply(t, hx) for t in trees)
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(hy[order]) / np.arange(1, len(hy) + 1)
        last = np.append(score[order][1:] < score[order][:-1], True)
        good = np.flatnonzero((right >= precision) & last)
        out[kind] = (tuple(trees), max(0.0, float(score[order][good[-1]])) if len(good) else float("inf"))
    return out


def _base_spans(kind: str, text: Column, matches: Column) -> Column:
    good = lambda: F.filter(_places(text, matches, BASE[kind]), lambda z: _valid(kind, z["match"]))
    spans = F.transform(good(), lambda z: F.struct(F.lit(kind).alias("kind"), z["start"].alias("start"), z["end"].alias("end")))
    return F.when(F.exists(matches, lambda m: _valid(kind, m)), spans).otherwise(_none(_SPAN))


def _proposals(kind: str, pattern: str, text: Column, matches: Column, chunks: Column) -> Column:
    """The spans of a generator whose score reaches the kind's threshold."""
    trees, threshold = detector()[kind]

    def accepted(z: Column) -> Column:
        before = _cut(chunks, F.greatest(z["start"] - CONTEXT, F.lit(0)), z["start"])
        after = _cut(chunks, z["end"], z["end"] + CONTEXT)
        return let(_features(z["match"], before, after), lambda f: sum((_compiled(t, f) for t in trees), F.lit(0.0))) >= threshold

    spans = F.transform(F.filter(_places(text, matches, pattern), accepted), lambda z: F.struct(F.lit(kind).alias("kind"), z["start"].alias("start"), z["end"].alias("end")))
    return F.when(F.size(matches) > 0, spans).otherwise(_none(_SPAN))


def _clear(spans: Column, taken: Column) -> Column:
    """Those of spans that meet none of taken: all by their start, running maxima of ends before and minima of starts after."""
    tagged = lambda array, new: F.transform(array, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s["end"].alias("end"), s["kind"].alias("kind")))

    def sift(every: Column) -> Column:
        last = running(F.transform(every, lambda s: F.when(s["new"], F.lit(0)).otherwise(s["end"])), F.greatest)
        none = F.lit((1 << 31) - 1)
        following = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["new"], none).otherwise(s["start"]))), F.least))

        def free(last_: Column, following_: Column) -> Column:
            keep = lambda s, i: s["new"] & (F.get(last_, i) <= s["start"]) & (F.get(following_, i) >= s["end"])
            return F.transform(F.filter(every, keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

        return let(last, lambda a: let(following, lambda b: free(a, b)))

    whole = let(F.sort_array(F.concat(tagged(spans, True), tagged(taken, False))), sift)
    return F.when(F.size(spans) == 0, _none(_SPAN)).when(F.size(taken) == 0, spans).otherwise(whole)


def names(docs: DataFrame) -> tuple[str, str]:
    """The names of the columns that find adds: pii_base and pii_spans, with underscores at the end where docs has such columns."""
    held = {c.lower() for c in docs.columns}
    out = []
    for name in ("pii_base", "pii_spans"):
        while name in held:
            name += "_"
        out.append(name)
    return out[0], out[1]


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with two columns more, which names tells: pii_base and pii_spans, arrays of (kind, start, end) by kind and start.

    Places count code points from 0; end is exclusive. Base spans are the matches of BASE, leftmost and
    apart from each other within a kind, that pass their kind's test: an address's parts at most 255, a
    card's 16 to 19 digits Luhn's sum, a phone's digits 8 to 15. pii_spans has them and the accepted
    proposals that meet none of them and none of an earlier kind (email, card, ip, phone). A null or empty text
    has none. Rows keep their order and number, repeated ones are alike; other columns stay, of any name. The
    work on a text grows as n log n with its matches.
    """
    base_name, spans_name = names(docs)
    work, whole, chunks = cluster.fresh_names("pii_text", "pii_more", "pii_chunks")
    never = F.array().cast("array<string>")
    base_scans, more_scans = cluster.fresh_names(*KINDS), cluster.fresh_names(*(k for k, _, _ in GENERATORS))
    scans = {}
    for kind, name in zip(KINDS, base_scans):
        need = F.contains(F.col(work), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        scans[name] = F.when(need, F.regexp_extract_all(F.col(work), F.lit(BASE[kind]), F.lit(0))).otherwise(never)
    for (_, pattern, need), name in zip(GENERATORS, more_scans):
        scans[name] = F.when(F.col(work).rlike(need), F.regexp_extract_all(F.col(work), F.lit(pattern), F.lit(0))).otherwise(never)
    found = docs.withColumn(work, F.coalesce(docs[text_col].cast("string"), F.lit(""))).withColumns(scans)
    some = sum((F.size(name) for name in more_scans), F.lit(0)) > 0
    found = found.withColumns({base_name: F.concat(*(_base_spans(k, F.col(work), F.col(name)) for k, name in zip(KINDS, base_scans))), chunks: F.when(some, _chunked(F.col(work))).otherwise(never)})
    proposed = dict(zip(_PRECEDENCE, cluster.fresh_names(*_PRECEDENCE)))
    found = found.withColumns({proposed[k]: _proposals(k, pattern, F.col(work), F.col(name), F.col(chunks)) for (k, pattern, _), name in zip(GENERATORS, more_scans)})
    taken = base_name
    stages = cluster.fresh_names(*_PRECEDENCE)
    for kind, name in zip(_PRECEDENCE, stages):
        found = found.withColumn(name, F.when(F.size(proposed[kind]) > 0, F.concat(F.col(taken), _clear(F.col(proposed[kind]), F.col(taken)))).otherwise(F.col(taken)))
        taken = name
    place = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    ordered = F.transform(F.sort_array(F.transform(taken, place)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.when(F.size(taken) > F.size(base_name), ordered).otherwise(F.col(base_name))
    return found.select(*(found[c] for c in docs.columns), F.col(base_name), spans.alias(spans_name))


#: Of proposals that meet, that of the kind named first stays.
_PRECEDENCE = ("email", "card", "ip", "phone")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: Callable[[Column], Column] = lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))) -> DataFrame:
    """docs with each span of the text replaced by its kind's mark. Overlapping spans become one, under the first's mark; a null text stays null. Other columns stay, of any name."""
    found = find(docs, text_col)
    _, spans = names(docs)
    text = found[text_col]

    def rebuilt(by_start: Column, chunks: Column) -> Column:
        def pieces(upto: Column) -> Column:
            # A span goes on the one before it where that one's running end lies beyond its start.
            def piece(s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(upto, i - 1), F.lit(0))
                return F.when(s["start"] < before, "").otherwise(F.concat(_cut(chunks, before, s["start"]), mark(s["kind"])))

            return F.concat(F.array_join(F.transform(by_start, piece), ""), _cut(chunks, F.element_at(upto, -1), F.length(text)))

        return let(running(F.transform(by_start, lambda s: s["end"]), F.greatest), pieces)

    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    fresh = let(by_start, lambda s: let(_chunked(text), lambda c: rebuilt(s, c)))
    new = F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(fresh)
    return found.select(*(new.alias(c) if c == text_col else found[c] for c in docs.columns))
