"""Personal information in free text: a semi-Markov conditional random field over whole spans.

A segment is a span of the text with a type (email, phone, id_number, address, name). Candidate segments come from broad
patterns and from the word pairs beside a known or name-like word; each is described by features of the whole span (its
form, its digits, its words against the name list) and of its surroundings (cue words, edges). The score of a text's
segmentation is the sum of the scores of its segments; all else is outside and scores nothing. Training maximises the
likelihood of the true segmentation over all others (forward and backward sums over segment ends); decoding picks the best
one by the same dynamic programme. Segments are bounded by the patterns, so the programme has few states.

The weights are learned when the operator is first used, from sentences made by ``corpus`` below: values in public formats
and names composed from the name list, set into general carrier sentences, beside values that only look alike. Kinds that
follow each other have no score of their own: the sentences put them together at random, so there would be nothing to learn.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.session import map_arrow

#: Words whose likeness to a name is kept at most.
SEEN_WORDS = 1 << 16
#: Names that a list may have.
MOST_NAMES = 1 << 20
KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"<{k.upper()}>" for k in KINDS}

# Words that stand before or after personal data.
CUES = {
    "email": "email e-mail mail mailto contact write reach send address inbox courriel correo",
    "phone": "phone tel ph telephone call text ring whatsapp mobile cell fax number dial sms reach me on tlf teléfono téléphone handy",
    "id_number": "passport ssn social security tax id nino national insurance dni nie nif personnummer steuer-id steuer card nr licence license forms identity pesel bsn tin sin itin driving driver cpf rg curp aadhaar pan nric rrn rfc cnp egn amka ahv pps nhs medicare identification social-security",
    "address": "address live lives living stay stays staying deliver delivered delivery moved move come home house visit ship send mail post office located venue meet at near outside wohnt adresse domicilio calle",
    "name": "name named signed signature met meet saw called call ask asked thanks thank dear regards sincerely greetings wishes from by with for to and mr mrs said says wrote writes told hosted guest speaker author cc bcc attn c/o reserved",
}
NOT_CUES = "tweet order page error build version from only sale day due distance score batch class row rows line tokens window at invoice item ref isbn iban serial part ticket parcel tracking account batch"
# Titles before a family name.
TITLES = "mr mrs ms miss mx dr prof professor sir dame herr frau mme mlle monsieur madame sr sra don doña señor señora signor signora rev"
# Offices that follow a title without being a name.
OFFICES = frozenset("president chairman chairwoman chair speaker minister secretary ambassador mayor chancellor judge justice right wrong universe".split())
# Words that do not begin or end a name.
COMMON = (
    "a an the and or but if so to of in on at by for from with without as is are was were be been it its this that these those my your his her our their "
    "i you he she we they me him us them who what when where why how not no yes just still now then than more most many much some any every each all half "
    "never always often will would can could shall should may might must do does did done have has had got met saw ask call called said says told name signed "
    "thanks happy birthday dinner lunch owes booked under cc landlord between after before until unless while because near past over under into out up down new old"
)
_STREET = (
    "street str st road rd avenue ave lane ln drive dr court ct close terrace place pl square sq boulevard blvd way crescent parkway row gardens grove mews highway hwy walk"
)
_ID_FORMS = {  # public formats of numbers issued to persons
    "us": r"\d{3}([- .])\d{2}\1\d{4}",
    "nine": r"\d{9}",
    "uk_insurance": r"[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]",
    "de_tax": r"\d{2} \d{3} \d{3} \d{3}",
    "eleven": r"\d{11}",
    "es": r"(?:[xyz]-?)?\d{7,8}-?[a-z]",
    "se": r"(?:\d{2})?\d{6}[-+]\d{4}",
    "passport": r"[a-z]{1,2}\d{6,8}",
    "passport_dash": r"[a-z]\d{2}-\d{5,6}",
    "card": r"[a-z]{2}\d{3}\.\d{3}",
    "uk_driver": r"[a-z9]{5}\d{6}[a-z9]{2}\d?[a-z0-9]{2,3}",
    "fr": r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?",
    "it": r"[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z]",
    "three": r"\d{3}[- ]\d{3}[- ]\d{3}",
    "br": r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    "mx": r"[a-z]{4}\d{6}[hm][a-z]{5}[a-z0-9]\d",
    "in_twelve": r"\d{4}([- ])\d{4}\1\d{4}",
    "in_tax": r"[a-z]{5}\d{4}[a-z]",
    "sg": r"[stfgm]\d{7}[a-z]",
    "kr": r"\d{6}-\d{7}",
    "cn": r"\d{17}x",
}
_W = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_AT = r"(?: ?(?:@|[\[({<] ?at ?[\])}>]) ?|\s+at\s+)"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?|\s+dot\s+)"
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
_LEFT = r"(?<![\w@.+#/=-])"
_EMAIL = re.compile(rf"(?<![\w@.+#=-])(\w[\w.%+-]{{0,63}})({_AT})({_LABEL}(?:{_DOT}{_LABEL}){{1,6}})", re.I)
_RUN = re.compile(r"(?<![\w@#=/.-])(?:\+|\()?\d[\d()]*(?:(?:[ \u00a0./-]|\) |\)-| \(| x|,? ?ext\.? ?)[\d()]+)*(?![\w@])", re.I)
_NUM = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_ID = {k: re.compile(rf"(?<![\w@#=/.-]){v}(?![\w@])(?!-\w)(?!\.\d)", re.I) for k, v in _ID_FORMS.items()}
#: What every form begins with: a text without it has none.
_ID_BEGIN = re.compile(r"(?<![\w@#=/.-])[a-z]{0,6}-?\d", re.I)
_DE_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm")
_ADDRESS = {
    "en": re.compile(rf"(?:(?:flat|apt\.?|unit|suite) \d+[a-z]?,? )?(?<![\w@#=/.:-])\d{{1,5}}[a-z]?,? (?:[nsew]\.? )?(?:{_W} ){{1,3}}(?:{_STREET.replace(' ', '|')})\b(?:\.?,? (?:apt|flat|unit|suite)\.? \d+[a-z]?)?", re.I),
    "de": re.compile(r"(?<![\w@#])(?:[^\W\d_]+[ -])?[^\W\d_]{2,}(?:%s) \d{1,4} ?[a-z]?\b(?:, \d{5} [^\W\d_]+)?" % "|".join(map(re.escape, _DE_ENDINGS)), re.I),
    "fr": re.compile(rf"(?<![\w@#=/.:-])\d{{1,4}},? (?:bis |ter )?(?:rue|avenue|boulevard|place|allée|chemin|quai|impasse) (?:de la |des |du |de |d['’]|l['’])*{_W}(?:, \d{{5}} {_W})?", re.I),
    "es": re.compile(rf"(?<![\w@#])(?:c/ ?|(?:calle|avenida|avda\.?|plaza|paseo|via|viale|corso|piazza) )(?:de la |del |de )?{_W}(?: {_W})?,? (?:n[º°o.]+ ?)?\d{{1,4}}(?:, \d{{1,2}} ?[º°ª] ?\w\b)?", re.I),
    "box": re.compile(r"(?<![\w@#])(?:p\.? ?o\.? ?box|post office box|postfach|apartado(?: de correos)?|casella postale) (?:no\.? ?)?\d{1,8}", re.I),
}
_WORDS = re.compile(_W)
_TITLE = re.compile(rf"\b({TITLES.replace(' ', '|')})\b\.?\s+(?:[^\W\d_]\.\s+){{0,2}}({_W})", re.I)
#: What announces a name, so that two capitalised words may be one though neither is listed.
_ANNOUNCES = r"\b(?:my name is|name's|signed|regards|sincerely|yours truly|i am called)[,:]? "
_ANNOUNCED, _ANNOUNCED_ANYWHERE = re.compile(rf"(?:{_ANNOUNCES})\Z", re.I), re.compile(_ANNOUNCES, re.I)
_PAIR_GAP = re.compile(r"(?:\s|\s[^\W\d_]\.\s|,\s)\Z")


@dataclass
class NameList:
    """Given and family names, and the beginnings and endings that family names share."""

    given: frozenset[str]
    family: frozenset[str]
    stems: frozenset[str] = field(default=frozenset())
    endings: frozenset[str] = field(default=frozenset())
    seen: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, pairs: list[tuple[str | None, str | None]]) -> NameList:
        given = frozenset(n.strip().lower() for n, k in pairs if n and k == "given")
        family = frozenset(n.strip().lower() for n, k in pairs if n and k == "family")
        stems = Counter(n[:i] for n in family for i in range(3, len(n) - 2))
        endings = Counter(n[i:] for n in family for i in range(2, len(n) - 2))
        return cls(given, family, frozenset(s for s, c in stems.items() if c >= 3), frozenset(e for e, c in endings.items() if c >= 3))

    def composed(self, word: str) -> bool:
        """Whether a listed beginning and a listed ending make up the word."""
        return any(word[:i] in self.stems and word[i:] in self.endings for i in range(3, len(word) - 2))

    def family_like(self, word: str) -> float:
        """1 if listed and composed of parts that other names have, 0.7 if only composed so, 0.4 if only listed (some
        entries of the list are ordinary words); of a double name the less likely half counts."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= SEEN_WORDS:
            self.seen.clear()
        parts = re.split(r"[-'’]", word.lower()) if "-" in word else [word.lower()]
        self.seen[word] = min((0.7 + 0.3 * (p in self.family) if self.composed(p) else 0.4 * (p in self.family)) for p in parts)
        return self.seen[word]


@dataclass
class Segment:
    start: int
    end: int
    kind: str
    features: dict[str, float]


def _near(text: str, start: int, end: int) -> tuple[set[str], set[str], str, str]:
    left, right = text[max(0, start - 34) : start].lower(), text[end : end + 24].lower()
    left = re.split(r"[/;!?]| - ", left)[-1]
    return set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", left)), set(re.findall(r"[^\W\d_]+", right)), left, right


_CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}
_NOT = frozenset(NOT_CUES.split())
_COMMON = frozenset(COMMON.split())
_TITLE_SET = frozenset(TITLES.split())


def _surroundings(text: str, start: int, end: int, kind: str) -> dict[str, float]:
    left_words, right_words, left, right = _near(text, start, end)
    f = {f"{kind}:bias": 1.0}
    if left_words & _CUE_SETS[kind]:
        f[f"{kind}:cue"] = 1.0
    if right_words & _CUE_SETS[kind]:
        f[f"{kind}:cue after"] = 1.0
    last = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", left)[-2:]
    if set(last) & _CUE_SETS[kind]:
        f[f"{kind}:near cue"] = 1.0
    if set(last) & _NOT:
        f[f"{kind}:near other cue"] = 1.0
    if not left.strip() or left.rstrip()[-1:] in ",.:;(<\"“|":
        f[f"{kind}:edge before"] = 1.0
    if not right.strip() or right.lstrip()[:1] in ",.;/-!)>\"”|" and not re.match(r"[-/.]\w", right):
        f[f"{kind}:edge after"] = 1.0
    return f


def _emails(text: str) -> Iterator[Segment]:
    for m in _EMAIL.finditer(text):
        local, at, domain = m.groups()
        labels = re.split(_DOT, domain, flags=re.I)
        for n in range(len(labels), 1, -1):  # shorter domains, where words follow
            end = m.start(3) + len(domain)
            if n < len(labels):
                cut = list(re.finditer(_DOT, domain, re.I))[n - 1]
                end = m.start(3) + cut.start()
            f = _surroundings(text, m.start(), end, "email")
            f["email:plain @" if at == "@" else "email:spaced @" if "@" in at else "email:bracketed at" if re.search(r"[\[({<]", at) else "email:worded at"] = 1.0
            spoken = re.search(r"\sdot\s|[\[(]dot", text[m.start(3) : end], re.I)
            f["email:spoken dot" if spoken else "email:plain dot"] = 1.0
            if any(x.isdigit() for x in labels[:n]):
                f["email:number as label"] = 1.0
            if not re.fullmatch(r"[^\W\d_]{2,}", labels[n - 1]):
                f["email:last label not letters"] = 1.0
            if labels[n - 1].lower() in _COMMON:
                f["email:last label is a common word"] = 1.0
            if local.lower() in _COMMON | {"mail", "look", "meet"}:
                f["email:local is a common word"] = 1.0
            if re.search(r"[._+\d-]", local):
                f["email:joined local"] = 1.0
            f["email:labels"] = n / 4
            yield Segment(m.start(), end, "email", f)


def _number_spans(text: str) -> Iterator[tuple[int, int]]:
    """Every part of a run of digit groups that has 7 to 18 digits."""
    for m in _RUN.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _NUM.finditer(m[0])]
        for i, (a, _) in enumerate(groups):
            if i == 0:
                a = m.start()
            elif text[a - 1] == "(":
                a -= 1
            digits = 0
            for first, b in groups[i : i + 18]:
                digits += b - first
                if digits > 18:
                    break
                if digits >= 7:
                    yield a, b


def _phones(text: str) -> Iterator[Segment]:
    for a, b in _number_spans(text):
        span = text[a:b]
        body = re.split(r"(?i),? ?ext\.? ?| x", span)[0]
        groups = _NUM.findall(body)
        digits = sum(map(len, groups))
        f = _surroundings(text, a, b, "phone")
        f[f"phone:digits {digits if digits < 15 else 15}"] = 1.0
        f[f"phone:groups {min(len(groups), 6)}"] = 1.0
        for name, yes in (
            ("plus", span[0] == "+"),
            ("brackets", "(" in span),
            ("zero first", groups[0][0] == "0"),
            ("bare", len(groups) == 1 and span[0] != "+"),
            ("extension", body != span),
            ("dots only", len(groups) == 4 and span.count(".") == 3),
            ("one separator", len(set(re.findall(r"[^\d()+]", body))) == 1),
            ("us number", re.fullmatch(r"\+?1?[-. /]?\(?\d{3}\)?[-. /]?\d{3}[-. /]?\d{4}", body) is not None),
            ("seven", re.fullmatch(r"\d{3}[-. ]\d{4}", body) is not None),
            ("number of a person", any(p.fullmatch(span) for p in (_ID["us"], _ID["de_tax"], _ID["se"], _ID["nine"]))),
            ("date", re.fullmatch(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}", body) is not None),
            ("more digits beside", bool(re.match(r"[ ./-]?\d", text[b:]) or re.search(r"\d[ ./()-]?\Z", text[:a]))),
            ("pairs", len(groups) >= 4 and sum(len(g) == 2 for g in groups) >= 4),
        ):
            if yes:
                f[f"phone:{name}"] = 1.0
        yield Segment(a, b, "phone", f)


def _ids(text: str) -> Iterator[Segment]:
    for form, pattern in _ID.items() if _ID_BEGIN.search(text) else ():
        for m in pattern.finditer(text):
            f = _surroundings(text, m.start(), m.end(), "id_number")
            f[f"id_number:form {form}"] = 1.0
            cue = "cue" if "id_number:cue" in f else "no cue"
            f[f"id_number:form {form}, {cue}"] = 1.0
            if re.search(r"\d[ .-]\Z", text[: m.start()]) or re.match(r"[ .-]\d", text[m.end() :]):
                f["id_number:more digits beside"] = 1.0
            if m[0] != m[0].lower():
                f["id_number:capitals"] = 1.0
            if form == "eleven" and re.fullmatch(r"1[2-9]\d{9}|0\d{10}", m[0]):
                f["id_number:form of a phone number"] = 1.0
            yield Segment(m.start(), m.end(), "id_number", f)


def _addresses(text: str) -> Iterator[Segment]:
    low = text.lower()
    for form, pattern in _ADDRESS.items():
        if form == "de" and text.isascii() and not any(e in low for e in _DE_ENDINGS):
            continue
        for m in pattern.finditer(text):
            f = _surroundings(text, m.start(), m.end(), "address")
            f[f"address:form {form}"] = 1.0
            words = [w for w in _WORDS.findall(m[0])]
            if form == "en":
                inner = words[:-1] if not re.match(r"(?i)flat|apt|unit|suite", m[0]) else words[1:-1]
                if any(w.lower() in _COMMON for w in inner):
                    f["address:common word inside"] = 1.0
                if any(w[0].isupper() for w in inner):
                    f["address:capital inside"] = 1.0
                f["address:words"] = len(inner) / 3
                if re.match(r"(?i)\d+[a-z] ", m[0]):
                    f["address:number with letter"] = 1.0
            yield Segment(m.start(), m.end(), "address", f)


def _names(text: str, names: NameList) -> Iterator[Segment]:
    words = [(m.start(), m.end(), m[0]) for m in _WORDS.finditer(text)]
    like = [names.family_like(w) for _, _, w in words]
    lows = [w.lower() for _, _, w in words]
    given_name = [w in names.given for w in lows]
    listed = [x >= 0.7 or g for x, g in zip(like, given_name)]
    done = set()

    def outside(a: int, b: int) -> bool:
        """Not part of a handle, link, tag or e-mail address."""
        return not (re.search(r"[@#/_=+&]\Z|\w[.'’-]\Z", text[:a][-2:]) or re.match(r"[@_/+=]|[.-]\w|\d", text[b : b + 2]))

    titled = not text.isascii() or not _TITLE_SET.isdisjoint(lows) or any(p in _TITLE_SET for w in lows if "-" in w or "'" in w for p in re.split("[-']", w))
    for m in _TITLE.finditer(text) if titled else ():
        if not outside(m.start(), m.end()):
            continue
        word = m[2]
        likely = names.family_like(word)
        if word.lower() in OFFICES:
            continue
        if not likely and not (m[1][0].isupper() and word[0].isupper() and not word.isupper()):
            continue
        f = _surroundings(text, m.start(), m.end(), "name")
        f["name:title"] = 1.0
        f["name:title, family"] = likely
        f["name:title, capital"] = float(word[0].isupper() and m[1][0].isupper())
        f["name:title, common word"] = float(word.lower() in _COMMON)
        yield Segment(m.start(), m.end(), "name", f)
    may_announce = _ANNOUNCED_ANYWHERE.search(text) is not None
    if not may_announce and True not in listed:
        return
    for i in range(len(words) - 1):
        announced = may_announce and words[i][2][0].isupper() and _ANNOUNCED.search(text[max(0, words[i][0] - 20) : words[i][0]]) is not None
        if not announced and not (listed[i] or listed[i + 1] or (i + 2 < len(words) and listed[i + 2])):
            continue
        for j in (i + 1, i + 2):
            if j >= len(words):
                continue
            if not (listed[i] or listed[j]) and not (announced and words[j][2][0].isupper()):
                continue
            gap = text[words[i][1] : words[j][0]]
            if not _PAIR_GAP.match(gap) or (j == i + 2 and len(words[i + 1][2]) != 1):
                continue
            turned = "," in gap
            given, family = (words[j][2], words[i][2]) if turned else (words[i][2], words[j][2])
            score = like[i] if turned else like[j]
            known = given_name[j] if turned else given_name[i]
            if score < 0.7 and not ((known or announced) and family[0].isupper() and given[0].isupper() and not family.isupper()):
                continue
            a, b = words[i][0], words[j][1]
            if (a, b) in done or not outside(a, b):
                continue
            done.add((a, b))
            f = _surroundings(text, a, b, "name")
            form = lambda w: "upper" if w.isupper() and len(w) > 1 else "capital" if w[0].isupper() else "lower"
            f["name:family listed"] = float(score == 1.0)
            f["name:family composed"] = float(score >= 0.7)
            f["name:family only listed"] = float(score == 0.4)
            f["name:family unknown"] = float(score == 0.0)
            f["name:given listed"] = float(known)
            f["name:both listed"] = float(known and score > 0.5)
            f[f"name:forms {form(given)} {form(family)}"] = 1.0
            f["name:announced"] = float(announced)
            f["name:announced, not listed"] = float(announced and not known and score < 0.7)
            f["name:turned"] = float(turned)
            f["name:turned, given unlisted"] = float(turned and not known)
            f["name:initial"] = float(j == i + 2)
            f["name:given is a common word"] = float(given.lower() in _COMMON and not known)
            f["name:given is a title"] = float(given.lower() in _TITLE_SET)
            f["name:family is a common word"] = float(family.lower() in _COMMON)
            f["name:given is short"] = float(len(given) < 2)
            yield Segment(a, b, "name", f)


def candidates(text: str, names: NameList) -> list[Segment]:
    found = [*(_addresses(text) if _DIGIT.search(text) else ()), *_names(text, names)]
    if re.search(r"(?i)@|\bat\b", text):
        found += _emails(text)
    if re.search(r"\d[\d \u00a0().,/a-z-]{3,}\d|\d{4}", text, re.I):
        found += [*_phones(text), *_ids(text)]
    return found


class SemiMarkov:
    """Weights, and the sums and maxima over all segmentations."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def score(self, s: Segment) -> float:
        w = self.w
        return sum(w.get(k, 0.0) * v for k, v in s.features.items())

    @staticmethod
    def _steps(segments: list[Segment]) -> tuple[list[int], dict[int, int]]:
        points = sorted({p for s in segments for p in (s.start, s.end)})
        return points, {p: i for i, p in enumerate(points)}

    def decode(self, segments: list[Segment]) -> list[Segment]:
        if not segments:
            return []
        points, at = self._steps(segments)
        ending: dict[int, list[tuple[Segment, float]]] = {}
        for s in segments:
            x = self.score(s)
            if x > 0:
                ending.setdefault(at[s.end], []).append((s, x))
        best, taken = [0.0] * len(points), [None] * len(points)
        for i in range(1, len(points)):
            best[i] = best[i - 1]
            for s, x in ending.get(i, ()):
                if best[at[s.start]] + x > best[i]:
                    best[i], taken[i] = best[at[s.start]] + x, s
        out, i = [], len(points) - 1
        while i > 0:
            if taken[i] is None:
                i -= 1
            else:
                out.append(taken[i])
                i = at[taken[i].start]
        return out[::-1]

    def expectations(self, segments: list[Segment]) -> tuple[float, list[float]]:
        """Log of the sum over all segmentations, and the probability of each segment."""
        points, at = self._steps(segments)
        x = [self.score(s) for s in segments]
        n = len(points)
        ends: list[list[int]] = [[] for _ in range(n)]
        starts: list[list[int]] = [[] for _ in range(n)]
        for k, s in enumerate(segments):
            ends[at[s.end]].append(k)
            starts[at[s.start]].append(k)
        fore, back = [0.0] * n, [0.0] * n
        for i in range(1, n):
            fore[i] = _log_sum([fore[i - 1], *(fore[at[segments[k].start]] + x[k] for k in ends[i])])
        for i in range(n - 2, -1, -1):
            back[i] = _log_sum([back[i + 1], *(back[at[segments[k].end]] + x[k] for k in starts[i])])
        total = fore[-1] if n else 0.0
        return total, [math.exp(fore[at[s.start]] + x[k] + back[at[s.end]] - total) for k, s in enumerate(segments)]

    def train(self, examples: list[tuple[list[Segment], set[tuple[int, int, str]]]], rounds: int = 10, rate: float = 0.5, shrink: float = 0.003) -> None:
        squares: dict[str, float] = {}
        for _ in range(rounds):
            for segments, true in examples:
                if not segments:
                    continue
                _, p = self.expectations(segments)
                for s, q in zip(segments, p):
                    d = float((s.start, s.end, s.kind) in true) - q
                    if abs(d) < 1e-3:
                        continue
                    for k, v in s.features.items():
                        if v:
                            g = d * v - shrink * self.w.get(k, 0.0)
                            squares[k] = squares.get(k, 1e-2) + g * g
                            self.w[k] = self.w.get(k, 0.0) + rate * g / math.sqrt(squares[k])


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


# ---------------------------------------------------------------------------------------------- training sentences


def _word(r: random.Random) -> str:
    return "".join(r.choice(["b", "d", "fl", "gr", "k", "l", "m", "n", "pr", "s", "st", "t", "v"]) + r.choice(["a", "e", "i", "o", "u", "ea", "ou"]) for _ in range(r.randint(1, 3))) + r.choice(["", "n", "r", "st", "lk"])


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _fill(r: random.Random, form: str) -> str:
    """9 is any digit, A any capital."""
    return "".join(r.choice("0123456789") if c == "9" else r.choice("ABCDEFGHJKLMNPRSTXYZ") if c == "A" else c for c in form)


def _name(r: random.Random, names: NameList) -> str:
    given = r.choice(sorted(names.given)).title() if names.given and r.random() < 0.65 else _word(r).title()
    families = sorted(filter(names.composed, names.family)) or sorted(names.family)
    family = r.choice(families).title() if families else _word(r).title()
    if families and r.random() < 0.4:
        family = (r.choice(sorted(names.stems)) + r.choice(sorted(names.endings))).title() if names.stems else family
    if r.random() < 0.1 and families:
        family += "-" + r.choice(families).title()
    middle = f" {r.choice('ABCDEKMRS')}." if r.random() < 0.08 else ""
    x = r.random()
    if x < 0.15:
        return r.choice(["Mr", "Mr.", "Ms", "Mrs", "Dr", "Dr.", "Prof", "Prof."]) + middle + " " + family
    if x < 0.3:
        return f"{family}, {given}"
    return f"{given}{middle} {family}"


def _email(r: random.Random) -> str:
    local = r.choice(["{0}.{1}", "{0}_{1}", "{0}-{1}", "{0}+{1}", "{0}{2}", "{0}", "{0}{1}"]).format(_word(r), _word(r), r.randint(1, 99))
    labels = [_word(r) + r.choice(["", "mail", "post", "-office"])] + ([_word(r)] if r.random() < 0.3 else []) + r.choice([["example"], ["example", "com"], ["example", "org"], ["test"], ["invalid"], ["com"], ["co", "uk"], ["net"], ["org"], ["de"]])
    at, dot = r.choice([("@", ".")] * 5 + [(" @ ", "."), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), (" [at] ", " [dot] "), (" at ", "."), ("@", ".")])
    return local + at + dot.join(labels)


_PHONE_FORMS = "555-0199|+44 20 7946 0999|+1 (999) 555-0199|+1-999-555-0199|999-555-0199|999.555.0199|(999) 555 0199|1999555019|+33 6 99 99 99 99|01 99 99 99 99|07700 900999|+447700900999|020 7946 0999|0491-570-999|001-999-555-0199|+1/999/5550199|(0114) 496 0999 ext. 99|+49 30 9999999|999 555 0199|1 999 555 0199|12999550199|0699999999|+46 70 174 06 99|030 23125 999|01632 960999|+34 699 999 999".split("|")
_ID_VALUES = "000-99-9999|666 99 9999|999-79-9999|666999999|AA 99 99 99 D|AA999999C|99 999 999 999|99999999999|99999999A|X9999999A|19999999-9999|999999-9999|AA999999|X9999999|A99-99999|AA999.999|AAAAA999999AA9AA|AAAAA999999AA9AA|999.999.999-99|AAAA999999HAAAAA99|9999 9999 9999|AAAAA9999A|S9999999A|999999-9999999|A99999999|99999999999999999X".split("|")
_ID_CUES = "ssn|my social is|social security number:|tax id|nino|national insurance|Steuer-ID|DNI|personnummer|passport no.|lost my passport, number|passport|id card nr|driving licence|put down|they want|here it is:|my identity number is||cpf|CURP|aadhaar no.|PAN card|NRIC|national identity number|identity card|my passport is".split("|")
_DECOYS = (
    "see tweet 999999999999999999|order no 999999999|order no 99999999|page 99 of 999|from 192.0.2.999|error 0x9ad99e|build 9.9.99|only 99.99 @ the {w} stall|mail at 9 dot on the {w}|sale at 9|come to the {w} sale at 11|"
    "thanks to all 99 of you|social distance 9 m, tax due on day 29|my passport photo looks like a {w}|999 {w}s on the road to {W}|9 streets past the {w}|{W} Rovers 9-9 {W} United|Lake {W} at 99°|99k/99k tokens|z=9.999|"
    "at 9:99 on 2025-99-09|window_9999999999999.csv|the rose will grant you hope in may|@{w}9999|#{w}{w}|http://{w}.example/{w}9|batch 9999 class 9|invoice 99999999|serial 9999999999|{W} {W} looks at the {w}|near {W} a {w} waits|"
    "Mark my words, {W}|will {W} come|the {f} was {w}|a {w} {f} with {w}|{W} {f} 9-9|at {F} {W}|{g} {w} the {w}|tomorrow the {w} will {w} {W}|dr {w} and the {w}|the {w} at {w} costs 99.99|2025-03-99 99:99|version 99.99.999|row 999999999|999 {w}s and 99 {w}s|the {w} drive was long|99 {w}s in the {w} court|a señor and {w}|look at {w} dot on the {w}|he took 99 {w} lessons on the {w} way|"
    "isbn 978-9-99-999999-9|isbn 9789999999999|iban DE99 9999 9999 9999 9999 99|serial KXTRB9999Q|part no. S9999999D|tracking no. 9999 9999 9999|card ending 9999 9999 9999 9999|account 999.999.999-99|ticket 999999-9999999|my name is {W}|signed, {W}|regards, {w} {w}|signed, the {W} team|Mr President {w}|Mrs Speaker, {w}|Will {W}'s {w}|batch 9999999999999"
).split("|")
_CARRIERS = {
    "email": "email: {x}|contact {x} for tickets|write to {x}|reach me via {x}|send it to {x}, thanks|{x} is my address|mail {x}|mailto:{x}|<{x}>|{x}|my inbox is {x}",
    "phone": "phone: {x}|tel {x}|call {x}|ring {x} after six|whatsapp {x} please|text me on {x}|my number is {x}|{x} if it gets late|call or text, {x}|ph. {x}|{x}|mobile {x}",
    "address": "address: {x}|i live at {x}|they are staying at {x}|deliver to {x}|ship it to {x}|the venue is {x}|a car outside {x}|our office, {x}|come to {x}|{x} is our home|{x} (second floor)|{x}|visit us: {x}",
    "name": "my name is {x}|signed, {x}|we met {x} yesterday|the neighbour {x} called|lunch with {x}|reserved for {x}|best wishes {x}|cc {x}|thanks to {x}|please ask for {x} at reception|saw {x} there|so {x} won it|{x} paid for it|{x} from sales wrote back|{x}|{x}|says {x}|a talk by {x}|dear {x}",
    "id_number": "{c} {x}|{c} {x}|{c} {x}|{x}|{c} {x} for the forms",
}
_STREETS = "{n} {W} Street|{n} {W} Road|{n}{l} {w} street|{n}{l} {w} road|{n}{l} {w} terrace|{n}{l} {w} lane|{n} {W} Ave, Apt {n}B|{n} N. {W} Ave|{n} {W} Ct|{n} {W} Court|Flat {m}, {n} {W} Court|{n} {W} Drive|{n} {W} Lane|{n} {W} Close|{n} {W} Blvd|{n} {W} Ln|{n} {W} {W} Road|{W}straße {m}, 99999 {W}|{W}weg {m}, 99999 {W}|{W}weg {m}|{m} rue de {W}, 99999 {W}|{m} rue {W}|Calle {W} {m}, 3º B|Calle {W} {m}|PO Box {n}|P.O. Box {n}|{n} {W} terrace|{n} {W} square".split("|")


def corpus(names: NameList, n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts with the true segments."""
    r = random.Random(seed)
    out = []
    odd = sorted(n for n in names.family if not names.composed(n)) or ["lake"]
    given = sorted(names.given) or ["will"]
    for _ in range(n):
        sep = r.choice([". ", " / ", ", ", " - ", "; ", "\n"])
        form = r.choice([str, str, str, str, str.lower, str.upper])
        text, spans = "", []
        for k in range(r.randint(1, 5)):
            if k:
                text += sep
            x = r.random()
            if x < 0.25:
                text += form(" ".join(_word(r) if r.random() < 0.6 else r.choice(COMMON.split()) for _ in range(r.randint(3, 9))) + (" " + _word(r).title()) * (r.random() < 0.3))
                continue
            if x < 0.5:
                decoy = r.choice(_DECOYS)
                plain = {"w": _word, "W": lambda r: _word(r).title(), "f": lambda r: r.choice(odd), "F": lambda r: r.choice(odd).title(), "g": lambda r: r.choice(given)}
                decoy = re.sub(r"\{(\w)\}", lambda m: plain[m[1]](r), decoy)
                text += form(_fill(r, decoy) if "A" not in decoy else "".join(r.choice("0123456789") if c == "9" else c for c in decoy))
                continue
            kind = r.choice(KINDS)
            if kind == "email":
                value = _email(r)
            elif kind == "phone":
                value = _fill(r, r.choice(_PHONE_FORMS))
            elif kind == "id_number":
                value = _fill(r, r.choice(_ID_VALUES))
            elif kind == "name":
                value = _name(r, names)
                if announced := r.random() < 0.1:
                    value = f"{_word(r).title()} {_word(r).title()}"
            else:
                value = r.choice(_STREETS).format(n=r.randint(1, 9999), m=r.randint(1, 99), w=_word(r), W=_word(r).title(), l=r.choice("abc")).replace("99999", _digits(r, 5))
            value = form(value)
            carrier = r.choice(_CARRIERS[kind].split("|"))
            if kind == "name" and announced:
                carrier = r.choice(["my name is {x}", "signed, {x}", "regards, {x}", "sincerely, {x}"])
            cue = r.choice(_ID_CUES)
            if kind == "id_number" and len(value) == 11 and value.isdigit():
                carrier, cue = "{c} {x}", r.choice(["Steuer-ID", "tax id", "national id", "identity number"])
            if kind == "id_number" and "{c}" not in carrier and re.fullmatch(r"[\d ]+", value):
                carrier = "{c} {x}"
            if kind == "id_number" and len(value) == 9 and value.isdigit() and cue in ("", "they want", "put down", "here it is:"):
                cue = "social security number:"
            if kind == "id_number" and re.fullmatch(r"\d{4} \d{4} \d{4}", value) and cue in ("", "they want", "put down", "here it is:"):
                cue = "aadhaar no."
            before, after = carrier.split("{x}")
            text += form(before.replace("{c}", cue)).lstrip()
            spans.append((len(text), len(text) + len(value), kind))
            text += value + form(after)
        out.append((text, spans))
    return out


_TRAINED: dict[NameList | tuple, SemiMarkov] = {}


def trained(names: NameList, examples: int = 4000, seed: int = 11) -> SemiMarkov:
    """The model for a name list. ``examples`` bounds the sentences made for training."""
    key = (names.given, names.family, examples, seed)
    if key not in _TRAINED:
        model = SemiMarkov()
        prepared = []
        for text, spans in corpus(names, examples, seed):
            found = candidates(text, names)
            prepared.append((found, _reachable(found, spans)))
        model.train(prepared)
        _TRAINED[key] = model
    return _TRAINED[key]


def _reachable(found: list[Segment], spans: list[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
    """The candidate that stands for each true segment: the one of its type that overlaps it most and best."""
    out = set()
    for a, b, kind in spans:
        own = [s for s in found if s.kind == kind and s.start < b and a < s.end]
        if own:
            s = max(own, key=lambda s: min(b, s.end) - max(a, s.start) - 1.5 * (max(0, a - s.start) + max(0, s.end - b)))
            out.add((s.start, s.end, s.kind))
    return out


def find(text: str, names: NameList, model: SemiMarkov) -> list[Segment]:
    return model.decode(candidates(text, names))


def _ranges(is_one: Callable[[str], bool]) -> str:
    """The characters for which ``is_one`` holds, as ranges for a class of any pattern language."""
    points = [c for c in range(0x110000) if is_one(chr(c))]
    starts = [c for c in points if not is_one(chr(c - 1))] if points else []
    ends = [c for c in points if not is_one(chr(c + 1))]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def suspicious(names: NameList) -> str:
    """A pattern (RE2) that every text with a candidate matches. Each part is what all patterns of a type require:

    address, phone, id_number: a digit. email: an @, or the word "at", a label and a dot, also as a word. name: a title, a
    listed given name with a capital, a word with a listed ending, or a phrase that announces a name. RE2 knows word edges of ASCII letters only, so edges
    are asked for only there; texts with one of the four letters that Python alone takes for ASCII ones are all let through.
    """
    space = _ranges(str.isspace)
    label = rf"[^!-,./:-@\[-^`{{-~{space}]"
    edge = lambda c: r"\b" if c.isascii() and c.isalpha() else ""
    endings = [e for e in names.endings if not any(e != f and e.endswith(f) for f in names.endings)]
    parts = [rf"[{_ranges(str.isdecimal)}]", "@", rf"(?i:\bat\b[\])}}>{space}]+{label}+(?:\.{label}|[\[({{{space}]+dot\b))", rf"\b(?i:{TITLES.replace(' ', '|')})\b(?:[.\s]|[^\x00-\x7f])", "[ſKıİ]"]
    parts.append(r"(?i:my name is|name's|signed|regards|sincerely|yours truly|i am called)[,:]? \pL")
    parts += [rf"(?:\pL|['’])(?:\pL|['’])(?i:{re.escape(e)}){edge(e[-1])}" for e in sorted(endings)]
    for n in sorted(filter(None, names.given)):
        first = re.escape(n[0].upper()) if n[0].isascii() else rf"(?i:{re.escape(n[0])})"
        parts.append(rf"{r'(?:\b|\d)' if edge(n[0]) else ''}{first}(?i:{re.escape(n[1:])}){edge(n[-1])}")
    return "|".join(f"(?:{p})" for p in parts)


def read_names(df: DataFrame, name_col: str = "name", kind_col: str = "kind") -> NameList:
    """The name list, on the driver: a reference table of fixed size, not one that grows with the corpus; more than MOST_NAMES are an error."""
    rows = df.select(name_col, kind_col).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return NameList.of([(r[0], r[1]) for r in rows])


def personal_data(df: DataFrame, names: NameList, id_col: str = "seq", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``kind``, ``start``, ``length``, ``value``): every segment found, in characters from 0.

    Null and empty texts have none. Repeated rows are each reported. Whole texts are searched. No shuffle.
    """
    model, pattern = trained(names), suspicious(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            look = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, pattern), False))
            rows, kinds, starts, lengths, values = [], [], [], [], []
            for i, text in zip(look.to_pylist(), texts.take(look).to_pylist()):
                for s in find(text, names, model):
                    rows.append(i)
                    kinds.append(s.kind)
                    starts.append(s.start)
                    lengths.append(s.end - s.start)
                    values.append(text[s.start : s.end])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(values, pa.string())], names=["i", "kind", "start", "length", "value"])

    lean = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("i", lean.schema["i"].dataType), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("value", T.StringType())])
    return map_arrow(lean, run, schema).select(F.col("i").alias(id_col), "kind", "start", "length", "value")


def replaced(text: str, segments: list[Segment]) -> str:
    out, at = [], 0
    for s in segments:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def with_placeholders(df: DataFrame, names: NameList, text_col: str = "text") -> DataFrame:
    """``df`` with every personal value in ``text_col`` replaced by the placeholder of its type; all else unchanged.

    Null and empty texts stay as they are; other columns pass through whatever their names.
    """
    model, pattern = trained(names), suspicious(names)
    columns = df.columns
    at = columns.index(text_col)
    inner = df.toDF(*[f"c{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            look = np.asarray(pc.fill_null(pc.match_substring_regex(texts, pattern), False))
            new = [replaced(t, find(t, names, model)) if hit else t for t, hit in zip(texts.to_pylist(), look)]
            out = list(batch.columns)
            out[at] = pa.array(new, batch.schema[at].type)
            yield pa.RecordBatch.from_arrays(out, schema=batch.schema)

    return map_arrow(inner, run, T.StructType([T.StructField(f.name, f.dataType, True) for f in inner.schema])).toDF(*columns)
