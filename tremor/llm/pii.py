"""Personal data: fixed patterns for e-mail addresses, IP addresses, payment cards and telephone numbers, and a
linear-chain conditional random field over word shapes and small word lists that adds secrets (passwords, access
keys), names, postal addresses, identity and account numbers, telephone numbers without a plus, birth dates and
e-mail addresses written around the at sign.

The field is trained from a small labelled table, by gradient steps on its exact log-likelihood; a line of words
is one chain, all labels are decoded in one Viterbi pass over all lines of a slice.  Words that are no entity
whatever their neighbours' labels cut the chains first (exactly: see `Decoder.labels`).  A word's scores are
looked up once per distinct word.  Pattern spans always stay; the field's are added where they touch none.  Spans count code points,
the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import appended, slices, with_fields, without

BASE_KINDS = ("email", "ip", "card", "phone")
#: The field's labels from 1 on; 0 is none.
FIELD_KINDS = ("secret", "name", "address", "id_number", "national_phone", "birth_date", "spelled_email")
KINDS = (*BASE_KINDS, *FIELD_KINDS)
SPAN = "array<struct<kind:string,start:long,end:long>>"
MEMORY_WORDS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]{7,}")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, leftmost first, in one pass: a local part is the run of its characters
    before an @, no further left than the last match's end."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, *run.span()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# -- the conditional random field ---------------------------------------------------------------------------

_CUES = frozenset("password passwd pwd passphrase secret token key apikey api_key access_key secret_key credentials auth bearer pin".split())
_JOINS = frozenset("is = : := ist est es:".split())
_FEATURES = ("one", "lower", "capital", "upper", "digits", "letters+digits", "upper+digits", "hexlike", "symbol inside", "assigned", "cue=value",
             "cue", "join", "short", "long", "very long", "many classes", "given name", "title", "street", "house number", "postcode", "social number",
             "iban", "account group", "document number", "id cue", "area code", "phone shape", "phone group", "phone cue", "trunk zero", "date",
             "month", "year", "birth cue", "on", "at", "dot", "at inside", "domain", "top domain", "ends", "capital end")
_GIVEN = frozenset("""james john robert michael william david richard thomas mary patricia jennifer linda elizabeth susan sarah karen anna maria emma
    peter hans klaus jürgen wolfgang stefan andreas ursula sabine monika petra heike jean pierre michel françois philippe nicolas marie nathalie isabelle
    sophie camille josé juan carlos luis javier miguel antonio carmen ana lucía isabel pilar laura paul martin daniel julia""".split())
_TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra name".split())
_STREETS = frozenset("street st avenue ave road rd lane ln boulevard blvd drive rue calle avenida plaza allee".split())
_LOWER_STREETS = frozenset("rue calle street avenue".split())
_STREET_ENDS = ("straße", "strasse", "weg", "platz", "gasse")
_ID_CUES = frozenset("ssn iban passport id dni nie nif ausweis personalausweis reisepass passeport pasaporte steuernummer account konto".split())
_PHONE_CUES = frozenset("tel phone telephone call mobile cell fax telefon tél téléphone teléfono móvil handy".split())
_MONTHS = frozenset("""january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember
    janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre
    noviembre diciembre""".split())
_BIRTH = frozenset("born dob birthdate birthday geboren geb geburtsdatum né née nacido nacida naissance nacimiento".split())
_ON = frozenset("on am le el of".split())
_TOP = frozenset("com org net edu de fr es io".split())
_LEXICON = _GIVEN | _TITLES | _STREETS | _ID_CUES | _PHONE_CUES | _MONTHS | _BIRTH | _ON | _TOP | {"at", "dot"}
_SHAPES = {name: re.compile(p) for name, p in {
    "house number": r"[0-9]{1,4}[a-zA-Z]?", "postcode": r"[0-9]{5}", "social number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30})?", "account group": r"[0-9]{4}|[A-Z0-9]{4}", "document number": r"[A-Z]{1,2}[0-9]{6,9}[A-Z]?|[0-9]{8}[A-Z]",
    "area code": r"\([0-9]{2,5}\)", "phone shape": r"\(?[0-9]{2,5}\)?(?:[-./][0-9]{3,4}){1,2}|\(?0[0-9]{1,4}\)?[-/][0-9]{5,9}", "phone group": r"[0-9]{2,4}",
    "trunk zero": r"0[0-9]{1,11}", "date": r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}", "year": r"(?:19|20)[0-9]{2}",
    "at inside": r"[\w.+-]+[\[({<](?:at|AT)[\])}>][\w.-]+.*", "domain": r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[a-z]{2,4}"}.items()}


def kind_features(word: str, bare: str) -> tuple[bool, ...]:
    """The features after "many classes"."""
    plain, low = word.rstrip(",.;:!?\"'"), bare.rstrip(":").lower()
    capital = bare[:1].isupper()
    shape = {name: bool(p.fullmatch(plain)) for name, p in _SHAPES.items()}

    def marker(sign: str) -> bool:
        return plain.lower() in {f"{a}{sign}{b}" for a, b in ("[]", "()", "{}", "<>")} or word == sign.upper()

    return (capital and low in _GIVEN, low in _TITLES and (capital or low == "name"), low in _STREETS and (capital or low in _LOWER_STREETS) or capital and low.endswith(_STREET_ENDS),
            shape["house number"], shape["postcode"], shape["social number"], shape["iban"], shape["account group"], shape["document number"],
            low in _ID_CUES, shape["area code"], shape["phone shape"], shape["phone group"], low in _PHONE_CUES, shape["trunk zero"], shape["date"],
            capital and low in _MONTHS or low in _MONTHS, shape["year"], low in _BIRTH, low in _ON, marker("at"), marker("dot"), shape["at inside"],
            shape["domain"], low in _TOP, word[-1:] in ",.;:!?", capital and word[-1:] in ",;!?")


def features(word: str) -> np.ndarray:
    """Shape features of one word."""
    bare = word.strip("\"'`.,;!?()[]{}<>")
    name, _, value = bare.partition("=" if "=" in bare else ":")
    body = value or bare
    up, low, dig = (any(f(c) for c in body) for f in (str.isupper, str.islower, str.isdigit))
    other = any(not c.isalnum() for c in body)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:], strict=False))
    on = (True, bare.islower() and bare.isalpha(), bare[:1].isupper() and bare[1:].islower(), bare.isupper() and bare.isalpha(), bare.isdigit(),
          (up or low) and dig, up and dig and not low, dig and len(body) >= 12 and all(c in "0123456789abcdefABCDEF" for c in body), other,
          bool(value), bool(value) and name.lower() in _CUES, bare.rstrip(":=").lower() in _CUES, word.lower() in _JOINS, len(body) < 4,
          len(body) >= 10, len(body) >= 16, up + low + dig + other >= 3 and switches >= 2)
    return np.array((*on, *kind_features(word, bare)), float)


@dataclass
class Field:
    """Weights of own, preceding and following word's features per label (0: none, then FIELD_KINDS), transitions,
    and weights of the features of the word before the preceding one."""

    own: np.ndarray
    before: np.ndarray
    behind: np.ndarray
    moves: np.ndarray
    further: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Label scores (n x labels) of one chain from its words' features."""
        e = x @ self.own
        e[1:] += x[:-1] @ self.before
        e[:-1] += x[1:] @ self.behind
        if self.further is not None:
            e[2:] += x[:-2] @ self.further
        return e


def labelled_rows(count: int = 480) -> list[tuple[int, list[str], list[int]]]:
    """The small labelled table, by a rule: sentences of ordinary words, three of four with two entities of the
    field's kinds in their usual forms, and look-alikes (numbers, codes in capitals, dates, addresses) that are none."""
    rng = np.random.default_rng(5)
    plain = "the of and you can reach house Report der und les que para Monday river window, seven. ordered (see below) it's Paris on at am le".split()
    alike = ["2024", "12:30", "42.144.35.254", "a.b@mail.example.com", "NATO", "WITH!!", "x=1", "4876179267539117", "B2B", "3rd", "key", "note:",
             "17", "350", "12.03.2021", "2019-05-04", "example.com", "May", "call", "street", "born", "id", "=", "(2)", "1,250", "10-12",
             "de", "es", "st.", "St", "fr", "io", "AT", "DOT", "com", "Road", "B12", "0", "ein", "name"]

    def code(alphabet: str, n: int) -> str:
        return "".join(rng.choice(list(alphabet), n))

    def one(words: str) -> str:
        return str(rng.choice(words.split()))

    upper, low, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    given, months, streets = (sorted(x) for x in (_GIVEN, _MONTHS, _STREETS - {"st", "rue", "calle", "avenida", "plaza"}))

    def pick(words: list[str]) -> str:
        return str(rng.choice(words)).capitalize()

    def family() -> str:
        return code(upper, 1) + code(low, int(rng.integers(3, 9)))

    def n(k: int) -> str:
        return str(rng.integers(1, 10)) + code(digits, k - 1)

    def date() -> str:
        d, m, y = int(rng.integers(1, 29)), int(rng.integers(1, 13)), int(rng.integers(1930, 2011))
        return [f"{d:02}.{m:02}.{y}", f"{d}/{m}/{y}", f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}"][int(rng.integers(0, 4))]

    def town() -> list[str]:
        return [[], [n(5), family()]][int(rng.integers(0, 2))]

    # each form: (words that lead to it, words of the entity)
    forms = [
        [lambda: ([], ["AKIA" + code(upper + digits, 16)]), lambda: ([], ["password=" + code("abcdef" + digits, int(rng.integers(8, 20)))]),
         lambda: ([], ["pwd:" + code(low + digits, 9)]), lambda: ([], ["token=" + code(upper + low + digits, 24)]),
         lambda: ([], ["sk-" + code(upper + low + digits, 20)]), lambda: ([], ["api_key=" + code("abcdef" + digits, 32)]),
         lambda: ([one("password secret token"), "is"], [code(low, 4) + code(digits, 4) + code(upper, 2)]),
         lambda: ([one("token secret api_key"), "="], ['"' + code("abcdef" + digits, int(rng.integers(24, 41))) + '"'])],
        [lambda: ([], [pick(given), family()]), lambda: ([one("Mr. Mrs. Dr. Herr Frau Mme Señora Sr.")], [family()]),
         lambda: ([one("Mr. Mrs. Dr. Herr Frau Madame Señor")], [pick(given), family()]), lambda: (["Name:"], [pick(given), family()])],
        [lambda: ([], [n(int(rng.integers(1, 5))), family(), pick(streets) + one(", . x").replace("x", ""), *town()]),
         lambda: ([], [family() + one("straße strasse weg platz gasse"), n(int(rng.integers(1, 4))) + one(", x").replace("x", ""), *town()]),
         lambda: ([], [n(int(rng.integers(1, 4))), one("rue Rue"), one("de du des"), family() + one(", x").replace("x", ""), *town()]),
         lambda: ([], [one("Calle calle Avenida Plaza"), family() + ",", n(2)])],
        [lambda: ([], [f"{n(3)}-{n(2)}-{n(4)}"]), lambda: (["SSN:"], [f"{n(3)}-{n(2)}-{n(4)}"]),
         lambda: ([], [code(upper, 2) + n(2) + code(digits, int(rng.integers(12, 24)))]),
         lambda: ([one("IBAN IBAN:")], [code(upper, 2) + n(2), *[code(digits, 4) for _ in range(int(rng.integers(3, 6)))], n(2)]),
         lambda: ([one("passport Passport: Ausweis passeport pasaporte ID:")], [code(upper, int(rng.integers(1, 3))) + n(int(rng.integers(6, 9)))]),
         lambda: ([one("DNI DNI: NIF")], [n(8) + code(upper, 1)])],
        [lambda: ([], [f"({n(3)})", f"{n(3)}-{n(4)}"]), lambda: ([one("call Tel. phone:")], [f"({n(3)})", f"{n(3)}-{n(4)}"]),
         lambda: ([], [f"{n(3)}-{n(3)}-{n(4)}"]), lambda: ([], [f"{n(3)}.{n(3)}.{n(4)}"]), lambda: ([one("Tel. Telefon: tél Tel:")], ["0" + n(3), n(int(rng.integers(6, 9)))]),
         lambda: ([], ["0" + n(1), *[code(digits, 2) for _ in range(4)]]), lambda: ([], [f"0{n(int(rng.integers(2, 4)))}/{n(int(rng.integers(6, 9)))}"]),
         lambda: ([one("call Tel: phone: móvil")], [n(3), n(3), n(3)])],
        [lambda: ([one("born DOB: geboren née birthdate:")], [date()]), lambda: (["born", "on"], [date()]), lambda: (["geboren", "am"], [date()]),
         lambda: ([one("né née"), "le"], [date()]), lambda: ([one("nacido nacida"), "el"], [date()]),
         lambda: ([one("born DOB: geboren")], [n(1), pick(months), "19" + n(2)]), lambda: (["born", "on"], [n(2), pick(months), "19" + n(2)])],
        [lambda: ([], [code(low, 5), "[at]", code(low, 6), "[dot]", one("com org de")]), lambda: ([], [code(low, 6), "(at)", code(low, 5), "(dot)", one("com net fr")]),
         lambda: ([], [code(low, 4) + "." + code(low, 5), "[at]", code(low, 7) + one(".com .org .es")]), lambda: ([], [code(low, 5), "AT", code(low, 7), "DOT", one("com org")]),
         lambda: ([], [code(low, 5), "(at)", code(low, 6) + one(".com .de")]), lambda: ([], [f"{code(low, 5)}[at]{code(low, 6)}[dot]com"]),
         lambda: ([], [f"{code(low, 5)}(at){code(low, 6)}.com"])]]
    rows = []
    at = 0
    for i in range(count):
        words, labels = [], []
        for part in range(3):
            more = [str(rng.choice(plain if rng.random() < 0.8 else alike)) if rng.random() < 0.9 else family() for _ in range(int(rng.integers(2, 7)))]
            if i % 8 == 0:  # the same word again and again, or shouting
                more = [str(rng.choice(["de", "st.", "of", code(low, 11), code(low, 5), family(), family() + ".", family() + ","]))] * len(more) if i % 16 else [w.upper() + "!!" * (part > 0) for w in more]
            words += more
            labels += [0] * len(more)
            if i % 4 and part < 2:
                kind, at = at % len(forms), at + 1
                lead, entity = forms[kind][int(rng.integers(0, len(forms[kind])))]()
                words += [*lead, *entity]
                labels += [0] * len(lead) + [kind + 1] * len(entity)
        rows.append((i, words, labels))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "sentence long, words array<string>, labels array<int>")


def train(table: DataFrame, steps: int = 250, rate: float = 0.5, ridge: float = 2e-3, max_rows: int = 5000) -> Field:
    """Fit on a small labelled table (sentence, words, labels), at most `max_rows` rows in order of sentence."""
    rows = [r for r in table.orderBy("sentence").limit(max_rows).collect() if r["words"] and r["labels"] and len(r["words"]) == len(r["labels"])]
    f, k = len(_FEATURES), 1 + max([len(FIELD_KINDS), *(max(r["labels"]) for r in rows)])
    field = Field(*(np.zeros((f, k)) for _ in range(3)), np.zeros((k, k)), np.zeros((f, k)))
    if not rows:
        return field
    # all chains side by side, padded behind their ends
    lens = np.array([len(r["labels"]) for r in rows])
    x, y, live = np.zeros((len(rows), lens.max(), f)), np.zeros((len(rows), lens.max()), np.int64), np.arange(lens.max()) < lens[:, None]
    for i, r in enumerate(rows):
        x[i, :lens[i]], y[i, :lens[i]] = np.stack([features(w or "") for w in r["words"]]), r["labels"]
    truth = np.eye(k)[y] * live[:, :, None]
    parts = (field.own, field.before, field.behind, field.further, field.moves)
    square = [np.zeros_like(w) for w in parts]
    counted = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    for _ in range(steps):
        e = x @ field.own
        e[:, 1:] += x[:, :-1] @ field.before
        e[:, :-1] += x[:, 1:] @ field.behind
        e[:, 2:] += x[:, :-2] @ field.further
        own, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(field.moves)
        a, b, scale = own.copy(), np.ones_like(own), np.ones(live.shape)
        scale[:, 0] = a[:, 0].sum(axis=1)
        a[:, 0] /= scale[:, :1]
        for t in range(1, live.shape[1]):
            a[:, t] = np.where(live[:, t, None], (a[:, t - 1] @ move) * own[:, t], a[:, t - 1])
            scale[:, t] = np.where(live[:, t], a[:, t].sum(axis=1), 1.0)
            a[:, t] /= scale[:, t, None]
        expected = np.zeros((k, k))
        for t in range(live.shape[1] - 2, -1, -1):
            reach = np.where(live[:, t + 1, None], own[:, t + 1] * b[:, t + 1] / scale[:, t + 1, None], 0.0)
            b[:, t] = np.where(live[:, t + 1, None], reach @ move.T, 1.0)
            expected += (a[:, t].T @ reach) * move
        d = truth - a * b * live[:, :, None]

        def slope(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            return u.reshape(-1, f).T @ v.reshape(-1, k)

        grads = (slope(x, d), slope(x[:, :-1], d[:, 1:]), slope(x[:, 1:], d[:, :-1]), slope(x[:, :-2], d[:, 2:]), counted - expected)
        for w, g, s in zip(parts, grads, square, strict=True):
            g = g / len(rows) - ridge * w
            s += g * g
            w += rate * g / np.sqrt(s + 1e-8)
    return field


class Decoder:
    """Viterbi decoding of whole slices; a word's score rows are remembered up to a bound."""

    def __init__(self, field: Field):
        self.field, self.index, self.shapes = field, {}, {}
        self.weights = np.concatenate([w for w in (field.own, field.before, field.behind, field.further) if w is not None], axis=1)
        self.table = np.zeros((1024, self.weights.shape[1]))

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > MEMORY_WORDS:
            self.index.clear()
        for w in set(words).difference(self.index):
            i = self.index[w] = len(self.index)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = self._row(w)
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def _row(self, word: str) -> np.ndarray:
        """The scores a word gives itself, the next, the last and the one after the next; plain words of one shape
        that are in no list share theirs."""
        bare = word.strip("\"'`.,;!?()[]{}<>")
        shape = None
        low = bare.lower()
        if bare.isalpha() and (bare.islower() or bare[0].isupper() and bare[1:].islower()) and low not in _LEXICON and not low.endswith(_STREET_ENDS):
            n = len(bare)
            shape = (bare.islower(), bare[0].isupper(), n < 4, n >= 10, n >= 16, low in _CUES, word.lower() in _JOINS, word[-1] in ",.;:!?", word[-1] in ",;!?")
            if shape in self.shapes:
                return self.shapes[shape]
        row = features(word) @ self.weights
        if shape:
            self.shapes[shape] = row
        return row

    def labels(self, chains: list[list[str]]) -> np.ndarray:
        """Labels of all words, chains concatenated.

        A word is none in the best labelling if no label gains on none there whatever its neighbours' labels are;
        these words cut the chains into runs, and only the runs are decoded, with the steps from and to none.
        """
        words = [w for c in chains for w in c]
        lens = np.array([len(c) for c in chains], np.int64)
        lens = lens[lens > 0]
        out = np.zeros(len(words), np.int8)
        if not words:
            return out
        rows, m = self._rows(words), self.field.moves
        k = len(m)
        ends = np.cumsum(lens)
        head, tail = np.zeros(len(words), bool), np.zeros(len(words), bool)
        head[ends - lens], tail[ends - 1] = True, True
        e = rows[:, :k].copy()
        follow = np.flatnonzero(~head)
        e[follow] += rows[follow - 1, k:2 * k]
        e[follow - 1] += rows[follow, 2 * k:3 * k]
        if self.field.further is not None:
            third = follow[~head[follow - 1]]
            e[third] += rows[third - 2, 3 * k:]
        gain = np.maximum((m - m[:, :1]).max(axis=0), 0) + np.maximum((m - m[:1]).max(axis=1), 0)
        at = np.flatnonzero((e[:, 1:] + gain[1:]).max(axis=1) >= e[:, 0])
        if not len(at):
            return out
        first = head[at] | np.concatenate([[True], np.diff(at) > 1])
        last = np.concatenate([first[1:], [True]])
        e = e[at]
        e[first & ~head[at]] += m[0]
        e[last & ~tail[at]] += m[:, 0]
        starts = np.flatnonzero(first)
        lens = np.flatnonzero(last) - starts + 1
        # runs by falling length: at step t the first `live` of them still go on
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        live = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
        came = np.zeros(e.shape, np.int8)
        best = e[starts]
        for t in range(1, int(lens[0])):
            n = live[t]
            spots = starts[:n] + t
            steps = best[:n, :, None] + m
            came[spots] = steps.argmax(axis=1)
            best[:n] = steps.max(axis=1) + e[spots]
        label, found = best.argmax(axis=1), np.zeros(len(at), np.int8)
        for t in range(int(lens[0]) - 1, -1, -1):
            n = live[t]
            spots = starts[:n] + t
            found[spots] = label[:n]
            label[:n] = came[spots, label[:n]]
        out[at] = found
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The field's spans of whole texts by kind and start; neighbouring words of one kind are one span."""
        chains = [line.split() for t in texts for line in t.split("\n")]
        labels = self.labels(chains)
        out, at = [], 0
        for t in texts:
            n = len(t.split())
            part = labels[at:at + n]
            at += n
            found: list[tuple[int, int, int]] = []
            if part.any():
                last = -2
                part = part.tolist()
                for i, m in enumerate(re.finditer(r"\S+", t)):
                    if part[i]:
                        start, end = m.start(), m.start() + max(1, len(m.group().rstrip("\"'`.,;!?)]}>")))
                        if last == i - 1 and found[-1][0] == part[i] and "\n" not in t[found[-1][2]:start]:
                            start = found.pop()[1]
                        found.append((part[i], start, end))
                        last = i
            out.append([(FIELD_KINDS[k - 1], a, b) for k, a, b in sorted(found)])
        return out


def find_pii(docs: DataFrame, field: Field, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with `out`: all spans by kind (in the order of KINDS) and start.

    A null text has none.  A column named like `out` is replaced.  Empty tables are fine; nothing is shuffled.
    """
    docs = without(docs, out) if out != text else docs
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand weights
    schema = with_fields(docs, docs.sparkSession.createDataFrame([], f"`{out}` {SPAN}").schema[0])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch, texts in slices(batches, text):
            rows = []
            for t, learned in zip(texts, decoder.spans(texts), strict=True):
                base = base_spans(t)
                free = [(k, a, b) for k, a, b in learned if not any(a < y and x < b for _, x, y in base)]
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in [*base, *free]])
            yield appended(batch, [pa.array(rows, pa.list_(kind))], [out])

    return docs.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, spans: str = "spans") -> DataFrame:
    s = F.col(spans)

    def number(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(k) for k in BASE_KINDS]
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))
