"""Personal data: fixed patterns, and secrets found by a linear-chain conditional random field.

E-mail and IP addresses, card and phone numbers follow fixed patterns. A linear-chain CRF over word-shape
features labels every word of a text besides; it is trained here from a small labelled table and adds spans of
kinds `secret` (keys, passwords, tokens, also of letters only after a cue such as `password=`) and `personal` (national
phone numbers, identity and account numbers, birth dates after a cue). Every line is decoded: each distinct word's shape is
computed once, and Viterbi decodes many lines at a time in numpy.

Spans are code points, end exclusive. Kinds in order: email, ip, card, phone, secret, personal; spans the field finds that
touch a base span are dropped. A null or empty text has no spans. Rows that repeat are read each. Empty tables
give no rows. Extra columns pass through; those named like a result column give way to it.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried as columns_beside

KINDS = ("email", "ip", "card", "phone", "secret", "personal")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match starts where its run of digits does and never gives digits back, so each run is entered once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: a domain, and before its @ all that may be a name, as far as the last address ended."""
    done = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            done = m.end()
            yield a, done


def _small(part: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start: leftmost, not overlapping within a kind; failing matches are dropped.

    Linear in the length of the text, whatever it holds.
    """
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# -- the random field ---------------------------------------------------------------------------------

#: Labels: outside, words of a secret, words of personal data.
LABELS = ("O", "SECRET", "PERSONAL")
#: Bits of a word's shape: what letters, digits and marks it has, and how long it is.
SHAPE_BITS = ("lower", "upper", "digit", "other", "equals", "colon", "quote", "dash", "long8", "long12", "long16", "long24", "mixed", "digits3", "cue", "about", "number", "area", "rest", "date", "account", "case", "cued", "told")
#: Words that announce a secret, whatever case and marks around them.
CUES = ("token", "password", "passwd", "secret", "apikey", "api_key", "key", "bearer", "pwd", "auth", "credential")
_CUE = re.compile(r"(?i)^\W*(?:" + "|".join(CUES) + r")\b")
#: Words that announce personal data.
SUBJECTS = ("phone", "telephone", "tel", "mobile", "call", "fax", "ssn", "iban", "passport", "born", "birthday", "dob")
_SUBJECT = re.compile(r"(?i)^\W*(?:" + "|".join(SUBJECTS) + r")\b")
#: Whole numbers of persons and accounts, an area code, what may follow one, a date.
_NUMBER = re.compile(r"\(?[0-9]{3}\)?[-./]?[0-9]{3}[-.][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9]{2,4}[-/][0-9]{4,8}")
_AREA = re.compile(r"\([0-9]{2,5}\)")
_REST = re.compile(r"[0-9]{3,4}-?[0-9]{3,5}")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_CASE = re.compile(r"[a-z][A-Z]")
_LOWER, _UPPER = re.compile(r"[a-z]"), re.compile(r"[A-Z]")
_CUE_WORDS, _SUBJECT_WORDS = frozenset(CUES), frozenset(SUBJECTS)
NUMBER = len(SHAPE_BITS)
_BIT = {name: 1 << i for i, name in enumerate(SHAPE_BITS)}


def shape(word: str) -> int:
    """The word's shape as a bit mask, in the order of SHAPE_BITS."""
    core = word.strip(".,;!?()[]{}\"'`")
    if core.isalpha():  # most words: the same facts, with less work
        lower, upper = (core.islower() or not core.isupper(), not core.islower()) if core.isascii() else (bool(_LOWER.search(core)), bool(_UPPER.search(core)))
        n, low = len(core), core.lower()
        out = lower * _BIT["lower"] | upper * _BIT["upper"] | (n >= 8) * _BIT["long8"] | (n >= 12) * _BIT["long12"] | (n >= 16) * _BIT["long16"] | (n >= 24) * _BIT["long24"]
        if upper and _CASE.search(core):
            out |= _BIT["case"]
        if n != len(word) and ('"' in word or "'" in word):
            out |= _BIT["quote"]
        return out | (low in _CUE_WORDS) * _BIT["cue"] | (low in _SUBJECT_WORDS) * _BIT["about"]
    tail = core.rpartition("=")[2] if "=" in core else core
    digits = sum(c in "0123456789" for c in tail)
    upper, lower = any("A" <= c <= "Z" for c in tail), any("a" <= c <= "z" for c in tail)
    n = len(tail)
    value = word.strip(".,;!?\"'`").rpartition("=")[2]
    forms = [bool(x.fullmatch(value)) for x in (_NUMBER, _AREA, _REST, _DATE, _ACCOUNT)] if digits else [False] * 5
    facts = (lower, upper, digits > 0, any(not c.isalnum() for c in tail), "=" in word, ":" in word, '"' in word or "'" in word, "-" in tail or "_" in tail, n >= 8, n >= 12, n >= 16, n >= 24, digits > 0 and (upper or lower) and tail.isascii() and tail.isalnum(), digits >= 3, bool(_CUE.match(word)), bool(_SUBJECT.match(word)), *forms, bool(_CASE.search(tail)))
    return sum(1 << i for i, x in enumerate(facts) if x)


class _Shapes(dict):
    """Shapes by word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = shape(word)
        return out


def in_context(shapes: list[int]) -> list[int]:
    """Shapes of a line's words, with `cued` after a secret's cue and `=` or `:`, and `told` after the subject of personal data."""
    announce = _BIT["cue"] | _BIT["about"]
    if not any(s & announce for s in shapes):
        return shapes
    out = list(shapes)
    for i, s in enumerate(shapes):
        if s & announce:
            letters = _BIT["lower"] | _BIT["upper"] | _BIT["digit"]
            bare = i + 1 < len(shapes) and not shapes[i + 1] & letters and shapes[i + 1] & (_BIT["equals"] | _BIT["colon"])
            at = i + 1 + bool(bare)
            if at < len(shapes):
                if s & _BIT["cue"] and (bare or s & _BIT["colon"]):
                    out[at] |= _BIT["cued"]
                if s & _BIT["about"]:
                    out[at] |= _BIT["told"]
    return out


def _bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(NUMBER)[None, :]) & 1).astype(np.float64)


def _design(shapes: np.ndarray) -> np.ndarray:
    """Features of each word of a sequence: own shape, pairs of own facts, the shapes before and after, a constant."""
    own = _bits(shapes)
    before, after = np.vstack([np.zeros((1, NUMBER)), own[:-1]]), np.vstack([own[1:], np.zeros((1, NUMBER))])
    i, j = np.triu_indices(NUMBER, 1)
    return np.hstack([own, own[:, i] * own[:, j], before, after, np.ones((len(own), 1))])


def labelled_table(n: int = 320, seed: int = 11) -> list[list[tuple[str, int]]]:
    """A small table of labelled sentences, made from a rule: plain words with and without secrets among them."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 7, 9, 12, 15))))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    code = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    mixed = lambda k: "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    marks = ("", "", "", "", ".", ",", "!", ";", "###", "%%%", "***", "$$$", "&&&")
    out = []
    for _ in range(n):
        row = []
        for _ in range(rng.randint(4, 16)):
            r = rng.random()
            if r < 0.75:
                w = plain()
                row.append((w.capitalize() if rng.random() < 0.15 else w) + rng.choice(marks))
            elif r < 0.83:
                row.append(rng.choice((digits(rng.randint(1, 4)), digits(16), f"{digits(2)}.{digits(2)}.{digits(1)}.{digits(3)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}", f"+{digits(1)}", f"{digits(1)}.{digits(1)}.", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}")) + rng.choice(("", "", ".", ",")))
            elif r < 0.88:
                row.append(rng.choice((f"{plain()}.{digits(2)}@{plain()}.example.com", f"http://{plain()}.example.org/{digits(2)}", f"{plain()}-{plain()}", f"{plain().capitalize()}{digits(1)}", plain().upper(), rng.choice(CUES), "|", f"{plain()}:", f'"{plain()}"', f"{plain()}={plain()}", f"{plain().upper()}-{digits(2)}")))
            elif r < 0.91:
                row.append(plain() + plain() + plain())
            else:
                row.append(None)
        sentence: list[tuple[str, int]] = []
        for w in row:
            if w is not None:
                sentence.append((w, 0))
                continue
            kind = rng.randrange(4)
            value = rng.choice((lambda: hexa(rng.randint(16, 48)), lambda: mixed(rng.randint(14, 40)), lambda: code(20)))()
            while not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                value = mixed(24)
            end = rng.choice(("", "", ".", ","))
            if kind == 0:
                sentence.append((f"AKIA{code(16)}{end}", 1))
            elif kind == 1:
                sentence.append((f"{rng.choice(CUES)}={value}{end}", 1))
            elif kind == 2:
                sentence += [(rng.choice(CUES), 0), (rng.choice(("=", ":")), 0), (f'"{value}"{end}', 1)]
            else:
                sentence.append((value + end, 1))
        out.append(sentence)
    return out


def announced_table(n: int = 320, seed: int = 12) -> list[list[tuple[str, int]]]:
    """Labelled sentences, made from a rule, of secrets that only a cue gives away and of personal data."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a=2, b=9: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    camel = lambda: "".join(word(3, 7).capitalize() for _ in range(rng.randint(2, 4)))
    any_case = lambda: rng.choice((str, str.capitalize, str.upper))
    out = []
    for _ in range(n):
        sentence: list[tuple[str, int]] = []
        for _ in range(rng.randint(2, 4)):
            for _ in range(rng.choice((0, 0, 2, 4, 6))):  # a cue may come first in its line
                sentence.append((any_case()(word(1, 10)) + rng.choice(("", "", "", "", ".", ",", ":")), 0))
            end, cue, about = rng.choice(("", "", ".", ",")), any_case()(rng.choice(CUES)), any_case()(rng.choice(SUBJECTS))
            value = rng.choice((camel, camel, lambda: word(6, 20), lambda: word(4, 7) + digits(2)))()
            number = rng.choice((f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}){digits(3)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"0{digits(3)}/{digits(6)}", f"{word(2, 2).upper()}{digits(rng.randint(14, 24))}"))
            date = rng.choice((f"19{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.19{digits(2)}", f"{digits(1)}/{digits(2)}/{digits(2)}"))
            announced = [(about + rng.choice(("", ":")), 0)]
            sentence += rng.choice((
                [(f"{cue}={value}{end}", 1)], [(f"{cue}:{value}{end}", 1)],
                [(cue, 0), (rng.choice(("=", ":")), 0), (rng.choice((value, f'"{value}"', f"'{value}'")) + end, 1)],
                [(f"{cue}:", 0), (rng.choice((camel(), f'"{value}"')) + end, 1)],
                [(cue, 0), (word(), 0)], [(f"{word()}={value}", 0)], [(f"{word()}:{value}", 0)], [(f"{word()}:", 0), (camel(), 0)], [(word(), 0), ("=", 0), (f'"{value}"', 0)],
                [(number + end, 2)], [(f"({digits(3)})", 2), (f"{digits(3)}-{digits(4)}{end}", 2)], [*announced, (number + end, 2)], [*announced, (date + end, 2)], [*announced, (digits(3) + "-" + digits(4) + end, 2)],
                [*announced, (word(), 0)], [(date + end, 0)], [(f"{digits(3)}-{digits(4)}{end}", 0)], [(f"({digits(3)})", 0), (word(), 0)], [(digits(rng.choice((1, 4, 6, 10))) + end, 0)], [(f"{digits(2)}:{digits(2)}{end}", 0)],
            ))
        out.append(sentence)
    return out


class Field:
    """Weights of the field: emissions (features x labels) and transitions."""

    def __init__(self, emissions: np.ndarray, moves: np.ndarray):
        self.emissions, self.moves = emissions, moves


def train(table: list[list[tuple[str, int]]] | None = None, rounds: int = 120, rate: float = 0.8, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch gradients with momentum; the table is a few thousand words."""
    table = [s for s in (table if table is not None else labelled_table() + announced_table()) if s]
    k = len(LABELS)
    x = [_design(np.array(in_context([shape(w) for w, _ in s]))) for s in table]
    lengths = np.array([len(s) for s in table])
    steps = lengths.max()
    live = np.arange(steps)[None, :] < lengths[:, None]
    design, truth = np.vstack(x), np.array([y for s in table for _, y in s])
    gold = np.zeros((len(truth), k))
    gold[np.arange(len(truth)), truth] = 1
    gold_moves = np.zeros((k, k))
    for s in table:
        for (_, a), (_, b) in zip(s, s[1:]):
            gold_moves[a, b] += 1
    w, m = np.zeros((design.shape[1], k)), np.zeros((k, k))
    vw, vm, n = np.zeros_like(w), np.zeros_like(m), len(truth)
    for _ in range(rounds):
        emit = np.zeros((len(table), steps, k))
        emit[live] = design @ w
        e, t = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(m)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, steps):
            a = (alpha[:, i - 1] @ t) * e[:, i]
            alpha[:, i] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(steps - 2, -1, -1):
            on = live[:, i + 1]
            z = e[:, i + 1] * beta[:, i + 1]
            b = z @ t.T
            pairs += (alpha[on, i].T @ (z[on] / (alpha[on, i] * b[on]).sum(axis=1, keepdims=True))) * t
            beta[:, i] = np.where(on[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        vw = 0.9 * vw + design.T @ (gold - post[live]) / n - decay * w
        vm = 0.9 * vm + (gold_moves - pairs) / n - decay * m
        w, m = w + rate * vw, m + rate * vm
    return Field(w, m)


def viterbi(emit: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once (sequences x steps x labels); steps beyond a length are undefined."""
    n, steps, _ = emit.shape
    best, back = emit[:, 0], np.zeros(emit.shape, np.int8)
    final = best.copy()
    for t in range(1, steps):
        through = best[:, :, None] + moves[None]
        back[:, t] = through.argmax(axis=1)
        best = through.max(axis=1) + emit[:, t]
        final = np.where((lengths == t + 1)[:, None], best, final)
    out = np.zeros((n, steps), np.int64)
    rows = np.arange(n)
    out[rows, lengths - 1] = final.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        inside = t <= lengths - 1
        out[inside, t - 1] = back[rows[inside], t, out[inside, t]]
    return out


class Decoder:
    """Finds secrets and personal data in texts with a trained field."""

    def __init__(self, field: Field):
        self.field, self.shapes = field, _Shapes()
        pairs = NUMBER * (NUMBER - 1) // 2
        self.own = np.vstack([field.emissions[: NUMBER + pairs], field.emissions[-1:]])
        self.before, self.after = field.emissions[NUMBER + pairs : 2 * NUMBER + pairs], field.emissions[2 * NUMBER + pairs : -1]

    def _scores(self, shapes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Emissions of words in sequences laid end to end; features are sums over three words' shapes, so each shape is scored once."""
        kinds, of = np.unique(shapes, return_inverse=True)
        bits = _bits(kinds)
        i, j = np.triu_indices(NUMBER, 1)
        own = np.hstack([bits, bits[:, i] * bits[:, j], np.ones((len(kinds), 1))]) @ self.own
        ends = np.cumsum(lengths)
        emit = own[of]
        first, last = np.zeros(len(of), bool), np.zeros(len(of), bool)
        first[ends - lengths], last[ends - 1] = True, True
        emit[1:] += np.where(first[1:, None], 0, (bits @ self.before)[of[:-1]])
        emit[:-1] += np.where(last[:-1, None], 0, (bits @ self.after)[of[1:]])
        return emit

    def entities(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of secrets and personal data in each text."""
        sequences = []  # text, where its line starts, the line, first word, shapes
        for i, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                shapes = in_context([self.shapes[w] for w in _WORD.findall(line)])
                sequences += [(i, at, line, k, shapes[k : k + SEQUENCE]) for k in range(0, len(shapes), SEQUENCE)]
                at += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        spans: dict[tuple[int, int], np.ndarray] = {}
        sequences.sort(key=lambda x: len(x[4]))  # of like length together
        for first in range(0, len(sequences), 1024):
            some = sequences[first : first + 1024]
            lengths = np.array([len(x[4]) for x in some])
            live = np.arange(lengths.max())[None, :] < lengths[:, None]
            emit = np.zeros((*live.shape, len(LABELS)))
            emit[live] = self._scores(np.array([s for x in some for s in x[4]], np.int64), lengths)
            labels = np.where(live, viterbi(emit, self.field.moves, lengths), 0)
            for r in np.flatnonzero(labels.any(axis=1)):
                i, at, line, k, shapes = some[r]
                if (i, at) not in spans:  # once for each line that holds anything
                    spans[i, at] = np.array([m.span() for m in _WORD.finditer(line)], np.int32)
                words, before = spans[i, at][k : k + len(shapes)].tolist(), 0
                for t in np.flatnonzero(labels[r]):
                    kind = int(labels[r, t])
                    a, b = _trim(line, *words[t], _AROUND if kind == 1 else _MARKS)
                    if b > a and kind == 2 and before == t and out[i]:
                        out[i][-1] = ("personal", out[i][-1][1], at + b)  # words of one number
                    elif b > a:
                        out[i].append(("secret" if kind == 1 else "personal", at + a, at + b))
                    before = t + 1 if b > a and kind == 2 else 0
        return [sorted(x, key=lambda e: e[1:]) for x in out]

    def secrets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of secrets in each text."""
        return [[(a, b) for kind, a, b in found if kind == "secret"] for found in self.entities(texts)]


#: Words of a sequence; sequences are lines, longer ones are cut.
SEQUENCE = 256
#: Words whose shapes a worker remembers.
CACHE = 500_000
_AROUND = ".,;!?()[]{}\"'`"
_MARKS = ".,;!?\"'`"


def _trim(text: str, a: int, b: int, around: str = _AROUND) -> tuple[int, int]:
    """A word without marks around it, and only what follows `=`, or a cue and `:`, in it."""
    word = text[a:b]
    if "=" in word.rstrip(around + "=")[:-1]:
        cut = word.rstrip(around + "=").rindex("=") + 1
        a, word = a + cut, word[cut:]
    elif ":" in word.rstrip(around + ":") and (_CUE.match(word) or _SUBJECT.match(word)):
        cut = word.index(":") + 1
        a, word = a + cut, word[cut:]
    a += len(word) - len(word.lstrip(around))
    return a, a + len(word.strip(around))


@functools.cache
def default_field() -> Field:
    """The field trained on the tables above, once for each driver process."""
    return train()


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone, n_secret, n_personal, base_sha256 and spans."""
    field = field if field is not None else default_field()
    new = {**{f"n_{k}": T.LongType() for k in KINDS}, "base_sha256": T.StringType(), "spans": T.StringType()}
    carried = columns_beside(docs, new)
    at = carried.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, every = [], []
            for text, entities in zip(texts, decoder.entities(texts)):
                base = base_spans(text)
                extra = [(k, a, b) for k, a, b in entities if all(b <= x or y <= a for _, x, y in base)]
                for column, kind in zip(counts, KINDS):
                    column.append(sum(k == kind for k, _, _ in (*base, *extra)))
                written = [f"{k}:{a}:{b}" for k, a, b in base]
                digest.append(hashlib.sha256(",".join(written).encode()).hexdigest())
                every.append(",".join([*written, *(f"{k}:{a}:{b}" for k, a, b in extra)]))
            made = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*carried, *new])

    fields = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, t) for n, t in new.items())])
    return docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, fields)
