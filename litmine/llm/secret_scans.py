"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Tokens of a line, values and single signs, are tagged B (a secret begins), I (it goes
on) or O.  Features of a token are its shape, its neighbours in the line and marks of
the whole file.  Every token of every line has emissions, and Viterbi decodes whole
lines; tokens that no best path can give to a secret, by a bound from the weights
(``Field.possible``), are left out of it as O, which changes no result.
The field is trained on lines that ``training_lines`` makes from written forms of
secrets, of harmless strings and of prose.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import table

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
#: Lines that the field is trained on.
TRAINING_LINES = 600
DIMENSIONS = 1 << 12
O, B, I = range(3)

#: Tokens, a value apart from the name and = before it, and the line break that no chain crosses.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+=*|=+|\n|[^\sA-Za-z0-9+/_.=-]")
#: Characters as d, u, l, x (beyond ASCII) and signs.
_KIND = {i: "d" if chr(i).isdigit() else "u" if chr(i).isupper() else "l" if chr(i).islower() else chr(i) for i in range(128)}
_BEYOND = re.compile(r"[^\x00-\x7F]")
_DOUBLED = re.compile(r"(.)\1+")
_KEYS = ("passw", "secret", "token", "api")
#: Tokens before a token that are its features.
_BEFORE = 4
#: Distinct tokens whose features a task keeps, and their characters.
_CACHED, _CACHED_CHARS = 200_000, 20_000_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; matches that are too short are dropped."""
    spans = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _kinds(token: str) -> str:
    return (token if token.isascii() else _BEYOND.sub("x", token)).translate(_KIND)


def _form(token: str) -> tuple:
    """What the features of a token itself are made of, but for its start."""
    kinds = _kinds(token)
    shape = _DOUBLED.sub(r"\1", kinds)
    n, half = len(token), "".join("d" if c == "d" else "n" for c in shape) if "d" in shape else ""
    classes = ("d" in shape) + 2 * ("l" in shape) + 4 * ("u" in shape) + 8 * ("+" in shape or "/" in shape or "=" in shape) + 16 * ("_" in shape or "." in shape or "-" in shape)
    switches = min(half.count("dn") + half.count("nd"), 12)
    dots = (min(token.count("."), 3), min(token.count("/"), 3), min(token.count("-"), 5))
    return shape[:10], classes, min(n, 60), switches, min(kinds.count("lu"), 8), len(set(token)) * 4 // n, dots


def _of_form(form: tuple) -> list[str]:
    shape, classes, n, switches, cases, letters, dots = form
    return [
        "bias",
        f"shape {shape}",
        f"classes {classes}",
        f"classes {classes} {min(n // 4, 6)}",
        f"length {min(n // 4, 12)}",
        f"exact {min(n, 20)}",
        f"switches {switches} {n // 12}",
        f"cases {cases} {min(n // 6, 6)}",
        f"letters {letters}",
        f"dots {dots}",
    ]


def _own(token: str) -> list[str]:
    return [*_of_form(_form(token)), f"start {token[:3].lower()}", f"start4 {token[:4]}"]


@lru_cache(maxsize=1)
def _context() -> frozenset[str]:
    """Words that the training lines have several times; all others are neighbours by their kind only."""
    seen = Counter(m.lower() for text, _ in training_lines() for m in _TOKEN.findall(text))
    return frozenset(w for w, n in seen.items() if n >= 4)


def _word(token: str, form: tuple | None = None) -> str:
    low = token.lower()
    return low if low in _context() else f"other {(form or _form(token))[0][:3]} {min(len(token) // 6, 4)}"


def _as_before(word: str, k: int) -> list[str]:
    return [f"before{k} {word}", *([f"near {word}"] if word[0].isalnum() or word[0] == "_" else [])]


def _hashed(names: list[str] | tuple[str, ...]) -> list[int]:
    return [xxhash.xxh32_intdigest(n) % DIMENSIONS for n in names]


def token_features(token: str, before: list[str], after: list[str], file: tuple[str, ...]) -> list[int]:
    """Hashed features of a token with its neighbours, nearest first."""
    names = _own(token)
    for k, w in enumerate(before[:_BEFORE]):
        names += _as_before(_word(w), k)
    return _hashed([*names, f"after {_word(after[0]) if after else 'end'}", *file])


def file_features(text: str) -> tuple[str, ...]:
    """Marks of a whole text."""
    n = max(len(text), 1)
    signs = sum(map(text.count, "={};")) * 400 // n
    return (f"signs {min(signs, 4)}", f"lines {min(text.count(chr(10)) * 200 // n, 4)}")


class Field:
    """Weights by feature and tag, and of transitions (from, to)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._clear()

    def __getstate__(self):
        return self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        self._rows: dict[str, int] = {}
        self._chars = 0
        self._sums, self._words = np.zeros((1024, 3)), np.zeros(1024, np.int64)
        self._parts: dict = {}
        self._numbers: dict[str, int] = {}
        # by neighbour: sums of weights as the token after, and as those before
        self._beside = np.zeros((0, 1 + _BEFORE, 3))

    def _part(self, key: tuple | str, names: list[str]) -> np.ndarray:
        self._parts[key] = self.weights[_hashed(names)].sum(axis=0)
        return self._parts[key]

    def _row(self, token: str) -> int:
        row, form, parts = len(self._rows), _form(token), self._parts
        if row == len(self._sums):
            self._sums, self._words = np.concatenate([self._sums, np.zeros_like(self._sums)]), np.concatenate([self._words, np.zeros_like(self._words)])
        own, start, start4 = parts.get(form), f"start {token[:3].lower()}", f"start4 {token[:4]}"
        own = self._part(form, _of_form(form)) if own is None else own
        for name in (start, start4):
            part = parts.get(name)
            own = own + (self._part(name, [name]) if part is None else part)
        self._chars += len(token)
        word = "\n" if token == "\n" else _word(token, form)
        if word not in self._numbers:
            self._numbers[word] = len(self._numbers)
            names = [[f"after {'end' if word == chr(10) else word}"], *[_as_before(word, k) for k in range(_BEFORE)]]
            self._beside = np.concatenate([self._beside, [[self.weights[_hashed(x)].sum(axis=0) for x in names]]])
        self._sums[row], self._words[row], self._rows[token] = own, self._numbers[word], row
        return row

    def emissions(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, 3) scores of a text's tokens, line breaks among them, and which tokens are breaks."""
        if len(self._rows) > _CACHED or self._chars > _CACHED_CHARS:
            self._clear()
        known = self._rows
        tokens = _TOKEN.findall(text)
        ids = np.array([known[t] if t in known else self._row(t) for t in (*tokens, "\n")], np.int64)
        breaks = ids == known["\n"]
        at = np.arange(len(ids))
        since = at - np.maximum.accumulate(np.where(breaks, at, -1))  # 0 at a break, 1 at a line's first token
        words, beside = self._words[ids], self._beside
        emit = self._sums[ids[:-1]] + beside[words[1:], 0] + self.weights[_hashed(file_features(text))].sum(axis=0)
        for k in range(_BEFORE):
            far = k + 1
            if len(emit) > far:
                emit[far:] += beside[words[: -1 - far], 1 + k] * (since[far:-1] > far)[:, None]
        return emit, breaks[:-1]

    def possible(self, emit: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Which tokens a best path can give to a secret; all others are O on it.

        A secret's tokens a..b add to the score of the path that has O there at most the
        sum of their gains, each with its best way in, and the best way out.  So a token
        is O if no stretch of its line around it has a sum above what the way out costs.
        """
        m = self.moves
        gain = np.maximum(emit[:, B] + m[:, B].max(), emit[:, I] + m[1:, I].max()) - emit[:, O] - m[O, O]
        gain[breaks] = -1e6
        to = np.cumsum(gain)
        start = np.minimum.accumulate(to - gain)
        end = np.maximum.accumulate(to[::-1])[::-1]
        return (end - start + m[1:, O].max() - m[O, O] > -1e-3) & ~breaks

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """The best tags of tokens that stand between O's or ends of a line; emit: (tokens, 3)."""
        score, back = self.moves[O] + emit[0] + [0, 0, -1e9], []
        for e in emit[1:]:
            step = score[:, None] + self.moves
            step[O, I] = -1e9  # a secret begins with B
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + e
        tags = [int((score + self.moves[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        emit, breaks = self.emissions(text)
        if not len(emit):
            return []
        at = np.flatnonzero(self.possible(emit, breaks))
        if not len(at):
            return []
        out, places = [], [m.span() for m in _TOKEN.finditer(text)]
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            for k, tag in zip(run, self.viterbi(emit[run])):
                if tag == B:
                    out.append(list(places[k]))
                elif tag == I:
                    out[-1][1] = places[k][1]
        return [(s, e) for s, e in out]


def training_lines(n: int = TRAINING_LINES, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the spans of their secrets, half of them with none."""
    rng = random.Random(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    both = low + low.upper() + digits
    words = ["the", "report", "of", "this", "value", "is", "we", "found", "in", "server", "for", "que", "der", "une", "est", "and", "build", "key", "password", "a", "to"]
    syllables = [c + v + e for c in "b br c ch d f g k l m n p pr r s st t th v w z sch".split() for v in "a e i o u ie au".split() for e in ("", "", "n", "r", "s", "ng", "l")]
    word = lambda least=1, most=4: "".join(rng.choice(syllables) for _ in range(rng.randint(least, most)))

    def prose(k: int) -> str:
        out = []
        for _ in range(k):
            w = rng.choice(words) if rng.random() < 0.4 else word()
            w = w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.03 else w
            w = some(rng.randint(1, 4), digits) if rng.random() < 0.05 else f"{w}-{word()}" if rng.random() < 0.05 else w
            w = w.replace("a", rng.choice("äéàóñ"), 1) if rng.random() < 0.06 else w
            out.append(w + (rng.choice([".", ".", ",", ",", ":", ";", "?", "!", ")"]) if rng.random() < 0.15 else ""))
        return " ".join(out)

    filler = lambda: prose(rng.randint(0, 9))
    named = ("pwd: ", "pwd = ", "credential: ", "auth_key = ", "passphrase = ", "access_key=", "signing key: ")
    secrets = (
        lambda: (rng.choice(("aws_secret_access_key = ", "secret_key: ", "private_key=", "client_secret = ")), some(40, both + "+/")),
        lambda: (rng.choice(("Authorization: Bearer ", "auth = Bearer ", "jwt: ")), f"eyJ{some(20, both)}.eyJ{some(30, both)}.{some(30, both + '_-')}"),
        lambda: (rng.choice(("", "GITHUB_PAT ", "export GH=")), f"ghp_{some(36, both)}"),
        lambda: (rng.choice(("", "stripe key ", "pay_key: ")), f"sk_live_{some(24, both)}"),
        lambda: (rng.choice(("slack ", "bot: ", "")), f"xoxb-{some(12, digits)}-{some(12, digits)}-{some(24, both)}"),
        lambda: (rng.choice(named), some(rng.randint(16, 44), both)),
        lambda: (rng.choice(named), some(rng.randint(6, 11), both)),
        lambda: (rng.choice(named), some(rng.randint(6, 28), low + low.upper())),
        lambda: (rng.choice(named), "".join(word(1, 2).capitalize() for _ in range(rng.randint(2, 5)))),
        lambda: (rng.choice(("recovery key: ", "license key = ", "seed ")), " ".join(some(12, both) + some(2, digits) for _ in range(3))),
        lambda: (rng.choice(("", "google key ", "maps: ")), f"AIza{some(35, both + '_-')}"),
    )
    harmless = (
        lambda: some(rng.randint(5, 12), low) + some(3, digits) + some(6, low),
        lambda: f"{some(8, 'abcdef' + digits)}-{some(4, digits)}-{some(4, digits)}-{some(4, digits)}-{some(12, digits)}",
        lambda: f"https://www.{some(8, low)}.com/{some(6, low)}/{some(4, digits)}",
        lambda: f"{some(3, low)}.{some(2, digits)}@mail{some(1, digits)}.example.com",
        lambda: f"20{some(2, digits)}-{some(2, digits)}-{some(2, digits)}T{some(2, digits)}",
        lambda: some(16, digits),
        lambda: ".".join(some(3, digits) for _ in range(4)),
        lambda: f"{some(5, low)}/{some(6, low)}/{some(4, low)}_{some(2, digits)}.py",
        lambda: f"v{some(1, digits)}.{some(2, digits)}.{some(1, digits)}-beta.{some(2, digits)}",
        lambda: f"+{some(2, digits)}-{some(3, digits)}-{some(7, digits)}",
        lambda: f"{some(6, low)}-{some(2, digits)}-{some(7, low)}",
        lambda: prose(rng.randint(4, 16)),
        lambda: prose(rng.randint(4, 16)),
        lambda: word(4, 8),
        lambda: f"{rng.choice(named)}{prose(rng.randint(2, 6)).lower()}",
        lambda: f"{word(1, 2)} = {word(1, 2)}{word(1, 2).capitalize()}({word(1, 2)}, {some(2, digits)});",
        lambda: f"{word(1, 2)}: {word(1, 3).capitalize()} {word(1, 3).capitalize()}",
        lambda: f"<{word(1, 1)} {word(1, 2)}=\"{word(1, 3)}\">{prose(3)}</{word(1, 1)}>",
    )
    out = []
    for k in range(n):
        head = f"{filler()} ".lstrip()
        if k % 2:
            name, value = rng.choice(secrets)()
            quote = rng.choice(("", '"', "'"))
            start = len(head) + len(name) + len(quote)
            out.append((f"{head}{name}{quote}{value}{quote} {filler()}", [(start, start + len(value))]))
        else:
            out.append((f"{head}{rng.choice(harmless)()} {filler()}", []))
    return out


@lru_cache(maxsize=2)
def train(n: int = TRAINING_LINES, steps: int = 50, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam, gradients by the forward-backward sums of all lines at once."""
    feats, tags, lines = [], [], []
    for text, secrets in training_lines(n):
        file, found = file_features(text), list(_TOKEN.finditer(text))
        words = [m[0] for m in found]
        feats += [token_features(w, words[max(k - _BEFORE, 0) : k][::-1], words[k + 1 : k + 2], file) for k, w in enumerate(words)]
        within = [next((x for x in secrets if x[0] <= m.start() and m.end() <= x[1]), None) for m in found]
        tags += [O if x is None else I if k and within[k - 1] == x else B for k, x in enumerate(within)]
        lines.append(len(words))
    size, tags = np.array(lines), np.array(tags)
    owner, feature = np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.concatenate(feats)
    line = np.repeat(np.arange(len(size)), size)
    spot = np.arange(len(tags)) - np.repeat(np.cumsum(size) - size, size)
    longest, one = size.max(), np.eye(3)[tags]
    last = np.cumsum(size) - 1
    here = np.arange(longest)[None, :] < size[:, None]
    follows = spot > 0
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:-1][follows[1:]], tags[1:][follows[1:]]), 1)
    params = np.zeros((DIMENSIONS + 3, 3))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        moves = params[DIMENSIONS:]
        emit = np.zeros((len(size), longest, 3))
        emit[line, spot] = np.stack([np.bincount(owner, params[feature, c], len(feats)) for c in range(3)], axis=1)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = moves[O] + emit[:, 0]
        for k in range(1, longest):
            forward[:, k] = np.logaddexp.reduce(forward[:, k - 1, :, None] + moves, axis=1) + emit[:, k]
        backward[:] = moves[:, O]
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(here[:, k + 1, None], step, moves[:, O])
        total = np.logaddexp.reduce(forward[:, 0] + backward[:, 0], axis=1)
        p = np.exp(forward[line, spot] + backward[line, spot] - total[line, None]) - one
        pair = forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        grad = np.zeros_like(params)
        for c in range(3):
            grad[:DIMENSIONS, c] = np.bincount(feature, p[owner, c], DIMENSIONS)
        grad[DIMENSIONS:] = np.exp(pair[here[:, 1:]]).sum(axis=0) - seen
        grad[DIMENSIONS + O] += p[~follows].sum(axis=0)
        grad[DIMENSIONS:, O] += p[last].sum(axis=0)
        grad = grad / len(size) + decay * params
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        params -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Field(params[:DIMENSIONS], params[DIMENSIONS:])


def find_secrets(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets; the field adds only what no fixed pattern touches."""
    text = text or ""
    base = base_spans(text)
    added = [(s, e, "crf") for s, e in field.spans(text) if not any(s < y and x < e for x, y, _ in base)]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


_SCHEMA = "doc_id {}, n_assign long, n_access long, n_hex long, n_crf long, base string, spans string"


def _scan(field: Field):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t.as_py(), field) for t in batch.column(1)]
            join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
            counts = [pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in KINDS]
            base = pa.array([join([x for x in f if x[2] != "crf"]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array(map(join, found), pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return scan


def scan_secrets(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, counts by kind, ``base`` and ``spans`` as kind:start:end lists.

    Places are code points, the end exclusive.  Null is the empty text; repeated rows
    get equal results; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(field or train()), _SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_crf")
