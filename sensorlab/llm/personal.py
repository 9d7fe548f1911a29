"""Personal data: exact base patterns, and a linear-chain conditional random field beside them.

Base kinds are patterns with checks: ``email``, ``ip``, ``card`` (Luhn) and ``phone``
(international). Each is searched from its rare mark, so a text costs time in
proportion to its length, whatever it holds.

The field finds what no pattern tells: ``person``, ``address``, ``national_id``, ``iban``,
``birth_date`` and ``local_phone``. A text is cut into words, numbers and marks. Every token
has a shape (letter case and length, number of digits, the mark itself) and, for cue words,
its name; a label's score adds weights of the shapes and cues two tokens around, of
neighbouring shapes and of the gap before. Labels are the begin and inside of each kind, or
none. Weights maximise the likelihood of a small labelled table (``labelled_rows``; any
other table of texts with marked spans will do) with a ridge penalty.

Decoding is exact. A token is settled as none where no choice of its neighbours could
make another label better, told by the transition weights alone; what lies between settled
tokens is decoded by Viterbi, all stretches of a batch step by step in numpy. Most
tokens of prose are settled, so the work is the scores.

An added span that overlaps a base span is left out; base spans always stay. Spans are in
code points, end exclusive, listed by kind and start. Null and empty texts have no
spans; texts are read whole, long ones in pieces that end between tokens. Equal rows get
equal spans; an empty table gives an empty table; columns of the table that clash with a
result column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorlab.llm.common import map_arrow, slices, text_bytes
from sensorlab.llm.secret_scan import redact

BASE = ("email", "ip", "card", "phone")
ADDED = ("person", "address", "national_id", "iban", "birth_date", "local_phone")
KINDS = BASE + ADDED
ROWS, EPOCHS, BATCH, RATE, RIDGE, SEED = 4000, 8, 100, 0.3, 0.01, 29
#: Rows of a labelled table that a fit takes at most; it is held on the driver.
MOST_ROWS = 20_000

SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# --- base patterns ---------------------------------------------------------

# The contract's patterns, anchored at their mark or at the start of a run.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            # the run of local characters before the mark, read backwards in growing pieces
            low = max(done, start - 64)
            own = _LOCAL.search(text[low:start]).group()
            start -= len(own)
            if len(own) < 64:
                break
        match = _DOMAIN.match(text, at) if start < at else None
        # a mark without a domain ends the run, too: the next one begins behind it
        done = match.end() if match else at + 1
        if match:
            yield start, done
        at = text.find("@", done)


def _ips(text: str):
    for match in _IP.finditer(text):
        parts = match[0].split(".")
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in parts):
            yield match.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(_LUHN[int(d)] for d in even)) % 10 == 0


def _cards(text: str):
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = _NOT_DIGIT.sub("", match[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def _phones(text: str):
    for match in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
            yield match.span()


_SEARCH = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind as listed, then start."""
    return [(a, b, kind) for kind in BASE for a, b in _SEARCH[kind](text)]


# --- tokens and their symbols ------------------------------------------------

_TOKEN = re.compile(r"(?:[^\W\d_]+|[0-9]+|\S)\s*")
_SPACES = re.compile(r"\s*")
#: Characters after which a long text is read on in another piece.
PIECE = 500_000
#: Bytes of tokens that a task remembers with their symbols.
REMEMBERED_BYTES = 64_000_000
_MARKS = ".,:;-/()+@#'\"&_*|<>=[]!?"


def shape(token: str) -> str:
    first = token[0]
    if first.isalpha():
        n = len(token)
        size = str(n) if n < 4 else "4" if n < 8 else "8"
        if not (first.islower() or first.isupper()):
            return "x" + size
        kind = (
            "l"
            if token.islower()
            else "A"
            if token.isupper() and n > 1
            else "U"
            if token[1:].islower() or n == 1
            else "M"
        )
        return kind + size
    if "0" <= first <= "9":
        return "d" + str(min(len(token), 13))
    return first if first in _MARKS else "p"


_SHAPES = [
    "edge",
    *(kind + size for kind in "lAUMx" for size in ("1", "2", "3", "4", "8")),
    *(f"d{n}" for n in range(1, 14)),
    *_MARKS,
    "p",
]
_SHAPE_AT = {name: i for i, name in enumerate(_SHAPES)}
#: Gaps before a token: none, spaces, a line end.
GAPS = 3
LABELS = 1 + 2 * len(ADDED)


class Tokens:
    """Tokens of texts as numbers: shape, cue and the gap behind, with their places."""

    def __init__(self, cues: dict[str, int]):
        self.cues, self.known, self.held = cues, {}, 0

    def _symbol(self, token: str) -> int:
        bare = token.rstrip()
        gap = 0 if len(bare) == len(token) else 2 if "\n" in token else 1
        cue = self.cues.get(bare.lower(), 0)
        symbol = (cue * len(_SHAPES) + _SHAPE_AT[shape(bare)]) * GAPS + gap
        return symbol << 40 | len(token) - len(bare)

    def read(self, text: str) -> tuple[np.ndarray, ...]:
        """Shape, cue, gap before, start and end of every token."""
        symbols, lengths = [], []
        done = _SPACES.match(text).end()
        first = done
        while done < len(text):
            stop = len(text)
            if stop - done > PIECE:
                cut = re.compile(r"\s(?=\S)").search(text, done + PIECE)
                stop = cut.end() if cut else stop
            tokens = _TOKEN.findall(text[done:stop])
            done = stop
            found = list(map(self.known.get, tokens))
            for i, symbol in enumerate(found):
                if symbol is None:
                    found[i] = self._symbol(tokens[i])
                    if self.held < REMEMBERED_BYTES:
                        self.known[tokens[i]] = found[i]
                        self.held += 150 + 2 * len(tokens[i])
            symbols.append(np.array(found, np.int64))
            lengths.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        if not symbols:
            return (np.zeros(0, np.int64),) * 5
        packed, length = np.concatenate(symbols), np.concatenate(lengths)
        starts = np.cumsum(length) - length + first
        kind, gap = np.divmod(packed >> 40, GAPS)
        cue, shapes = np.divmod(kind, len(_SHAPES))
        before = np.concatenate(([2], gap[:-1]))
        return shapes, cue, before, starts, starts + length - (packed & (1 << 40) - 1)


# --- the field ---------------------------------------------------------------

REACH = 2
#: Tokens that are scored at once.
TILE = 65_536
#: Tokens to either side that are looked at before a token is decoded.
ROUNDS = 4
#: Bytes of texts whose tokens are decoded together.
TEXT_BYTES = 2_000_000


class Field:
    """Weights of a label by shapes and cues around, and of neighbouring labels."""

    def __init__(self, cues: dict[str, int], tables: dict[str, np.ndarray], steps: np.ndarray):
        self.cues, self.tables, self.steps = cues, tables, steps
        # the most that neighbours can add to a label against none
        gain = steps[:, :, None] + steps[None, :, :]  # before, label, after
        self.most = (gain - gain[:, :1, :]).max(axis=(0, 2))
        #: For each kind of label, the greatest gain of a table's entry over none.
        pairs = [slice(1 + 2 * i, 3 + 2 * i) for i in range(len(ADDED))]
        self.bounds = {
            name: [
                (table[..., own] - table[..., :1]).max(axis=-1).astype(np.float32) for own in pairs
            ]
            for name, table in tables.items()
        }
        for gap, own in zip(self.bounds["gap"], pairs):
            gap += self.most[own].max() + 1e-3

    def scores_at(
        self, places: np.ndarray, shapes: np.ndarray, cues: np.ndarray, gaps: np.ndarray
    ) -> np.ndarray:
        """Scores of the tokens at some places that are REACH from either end at least."""
        out = self.tables["gap"][gaps[places]]
        for offset in range(2 * REACH + 1):
            around = places + (offset - REACH)
            out += self.tables["shape"][offset][shapes[around]]
            own = cues[around]
            told = np.flatnonzero(own)
            out[told] += self.tables["cue"][offset][own[told]]
        own = shapes[places]
        out += self.tables["pair"][0][shapes[places - 1] * len(_SHAPES) + own]
        out += self.tables["pair"][1][own * len(_SHAPES) + shapes[places + 1]]
        return out

    def doubtful(self, shapes: np.ndarray, cues: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Places that the sums of each table's greatest gains over none do not settle."""
        held = np.zeros((len(self.bounds["gap"]), len(shapes)), np.float32)
        for kind, out in enumerate(held):
            n = len(shapes)
            out += self.bounds["gap"][kind][gaps]
            for offset in range(2 * REACH + 1):
                low, high = max(REACH - offset, 0), min(n + REACH - offset, n)
                around = slice(low + offset - REACH, high + offset - REACH)
                out[low:high] += self.bounds["shape"][kind][offset][shapes[around]]
                out[low:high] += self.bounds["cue"][kind][offset][cues[around]]
            both = shapes[:-1] * len(_SHAPES) + shapes[1:]
            out[1:] += self.bounds["pair"][kind][0][both]
            out[:-1] += self.bounds["pair"][kind][1][both]
        return np.flatnonzero(held.max(axis=0) > 0)

    def labels(self, shapes: np.ndarray, cues: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """The likeliest labels of sequences of tokens; REACH edges stand before and after each."""
        out = np.zeros(len(shapes), np.int8)
        places, held = [], []
        edge = shapes == 0
        doubtful = self.doubtful(shapes, cues, gaps)
        doubtful = doubtful[~edge[doubtful]]
        for begin in range(0, len(doubtful), TILE):
            place = doubtful[begin : begin + TILE]
            own = self.scores_at(place, shapes, cues, gaps)
            open_ = (own[:, 1:] - own[:, :1] + self.most[1:] > 0).any(axis=1)
            places.append(place[open_])
            held.append(own[open_])
        if places:
            place, own = narrowed(np.concatenate(places), np.concatenate(held), self.steps)
            out[place] = viterbi(place, own, self.steps)
        return out


def narrowed(
    place: np.ndarray, scores: np.ndarray, steps: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The places that bounds from some tokens before and behind do not settle as none.

    A label's greatest gain over none on a path up to a token is at most its own gain, its step's
    and the greatest of a label before; likewise from behind. Every round looks one token farther.
    """
    labels = range(len(steps))
    # one row for each label, so that a row of all tokens is worked on at a time
    gain = np.ascontiguousarray((scores - scores[:, :1]).T, np.float32)
    moves = {True: steps - steps[0, 0], False: (steps - steps[0, 0]).T}
    bounds = {}
    for forward, move in moves.items():
        bounds[forward] = gain + (move - move[:, :1]).max(axis=0).astype(np.float32)[:, None] + move[0, 0]
    kept = np.arange(len(place))
    for _ in range(ROUNDS):
        if not len(kept):
            break
        alone = np.flatnonzero(np.diff(place[kept]) != 1)
        for forward, move in moves.items():
            own = bounds[forward]
            own[0] = 0
            # beside a settled token no other label than none can be left
            beside = np.full_like(own, -np.inf)
            if forward:
                beside[:, 1:] = own[:, :-1]
                beside[:, alone + 1] = -np.inf
            else:
                beside[:, :-1] = own[:, 1:]
                beside[:, alone] = -np.inf
            beside[0] = 0
            fresh = np.empty_like(own)
            for y in labels[1:]:
                most = beside[0] + np.float32(move[0, y])
                for a in labels[1:]:
                    np.maximum(most, beside[a] + np.float32(move[a, y]), out=most)
                np.minimum(own[y], gain[y] + most, out=fresh[y])
            bounds[forward] = fresh
        left = ((bounds[True] + bounds[False] - gain)[1:] > -1e-3).any(axis=0)
        kept, gain = kept[left], gain[:, left]
        bounds = {forward: own[:, left] for forward, own in bounds.items()}
    return place[kept], scores[kept]


def viterbi(place: np.ndarray, scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Likeliest labels of the tokens at ``place``; those at no place have label 0.

    Consecutive places are a stretch; the stretches are decoded together, longest first.
    """
    if not len(place):
        return np.zeros(0, np.int8)
    heads = np.flatnonzero(np.diff(place, prepend=place[0] - 2) != 1)
    sizes = np.diff(np.append(heads, len(place)))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    best = steps[0] + scores[heads]
    last = np.zeros((len(heads), scores.shape[1]))
    back = []
    for t in range(1, int(sizes[0]) + 1):
        now = int(active[t]) if t < sizes[0] else 0
        # stretches of this length end before a token without a label
        last[now : int(active[t - 1])] = best[now:] + steps[:, 0]
        if now:
            paths = best[:now, :, None] + steps
            back.append(paths.argmax(axis=1).astype(np.int8))
            best = paths.max(axis=1) + scores[heads[:now] + t]
    out = np.zeros(len(place), np.int8)
    label = last.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        now = int(active[t])
        out[heads[:now] + t] = label[:now]
        if t:
            label[:now] = back[t - 1][np.arange(now), label[:now]]
    return out


def fit_field(rows: list[tuple[str, list[tuple[int, int, str]]]], cue_words: list[str]) -> Field:
    """Weights by adaptive gradient steps on the exact likelihood of labelled texts."""
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a labelled table of more than {MOST_ROWS} rows")
    cues = {word: i + 1 for i, word in enumerate(sorted(set(cue_words)))}
    reader = Tokens(cues)
    read = [reader.read(text) for text, _ in rows]
    length = max(len(r[0]) for r in read)
    count, kinds = len(rows), len(_SHAPES)
    alive = np.zeros((count, length), bool)
    truth = np.zeros((count, length), np.int64)
    for i, ((_, spans), (_, _, _, starts, ends)) in enumerate(zip(rows, read)):
        alive[i, : len(starts)] = True
        for a, b, kind in spans:
            own = np.flatnonzero((starts >= a) & (ends <= b))
            if not len(own) or starts[own[0]] != a or ends[own[-1]] != b:
                raise ValueError(f"a span of {rows[i][0]!r} does not begin or end with a token")
            truth[i, own] = 2 + 2 * ADDED.index(kind)
            truth[i, own[0]] -= 1
    at = np.flatnonzero(alive.ravel())
    # every token's places in one table of weights
    sizes = {"gap": GAPS, "shape": (2 * REACH + 1) * kinds, "cue": (2 * REACH + 1) * (len(cues) + 1)}
    sizes["pair"] = 2 * kinds * kinds
    offsets = dict(zip(sizes, np.cumsum([0, *sizes.values()])))
    columns = []
    for shapes, cue, gaps, _, _ in read:
        n = len(shapes)
        pad = np.zeros(REACH, np.int64)
        wide_shapes, wide_cues = np.concatenate((pad, shapes, pad)), np.concatenate((pad, cue, pad))
        own = [offsets["gap"] + gaps]
        for o in range(2 * REACH + 1):
            own.append(offsets["shape"] + o * kinds + wide_shapes[o : o + n])
            own.append(offsets["cue"] + o * (len(cues) + 1) + wide_cues[o : o + n])
        own.append(offsets["pair"] + wide_shapes[REACH - 1 : REACH - 1 + n] * kinds + shapes)
        own.append(
            offsets["pair"] + kinds * kinds + shapes * kinds + wide_shapes[REACH + 1 : REACH + 1 + n]
        )
        columns.append(np.stack(own, axis=1))
    sizes_of = [len(c) for c in columns]
    used, columns = np.unique(np.concatenate(columns), return_inverse=True)
    columns = np.split(columns.reshape(-1, 4 * REACH + 5), np.cumsum(sizes_of)[:-1])
    # a token without a cue has no weight for it
    silent = np.isin(used, [offsets["cue"] + o * (len(cues) + 1) for o in range(2 * REACH + 1)])
    weights, steps = np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS))
    squares, step_squares = np.full(weights.shape, 1e-8), np.full(steps.shape, 1e-8)
    lengths = alive.sum(axis=1)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(count)
        for begin in range(0, count, BATCH):
            own = order[begin : begin + BATCH]
            longest = int(lengths[own].max())
            live, labels = alive[own, :longest], truth[own, :longest]
            at = np.flatnonzero(live.ravel())
            flat = np.concatenate([columns[i] for i in own.tolist()])
            scores = np.zeros((live.size, LABELS))
            scores[at] = weights[flat].sum(axis=1)
            marginals, expected = _expected(scores.reshape(*live.shape, LABELS), live, steps)
            left = np.eye(LABELS)[labels.ravel()[at]] - marginals.reshape(-1, LABELS)[at]
            # rows of weights that this batch has, and the sum of what is left at each
            by_weight = np.argsort(flat.ravel(), kind="stable")
            named = flat.ravel()[by_weight]
            heads = np.flatnonzero(np.diff(named, prepend=-1))
            rows_ = named[heads]
            slope = np.add.reduceat(left[by_weight // flat.shape[1]], heads, axis=0)
            slope -= RIDGE * weights[rows_]
            slope[silent[rows_]] = 0
            seen = np.zeros(steps.shape)
            np.add.at(seen, (labels[:, :-1][live[:, 1:]], labels[:, 1:][live[:, 1:]]), 1)
            np.add.at(seen[0], labels[:, 0], 1)
            np.add.at(seen[:, 0], labels[np.arange(len(own)), lengths[own] - 1], 1)
            step_slope = seen - expected - RIDGE * steps
            squares[rows_] += slope**2
            step_squares += step_slope**2
            weights[rows_] += RATE * slope / np.sqrt(squares[rows_])
            steps += RATE * step_slope / np.sqrt(step_squares)
    whole = np.zeros((sum(sizes.values()), LABELS))
    whole[used] = weights
    tables = {name: whole[offsets[name] : offsets[name] + n] for name, n in sizes.items()}
    tables["shape"] = tables["shape"].reshape(-1, kinds, LABELS)
    tables["cue"] = tables["cue"].reshape(-1, len(cues) + 1, LABELS)
    tables["pair"] = tables["pair"].reshape(2, -1, LABELS)
    return Field(cues, tables, steps)


def _expected(scores: np.ndarray, alive: np.ndarray, steps: np.ndarray):
    """Marginals of labels and expected steps; every row begins and ends beside label 0."""
    count, length, labels = scores.shape
    own = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps)
    forward, backward = np.zeros_like(own), np.zeros_like(own)
    forward[:, 0] = move[0] * own[:, 0]
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        into = (forward[:, t - 1] @ move) * own[:, t]
        into /= into.sum(axis=1, keepdims=True)
        forward[:, t] = np.where(alive[:, t, None], into, forward[:, t - 1])
    backward[:, -1] = move[:, 0]
    expected = np.zeros_like(steps)
    for t in range(length - 2, -1, -1):
        ahead = own[:, t + 1] * backward[:, t + 1]
        back = ahead @ move.T
        back /= back.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(alive[:, t + 1, None], back, backward[:, t + 1])
        total = ((forward[:, t] @ move) * ahead).sum(axis=1)
        share = forward[:, t] * (alive[:, t + 1] / total)[:, None]
        expected += move * (share.T @ ahead)
    marginals = forward * backward
    marginals /= marginals.sum(axis=2, keepdims=True)
    expected[0] += marginals[:, 0].sum(axis=0)
    expected[:, 0] += marginals[np.arange(count), alive.sum(axis=1) - 1].sum(axis=0)
    return marginals, expected


# --- the labelled table ------------------------------------------------------

# Sentences with marked places, in four languages; a place is a kind, or other text.
TEMPLATES = (
    "My name is {person}.",
    "my name is {person} and i live in {place}",
    "Name: {person}",
    "Full name: {person}, {place}",
    "Dear {person},",
    "Dear Mr. {person}, {prose}",
    "Mr {person} {prose}.",
    "Mrs. {person} {prose}.",
    "Dr. {person} {prose}.",
    "Ms {person} said {prose}.",
    "Contact: {person}, {local_phone}",
    "Please contact {person} at {email} {prose}.",
    "Signed by {person} on {date}.",
    "Sincerely, {person}",
    "Patient: {person}, born {birth_date}",
    "Customer {person}, account {iban}",
    "Je m'appelle {person}.",
    "Nom : {person}",
    "Monsieur {person} {prose}.",
    "Madame {person} {prose}.",
    "Ich heiße {person}.",
    "Mein Name ist {person} und {prose}.",
    "Herr {person} {prose}.",
    "Frau {person} {prose}.",
    "Me llamo {person}.",
    "Nombre: {person}",
    "Señor {person} {prose}.",
    "Señora {person} {prose}.",
    "Address: {address}",
    "Home address: {address}, {place}",
    "I live at {address} {prose}.",
    "{prose} at {address}, {prose}.",
    "Ship to {address}.",
    "Adresse : {address}",
    "Anschrift: {address}",
    "Dirección: {address}",
    "{person_line}\n{address}\n{place}",
    "SSN: {national_id}",
    "SSN {national_id} {prose}",
    "Social security number {national_id}.",
    "{prose} social security number is {national_id} {prose}.",
    "{prose} {plain_id} {prose}.",
    "National id: {national_id}",
    "IBAN: {iban}",
    "IBAN {iban} {prose}.",
    "{prose} account {iban}.",
    "Compte : {iban}",
    "Konto {iban}",
    "Cuenta: {iban}",
    "Date of birth: {birth_date}",
    "DOB: {birth_date}",
    "born on {birth_date} {prose}",
    "I was born on {birth_date}.",
    "Né le {birth_date}",
    "Née le {birth_date} {prose}.",
    "Geboren am {birth_date}",
    "geboren am {birth_date} in {place}",
    "Nacido el {birth_date}",
    "Phone: {local_phone}",
    "Tel: {local_phone}",
    "Tel. {local_phone} {prose}",
    "Call me at {local_phone} {prose}.",
    "Call {local_phone} today.",
    "Téléphone : {local_phone}",
    "Telefon: {local_phone}",
    "Teléfono: {local_phone}",
    "Mobile: {local_phone}",
)
OTHERS = (
    "{prose}.",
    "{prose}. {prose}. {prose}, {prose}.",
    "{prose}\n{prose}\n{prose}.",
    "{prose}: {prose} - {prose} ({prose}).",
    "{prose} {number} {prose} {number}.",
    "{prose} {number}, {number}; {number} {prose}.",
    "{prose} {date} {prose}.",
    "Updated on {date}.",
    "{prose} {email} {prose}.",
    "{prose} {ip} {prose}.",
    "{prose} {world_phone} {prose}.",
    "{prose} {card} {prose} {card}",
    "{prose} | {prose} | {ip} | {prose}",
    "{name_line} | {name_line} | {name_line}",
    "{caps} {caps} {caps}",
    "{prose} https://{host}/{code}/{number}?{code}={number} {prose}",
    "def {code}({code}): return {code}[{number}] + {number}.{number}",
    "api_key = \"{code}{number}{code}\" {prose}",
    "password: {code}{number}",
    "{name_line}. {name_line}, {prose} {name_line} {prose}.",
    "Version {number}.{number}.{number} {prose}.",
    "{prose} {number} % {prose}, {number} - {number} {prose}.",
    "Copyright {number} {name_line}. {prose}.",
    "Licensed under the {name_line} {prose}.",
    "the {prose} of the {prose} and {prose} in {number} {prose}.",
    "{prose} le {number} {prose} est {prose} la {prose}.",
    "{prose} der {prose} am {number} {prose} in {prose} und {prose}.",
    "{prose} el {number} {prose} en {prose} de la {prose}.",
    "{name_line} {number} {prose}. {name_line} {prose} {number} {name_line} {prose}.",
    "call {prose} name {prose} contact {prose}. Name {prose}. Call {prose}.",
    "{prose} address {prose} born {prose} on {prose} account {prose}.",
    "{hash} {prose} {hash}",
    "{caps}!! {caps}!! {caps}.",
    "{shout}",
    "{shout}",
    "{noise}",
    "{noise}",
    "{noise}",
    "{again}",
    "{again} {again}",
    "{shout} {prose}. {name_line}",
    "{name_line}\n{name_line}\n{name_line}.",
    "{prose}: {name_line}. {prose}; {name_line} ({number}) {prose}.",
    "{number} {name_line} {prose}, {number} {name_line}.",
    "{code}_{number}: {hash}, {number}/{number}/{number}",
)
# Kinds of streets, before and after their name, and months.
STREETS = ("Street", "St.", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Court")
STREETS_BEFORE = ("rue", "avenue", "boulevard", "Calle", "Avenida", "Plaza")
MONTHS = (
    "January February March April May June July August September October November December "
    "janvier mars avril mai juin juillet Januar März Mai Juni Juli Oktober enero marzo abril mayo julio"
).split()


def labelled_rows(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts and their spans (start, end, kind), drawn by a seed from the sentences above."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    letters = [list("aeiouaeiouéäöüñ"), list("bcdfghklmnprstvwz")]

    def word() -> str:
        made = "".join(
            pick(letters[i % 2]) for i in range(int(rng.integers(1, 10)) + int(rng.integers(0, 2)))
        )
        return made if rng.random() < 0.7 else made + pick(("ing", "tion", "ß", "er", "ment", "ión"))

    def name() -> str:
        return word().capitalize() if rng.random() < 0.93 else word().upper() + pick(letters[1]).upper()

    def digits(low: int, high: int | None = None) -> str:
        return "".join(str(rng.integers(10)) for _ in range(rng.integers(low, (high or low) + 1)))

    def prose() -> str:
        words = [word() for _ in range(rng.integers(1, 9))]
        for i in range(len(words)):
            chance = rng.random()
            if chance < 0.18:
                words[i] = pick(_FUNCTION_WORDS)
            elif chance < 0.24:
                words[i] = words[i].capitalize()
            elif chance < 0.26:
                words[i] += ","
            elif chance < 0.28:
                words[i] += ".\n" + word().capitalize()
            elif chance < 0.30:
                words[i] += ". " + word().capitalize()
        if rng.random() < 0.4:
            words[0] = words[0].capitalize()
        return " ".join(words)

    def person() -> str:
        parts = [name() for _ in range(rng.integers(1, 4))]
        if rng.random() < 0.15:
            parts.insert(1, pick(letters[1]).upper() + ".")
        return (" " if rng.random() < 0.92 else "-").join(parts[:3]) if len(parts) > 1 else parts[0]

    def address() -> str:
        if rng.random() < 0.35:
            before = f"{digits(1, 3)} {pick(STREETS_BEFORE)} {name()}"
            return before if rng.random() < 0.5 else f"{pick(STREETS_BEFORE)} {name()} {digits(1, 3)}"
        if rng.random() < 0.25:
            return f"{name()}{pick(('straße', 'strasse', 'weg', 'platz'))} {digits(1, 3)}"
        middle = " ".join(name() for _ in range(rng.integers(1, 3)))
        return f"{digits(1, 5)} {middle} {pick(STREETS)}".rstrip(".")

    def iban() -> str:
        groups = [digits(4) for _ in range(rng.integers(3, 6))] + [digits(1, 4)]
        head = "".join(chr(65 + rng.integers(26)) for _ in range(2)) + digits(2)
        return head + " " + " ".join(groups) if rng.random() < 0.6 else head + "".join(groups)

    def date() -> str:
        form = int(rng.integers(5))
        month, day, year = digits(1, 2), digits(1, 2), pick(("19", "20")) + digits(2)
        return (
            f"{day}/{month}/{year}",
            f"{year}-{digits(2)}-{digits(2)}",
            f"{day}.{month}.{year}",
            f"{day} {pick(MONTHS)} {year}",
            f"{pick(MONTHS)} {day}, {year}",
        )[form]

    def local_phone() -> str:
        form = int(rng.integers(5))
        return (
            f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"{digits(3)}-{digits(3)}-{digits(4)}",
            f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            f"0{digits(2, 4)}/{digits(5, 8)}",
            f"{digits(3)} {digits(3)} {digits(3, 4)}",
        )[form]

    def shout() -> str:
        mark = pick(("!!", "!", "", "!!!", "?"))
        words = [word().upper() + (mark if rng.random() < 0.8 else "") for _ in range(rng.integers(3, 12))]
        return "".join(w + pick((" ", " ", " ", "\n", ". ", ",")) for w in words).rstrip()

    def noise() -> str:
        marks = pick((("***", "&&&", "###", "%%%"), ("|", "<", ">"), ("$", "#"), ("*", "-", ".", ";")))
        made = (word().capitalize() if rng.random() < 0.35 else word() for _ in range(rng.integers(3, 14)))
        gap = pick((" ", " ", ""))
        return " ".join(w + gap + pick(marks) + pick(("", "", ".", ",")) for w in made)

    def again() -> str:
        own = name() if rng.random() < 0.7 else word()
        return (pick((" ", " ", ". ", "\n"))).join([own] * int(rng.integers(4, 25)))

    fill = {
        "shout": shout,
        "noise": noise,
        "again": again,
        "person": person,
        "address": address,
        "national_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "plain_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": iban,
        "birth_date": date,
        "local_phone": local_phone,
        "date": date,
        "prose": prose,
        "place": lambda: name() if rng.random() < 0.7 else f"{digits(5)} {name()}",
        "person_line": person,
        "name_line": lambda: " ".join(name() for _ in range(rng.integers(1, 4))),
        "caps": lambda: word().upper(),
        "number": lambda: digits(1, 17) if rng.random() < 0.6 else f"{digits(1, 3)}.{digits(1, 3)}",
        "email": lambda: f"{word()}.{digits(1, 2)}@{word()}{digits(1)}.{word()}.com",
        "ip": lambda: ".".join(digits(1, 3) for _ in range(4)),
        "world_phone": lambda: f"+{digits(1, 2)} ({digits(3)}) {digits(3)}-{digits(4)}",
        "card": lambda: digits(16) if rng.random() < 0.7 else " ".join(digits(4) for _ in range(4)),
        "host": lambda: f"{word()}.example.com",
        "code": lambda: word() + ("_" + word() if rng.random() < 0.3 else ""),
        "hash": lambda: hashlib.sha256(word().encode()).hexdigest()[: int(rng.integers(8, 41))],
    }
    marked = {**{kind: kind for kind in ADDED}, "plain_id": "national_id", "person_line": "person"}
    out = []
    for _ in range(rows):
        sentence = pick(TEMPLATES) if rng.random() < 0.5 else pick(OTHERS)
        text, spans = "", []
        if rng.random() < 0.3:
            text = prose() + pick((". ", ".\n", " "))
        for part in re.split(r"(\{\w+\})", sentence):
            if part.startswith("{"):
                kind = part[1:-1]
                made = fill[kind]()
                if kind in marked:
                    spans.append((len(text), len(text) + len(made), marked[kind]))
                text += made
            else:
                text += part
        if rng.random() < 0.3:
            text += pick((" ", "\n", ". ")) + prose()
        out.append((text, spans))
    return out


# Frequent short words of the four languages.
_FUNCTION_WORDS = (
    "the of and to in is that for on with as at by the a le la les de des et en un une est que dans "
    "der die das und ein eine ist von mit zu den el los las y es una por con para"
).split()


def cue_words() -> list[str]:
    """Words of the sentences outside their places, street kinds, months and frequent words."""
    plain = " ".join(re.sub(r"\{\w+\}", " ", t) for t in (*TEMPLATES, *OTHERS))
    plain += " " + " ".join((*STREETS, *STREETS_BEFORE, *MONTHS, *_FUNCTION_WORDS))
    return [w.lower() for w in re.findall(r"[^\W\d_]+", plain)]


@lru_cache(maxsize=1)
def trained_field() -> Field:
    return fit_field(labelled_rows(), cue_words())


# --- scanning ------------------------------------------------------------------


def added_spans(
    texts: list[str], field: Field, reader: Tokens
) -> list[list[tuple[int, int, str]]]:
    """Spans of every text that the field tells, by kind as listed, then start."""
    read = [reader.read(text) for text in texts]
    edge = np.zeros(REACH, np.int64)
    joined = [np.concatenate([edge, *(x for r in read for x in (r[i], edge))]) for i in range(3)]
    labels = field.labels(*joined)
    out, done = [], REACH
    for _, _, _, starts, ends in read:
        own = labels[done : done + len(starts)]
        done += len(starts) + REACH
        spans: list[list] = []
        last = -2
        for i in np.flatnonzero(own).tolist():
            kind, inside = divmod(int(own[i]) - 1, 2)
            if inside and last == i - 1 and spans[-1][2] == kind:
                spans[-1][1] = int(ends[i])
            else:
                spans.append([int(starts[i]), int(ends[i]), kind])
            last = i
        spans.sort(key=lambda s: (s[2], s[0]))
        out.append([(a, b, ADDED[kind]) for a, b, kind in spans])
    return out


def find_spans(
    texts: list[str], field: Field, reader: Tokens
) -> list[list[tuple[int, int, str]]]:
    """Base spans, then added ones that overlap none of them; by kind as listed, then start."""
    out = []
    for text, added in zip(texts, added_spans(texts, field, reader)):
        base = base_spans(text)
        if base and added:
            order = sorted((a, b) for a, b, _ in base)
            begins = np.array([a for a, _ in order])
            reach = np.maximum.accumulate(np.array([b for _, b in order]))
            before = np.searchsorted(begins, [b for _, b, _ in added]).tolist()
            added = [s for s, i in zip(added, before) if not i or reach[i - 1] <= s[0]]
        out.append(base + added)
    return out


def _batch_spans(column: pa.Array, field: Field, reader: Tokens) -> list[list]:
    """Spans of a column of texts, in slices of some size; null has none."""
    texts = text_bytes(column)
    out = []
    for a, b in slices(texts, TEXT_BYTES):
        out += find_spans([t.decode() for t in texts[a:b]], field, reader)
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def scan_personal(df: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """Add the columns of ``SCHEMA``."""
    field = field or trained_field()
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rest = [c for c in df.columns if c not in names]
    at = rest.index(text)
    reader: list[Tokens] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not reader:
            reader.append(Tokens(field.cues))
        rows = []
        for spans in _batch_spans(batch.column(at), field, reader[0]):
            base = [s for s in spans if s[2] in BASE]
            counts = (sum(s[2] == kind for s in base) for kind in BASE)
            rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        new = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*rest, *names])

    kept = df.select(*rest)
    return map_arrow(kept, run, f"{_types(kept)}, {SCHEMA}")


def redact_personal(
    df: DataFrame, mark: str = "[personal]", field: Field | None = None, text: str = "text"
) -> DataFrame:
    """Replace all spans in the text by a mark; all other columns as they are."""
    field = field or trained_field()
    at = df.columns.index(text)
    reader: list[Tokens] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not reader:
            reader.append(Tokens(field.cues))
        columns = list(batch.columns)
        found = _batch_spans(columns[at], field, reader[0])
        texts = columns[at].to_pylist()
        for i, spans in enumerate(found):
            if spans:
                texts[i] = redact(texts[i], sorted(spans), mark)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(df, run, _types(df))
