"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import col, slices

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

#: Fixed by the query contract, written so that no text makes them slow.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z_.-]*[=:]+")
EDGES = "\"'`([{<>}]),;:!?."
#: Without these, a word's features follow from the classes of its characters.
SPECIAL = re.compile(r"[0-9@=:+]")

LABELS = ("", *KINDS)
FEATURES = 1 << 16

#: The labelled table, plain text with marked spans. Generated values stand for {email} and the like.
LABELLED = (
    "write to [email:{email}] soon",
    "{word} [email:{email}] {word}",
    "the host [ip:{ip}] is down",
    "{word} [ip:{ip}] {word}",
    "card [card:{card}] expires",
    "{word} [card:{card}] {word}",
    "{word} [card:{card4}] {word}",
    "call [phone:{phone}] today",
    "{word} [phone:{phone}] {word}",
    "the password=[secret:{hex}] leaked",
    "{word} password=[secret:{mixed}] {word}",
    "passwd: [secret:{mixed}] {word}",
    'token = "[secret:{hexlong}]" {word}',
    '{word} api_key="[secret:{mixed}]" {word}',
    "{word} [secret:{awskey}] {word}",
    "secret key [secret:{awskey}] was found",
    "bearer [secret:{hexlong}] {word}",
    "in {year} there were {small} of them",
    "version {small}.{small} of the software",
    "Licensed under the License, Version 2.0.",
    "General Public License, version 3.",
    "the {small} and {small} made {small}",
    "on {year}-{month}-{month} at {month}:{month} they met",
    "chapter {small}, page {small}.",
    "costs ${small}.{month} or {small}%",
    "see [email:{email}] or [phone:{phone}] {word}",
    "{word} {word} {small}th {word}",
    "room {small}b, level {month}",
    "{word} {word}@ {word} @{word}",
    "model {upper}{small} by {word}",
    "the password=[secret:{plain}] leaked",
    "{word} password=[secret:{plain}] {word}",
    "passwd: [secret:{plain}] {word}",
    "{word} password: [secret:{plain}] {word}",
    "{word} passwd=[secret:{plain}]",
    'token = "[secret:{plain}]" {word}',
    "{word} token=[secret:{plain}] {word}",
    '{word} api_key="[secret:{plain}]" {word}',
    "bearer [secret:{plainlong}] {word}",
    "{word} secret=[secret:{plain}] {word}",
    "the password of {word} was {word}",
    "{word} password {long} {word} {word}",
    "a token of {long} and {word}",
    "the token {long} {word}",
    "the bearer of {word} {word}",
    "bearer {word} {word}",
    "a secret {long} key {word}",
    "{word} passwd {word} {long}",
    "{word}={word} {word}",
    "{word} {word}={long}",
    '{word} = "{long}" {word}',
    "{word}: {long} {word}",
    "note: {word} {long}, {word}",
    "{name} {long} {word}, {word} {long}.",
    "{word} {long} {name} {name} {word}?",
    "({word} {long}) {name}; {word}-{long} {word}'{word}",
    "{upper}{upper}{upper} {word} {upper} {long}! {word}/{word} {word}_{word}",
    "<p> {long} </p> & {word} | # {name} * {word}",
)
REPEATS = 12


def _values(rnd: random.Random) -> dict[str, str]:
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = letters.upper()
    return {
        "word": pick(letters, rnd.randint(2, 9)),
        "long": pick(letters, rnd.randint(8, 24)),
        "name": pick(upper, 1) + pick(letters, rnd.randint(1, 14)),
        "plain": rnd.choice([pick(letters, rnd.randint(8, 20)), pick(upper, 1) + pick(letters + upper, rnd.randint(8, 20)), "".join(pick(upper, 1) + pick(letters, rnd.randint(3, 6)) for _ in range(3))]),
        "plainlong": pick(rnd.choice([letters, letters + upper]), rnd.randint(28, 64)),
        "upper": pick(upper, rnd.randint(1, 3)),
        "email": f"{pick(letters, rnd.randint(2, 8))}{rnd.choice(['', '.', '_'])}{pick(letters + digits, 3)}@{pick(letters, 5)}{rnd.choice(['', '7'])}.{rnd.choice(['com', 'org', 'example.net'])}",
        "ip": ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        "card": pick(digits, rnd.randint(16, 19)),
        "card4": " ".join(pick(digits, 4) for _ in range(4)),
        "phone": rnd.choice(["+1 (%s) %s-%s", "+49 %s %s%s", "+44-%s-%s-%s"]) % (pick(digits, 3), pick(digits, 3), pick(digits, 4)),
        "hex": pick("0123456789abcdef", rnd.randint(12, 24)),
        "hexlong": pick("0123456789abcdef", rnd.randint(32, 64)),
        "mixed": pick(letters + upper + digits, rnd.randint(10, 20)) + rnd.choice(digits),
        "awskey": "AKIA" + pick(upper + digits, 15) + rnd.choice(digits),
        "year": str(rnd.randint(1700, 2090)),
        "month": f"{rnd.randint(1, 28):02d}",
        "small": str(rnd.randint(0, 999)),
    }


def labelled_table(seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of every labelled sentence."""
    rnd, out = random.Random(seed), []
    for _ in range(REPEATS):
        for line in LABELLED:
            filled = re.sub(r"\{(\w+)\}", lambda m: _values(rnd)[m[1]], line)
            text, spans = "", []
            for part in re.split(r"(\[[a-z]+:[^\]]*\])", filled):
                if m := re.fullmatch(r"\[([a-z]+):([^\]]*)\]", part):
                    spans.append((len(text), len(text) + len(m[2]), m[1]))
                    part = m[2]
                text += part
            out.append((text, spans))
    return out


class _Classes(dict):
    """Class of each character: digit, lower or upper letter, other ASCII as it is, the rest."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "9" if c in "0123456789" else "x" if c.islower() else "X" if c.isupper() else c if c.isascii() else "u"
        return kind


CLASSES = _Classes()


#: Longer class strings are worked out anew each time, so that a remembered one has a bounded size.
REMEMBERED_CHARS = 64
RUNS = re.compile(r"(.)\1+", re.DOTALL)


def _collapsed(classes: str) -> str:
    return RUNS.sub(r"\1", classes)


_collapsed_short = lru_cache(1 << 16)(_collapsed)


def _shape(word: str) -> str:
    """Classes of characters with runs shortened to one."""
    return (_collapsed_short if len(word) <= REMEMBERED_CHARS else _collapsed)(word.translate(CLASSES))


@lru_cache(1 << 16)
def _feature(name: str) -> int:
    return crc32(name.encode()) % FEATURES


def _own(word: str) -> tuple[int, ...]:
    """Hashed features of a word; shapes only, but for a name it is assigned to and short runs of letters before digits."""
    core = word.strip(EDGES)
    is_hex = bool(core) and not core.strip("0123456789abcdef")
    if not SPECIAL.search(word):
        return (_own_short if len(core) <= REMEMBERED_CHARS else _own_of_classes)(core.translate(CLASSES), is_hex)
    digits = sum(map(core.count, "0123456789"))
    return _own_features(
        _shape(core),
        len(core),
        digits,
        "@" in core,
        core.count("."),
        core[:4] if digits and core[:4].isalpha() else "",
        m[0].lower() if (m := ASSIGNED.match(core)) else "",
        is_hex,
        digits > 0 and any(c.isalpha() for c in core),
        word[:1] == "+",
    )


def _own_of_classes(core: str, is_hex: bool) -> tuple[int, ...]:
    """Those of a word that holds none of SPECIAL: its character classes decide."""
    return _own_features(_collapsed(core), len(core), 0, False, core.count("."), "", "", is_hex, False, False)


def _own_features(shape: str, size: int, digits: int, at: bool, dots: int, prefix: str, name: str, is_hex: bool, mixed: bool, plus: bool) -> tuple[int, ...]:
    named = [
        "b",
        "s:" + shape[:6],
        f"n:{min(size, 40) // 4}",
        f"d:{min(digits, 20)}",
        f"all:{digits == size}",
        f"part:{4 * digits // max(1, size)}",
        "@" if at else "no@",
        f"dots:{min(dots, 4)}",
        "p:" + prefix if prefix else "p",
        "a:" + name if name else "a",
        "hex" if is_hex else "nohex",
        f"mix:{mixed}:{min(size, 40) // 8}",
        "+" if plus else "no+",
    ]
    return tuple(_feature(f) for f in named)


_own_short = lru_cache(1 << 16)(_own_of_classes)


def _name(before: str) -> int:
    return crc32(b"l:" + before.strip(EDGES).lower()[-8:].encode()) % FEATURES if len(before) < 12 else _feature("l")


def _left(before: str) -> tuple[int, ...]:
    return _name(before), _feature("ls:" + _shape(before)[:5])


def _right(after: str) -> tuple[int, ...]:
    return (_feature("rs:" + _shape(after)[:5]),)


def _before(words: list[str], at: int) -> str:
    """The word before; a lone equals sign comes with the name before it."""
    if at and words[at - 1] == "=":
        return " ".join(w for w in words[max(0, at - 2) : at] if w)
    return words[at - 1] if at else ""


def _features(words: list[str], at: int) -> list[int]:
    return [*_own(words[at]), *_left(_before(words, at)), *_right(words[at + 1] if at + 1 < len(words) else "")]


class ChainModel:
    """Emission weights by feature and label, and transition scores with label 0 (outside) at both ends of a run."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, runs: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(runs, longest, labels) emission scores, and the length of each run."""
        size = np.array([len(r) for r in runs])
        out = np.zeros((len(runs), int(size.max()), self.emit.shape[1]))
        for k, r in enumerate(runs):
            out[k, : len(r)] = self.emit[np.array(r)].sum(axis=1)
        return out, size

    def viterbi(self, runs: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each run; all runs of a batch advance together."""
        score, size = self.scores(runs)
        n, longest, _ = score.shape
        best = self.move[0] + score[:, 0]
        back = np.zeros(score.shape, dtype=np.int8)
        for t in range(1, longest):
            through = best[:, :, None] + self.move[None]
            back[:, t] = through.argmax(axis=1)
            live = (t < size)[:, None]
            best = np.where(live, through.max(axis=1) + score[:, t], best)
        label = (best + self.move[:, 0]).argmax(axis=1)
        out = np.zeros((n, longest), dtype=np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            here = t < size
            out[here, t] = label[here]
            label = np.where(here & (t > 0), back[rows, t, label], label)
        return [out[k, : size[k]] for k in range(n)]


#: Words that a vocabulary may hold before it is emptied, and words that are scored together.
CACHE_TERMS, CHUNK_WORDS = 1 << 17, 1 << 16


class Vocabulary(dict):
    """Number of each word seen. ``gaps``: by how much label 0 leads each other label through the word's own features, as
    the word before, and as the word after; ``need``: the most that transitions can take from that lead."""

    def __init__(self, model: ChainModel):
        move = model.move
        self.lead = model.emit[:, :1] - model.emit[:, 1:]
        self.need = (move[:, 1:] - move[:, :1]).max(axis=0) + (move[1:] - move[:1]).max(axis=1) + 1e-9
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.gaps = np.zeros((3, 0, self.lead.shape[1]))
        self.kinds: dict[tuple[int, ...], int] = {}
        self.new: list[tuple[int, int, int, int]] = []

    def __missing__(self, word: str) -> int:
        shape = _shape(word)[:5]
        kind = self.kinds.setdefault(_own(word), len(self.kinds))
        self.new.append((kind, _name(word), _feature("ls:" + shape), _feature("rs:" + shape)))
        k = self[word] = len(self)
        return k

    def open_words(self, words: list[str]) -> np.ndarray:
        """Places of words that may have another label than 0 on a best path; the empty word stands between texts.

        Every word is scored. Where label 0 leads by more than any transitions can make up, it is on
        every best path, so that the words between such places can be decoded apart.
        """
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        before = np.roll(ids, 1)
        for k in np.flatnonzero(before == self["="]):
            before[k] = self[_before(words, k)]
        if self.new:
            kind, name, left, right = np.array(self.new).T
            own = self.lead[np.array(list(self.kinds))].sum(axis=1)
            self.gaps = np.concatenate([self.gaps, np.stack([own[kind], self.lead[name] + self.lead[left], self.lead[right]])], axis=1)
            self.new = []
        led = self.gaps[0][ids] + self.gaps[1][before] + self.gaps[2][np.roll(ids, -1)]
        return np.flatnonzero((led <= self.need).any(axis=1) & (ids != self[""]))


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts by number, and their words with an empty one before each text and after the last."""
    held: list[int] = []
    words = [""]
    for k, text in enumerate(texts):
        held.append(k)
        words += WORDS.findall(text)
        words.append("")
        if len(words) >= CHUNK_WORDS:
            yield held, words
            held, words = [], [""]
    if held:
        yield held, words


def _runs(texts: list[str], vocabulary: Vocabulary) -> Iterator[tuple[int, list[tuple[int, int, list[int]]]]]:
    """(number of the text, run) for runs of neighbouring open words: (start, end, features) of each word."""
    for held, words in _chunks(texts):
        if len(vocabulary) >= CACHE_TERMS:
            vocabulary.empty()
        vocabulary[""]
        at = vocabulary.open_words(words)
        if not len(at):
            continue
        edges = [k for k, w in enumerate(words) if not w]
        which, place = -1, []
        run: list[tuple[int, int, list[int]]] = []
        last = -2
        for k in at.tolist():
            if run and k != last + 1:
                yield held[which], run
                run = []
            if which < 0 or k > edges[which + 1]:
                which = bisect_left(edges, k) - 1
                place = [m.span() for m in WORDS.finditer(texts[held[which]])]
            run.append((*place[k - edges[which] - 1], _features(words, k)))
            last = k
        if run:
            yield held[which], run


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> ChainModel:
    """Maximum likelihood by gradient ascent; expected counts come from the forward and backward sums of each run."""
    runs, truth = [], []
    for text, spans in table:
        words = WORDS.findall(text)
        runs.append([_features(words, k) for k in range(len(words))])
        truth.append([next((LABELS.index(k) for s, e, k in spans if s < m.end() and m.start() < e), 0) for m in WORDS.finditer(text)])
    n_labels = len(LABELS)
    model = ChainModel(np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels)))
    size = np.array([len(r) for r in runs])
    longest = int(size.max())
    at = np.array([(k, t) for k, r in enumerate(runs) for t in range(len(r))])
    ids = np.array([f for r in runs for f in r])
    gold = np.array([y for ys in truth for y in ys])
    gold_move = np.zeros((n_labels, n_labels))
    for ys in truth:
        np.add.at(gold_move, ([0, *ys], [*ys, 0]), 1)
    speed = [np.zeros_like(model.emit), np.zeros_like(model.move)]
    for _ in range(steps):
        score, _ = model.scores(runs)
        fore = np.full(score.shape, -np.inf)
        rear = np.full(score.shape, -1e30)
        fore[:, 0] = model.move[0] + score[:, 0]
        for t in range(1, longest):
            fore[:, t] = _log_sum(fore[:, t - 1][:, :, None] + model.move[None], 1) + score[:, t]
        rows = np.arange(len(runs))
        rear[rows, size - 1] = model.move[:, 0]
        for t in range(longest - 2, -1, -1):
            more = _log_sum(model.move[None] + (score[:, t + 1] + rear[:, t + 1])[:, None, :], 2)
            rear[:, t] = np.where((t < size - 1)[:, None], more, rear[:, t])
        total = _log_sum(fore[rows, size - 1] + model.move[:, 0], 1)
        here = np.exp(fore[at[:, 0], at[:, 1]] + rear[at[:, 0], at[:, 1]] - total[at[:, 0], None])
        wrong = -here
        wrong[np.arange(len(gold)), gold] += 1
        up = np.zeros_like(model.emit)
        for j in range(ids.shape[1]):
            np.add.at(up, ids[:, j], wrong)
        move = gold_move.copy()
        move[0] -= np.exp(fore[:, 0] + rear[:, 0] - total[:, None]).sum(axis=0)
        move[:, 0] -= np.exp(fore[rows, size - 1] + model.move[:, 0] - total[:, None]).sum(axis=0)
        for t in range(1, longest):
            live = t < size
            both = fore[live, t - 1][:, :, None] + model.move[None] + (score[live, t] + rear[live, t])[:, None, :]
            move -= np.exp(both - total[live, None, None]).sum(axis=0)
        for w, g, v in ((model.emit, up, speed[0]), (model.move, move, speed[1])):
            g = g / len(runs) - decay * w
            v += g * g
            w += rate * g / (np.sqrt(v) + 1e-8)
    return model


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and then place."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """A labelled stretch without quotes and marks at its ends, nor the name that a secret is assigned to."""
    if kind == "secret" and (m := ASSIGNED.match(text, start, end)) and m.end() < end:
        start = m.end()
    while start < end and text[start] in EDGES:
        start += 1
    while end > start and text[end - 1] in EDGES:
        end -= 1
    return start, end


#: Cells that one batch of runs may fill; longer runs form a batch of their own.
BATCH_CELLS = 1 << 18


def find_spans(texts: list[str], model: ChainModel, vocabulary: Vocabulary | None = None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Per text: base spans, and all spans. The model labels every word and adds spans that touch no base span."""
    base = [base_spans(t) for t in texts]
    runs = list(_runs(texts, Vocabulary(model) if vocabulary is None else vocabulary))
    runs.sort(key=lambda r: len(r[1]))
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(runs):
        stop = at + 1
        while stop < len(runs) and (stop + 1 - at) * len(runs[stop][1]) * len(LABELS) <= BATCH_CELLS:
            stop += 1
        found = model.viterbi([[f for _, _, f in run] for _, run in runs[at:stop]])
        for (k, run), labels in zip(runs[at:stop], found):
            i = 0
            while i < len(run):
                j = i + 1
                if labels[i]:
                    kind = LABELS[labels[i]]
                    while j < len(run) and labels[j] == labels[i] and kind != "secret":
                        j += 1
                    added[k].append((kind, *_trimmed(texts[k], run[i][0], run[j - 1][1], kind)))
                i = j
        at = stop
    out = []
    for own, more in zip(base, added):
        taken = sorted((s, e) for _, s, e in own)
        starts = np.array([s for s, _ in taken])
        ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
        extra = []
        for kind, s, e in more:
            before = int(np.searchsorted(starts, e, side="left")) if taken else 0
            if s < e and (before == 0 or ends[before - 1] <= s):
                extra.append((kind, s, e))
        out.append((own, sorted(own + extra, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_MODEL: list[ChainModel] = []


def default_model() -> ChainModel:
    """Trained once per process from the labelled table; the same wherever it runs."""
    if not _MODEL:
        _MODEL.append(train(labelled_table()))
    return _MODEL[0]


@contextmanager
def _vocabulary(model: ChainModel) -> Iterator[Vocabulary]:
    """What a task remembers of words; forgotten at its end, as the worker goes on to other work."""
    try:
        yield Vocabulary(model)
    finally:
        for remembered in (_collapsed_short, _own_short, _feature):
            remembered.cache_clear()
        CLASSES.clear()
        pa.default_memory_pool().release_unused()


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) of every whole text.

    Counts are of base spans; ``spans`` also holds those that the model adds. Offsets are
    code points, ends exclusive. NULL text is empty and has no spans, NULL ids stay NULL,
    repeated rows are searched each, an empty table gives an empty result, other columns
    are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _vocabulary(model.value) as vocabulary:
            for batch in slices(batches, "text"):
                found = find_spans([t.as_py() or "" for t in batch.column("text")], model.value, vocabulary)
                counts = [pa.array([sum(s[0] == kind for s in own) for own, _ in found], pa.int64()) for kind in BASE]
                digest = [hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found]
                secret = pa.array([sum(s[0] == "secret" for s in every) for _, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([written(e) for _, e in found], pa.string()), secret],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_secret"],
                )

    picked = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return picked.mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string, n_secret bigint")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle brackets; NULL texts stay NULL.

    Overlapping spans are replaced as one, under the kind that starts first.
    """
    model = docs.sparkSession.sparkContext.broadcast(default_model())
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _vocabulary(model.value) as vocabulary:
            for batch in slices(batches, text_col):
                texts = [t.as_py() for t in batch.column(place)]
                out: list[str | None] = []
                for text, (_, spans) in zip(texts, find_spans([t or "" for t in texts], model.value, vocabulary)):
                    if text is None or not spans:
                        out.append(text)
                        continue
                    parts, done = [], 0
                    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if s >= done:
                            parts += [text[done:s], f"<{kind}>"]
                        done = max(done, e)
                    out.append("".join(parts) + text[done:])
                columns = [*batch.columns]
                columns[place] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
