"""Secret scans: candidates by vectorised rules, false positives removed by a random forest.

A candidate is a run of [A-Za-z0-9_+/=.-] of at least ``MIN_LENGTH`` bytes that holds a letter and a digit (every part of an = chain by itself,
edges trimmed of = . -), what is assigned to a key word or quoted after it on the same line: any characters, from ``MIN_VALUE`` bytes
on, up to the closing quote or, without quotes, the next blank; or a private key block (an unclosed one ends with its last line of base64). Candidates that overlap are one span.

A forest scores each by its length, character transitions, dictionary coverage, path (the ``source`` column) and neighbouring words. None of these is a
list of known forms: :class:`Knowledge` learns them first. The dictionary (``DICTIONARY_WORDS`` words in most documents, and the usual words around labelled findings) and the surprise of letter
transitions come from all the documents scanned; the odds of neighbouring words, of path parts and of a candidate's own words, first and
last bytes from one half of the labelled findings. The forest is trained on the other half, on the driver. :func:`labelled_findings` makes a fixed set of
findings by rule (tables at hand have no labelled secrets), and callers may pass their own.

Defined cases: null and empty texts have no candidate; null sources are empty paths; no document at all leaves an empty dictionary; repeated rows come out as often as
they go in; a very long text is scanned whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, map_pieces, pieces, utf8
from .textcore import LOWER

MIN_LENGTH, CONTEXT_BYTES, THRESHOLD = 12, 48, 0.5
MIN_VALUE = 6
N_TREES, DEPTH, N_FINDINGS, SEED = 31, 10, 8000, 11
#: Words of 3 to 12 letters a-z in most documents; and the words that a task counts before it passes its counts on.
DICTIONARY_WORDS, HELD_WORDS = 5000, 200_000
#: Labelled findings of each kind that a word's odds are pulled to even by; words before a candidate that count.
ODDS_PRIOR, NEAR_WORDS = 4.0, 4
#: Labelled findings that a word stands before, for the dictionary to hold it too.
WORD_FINDINGS = 5
MASK = "<SECRET>"
SCHEMA = "doc_id long, n_candidates long, n_secrets long, spans string, max_score double, redacted_sha256 string"

_RUN = np.zeros(256, bool)
for _c in b"_+/=.-":
    _RUN[_c] = True
_DIGIT, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_RUN |= _DIGIT | _ALPHA
_BREAK = rb"(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*)"
_BEGIN = rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: Closed: lines of base64 or headers up to the end marker. Unclosed: lines of 16 or more base64 bytes alone.
_PRIVATE = re.compile(
    _BEGIN + rb"(?:" + _BREAK + rb"|[ \t])*+(?:(?:[A-Za-z0-9-]+: [^\n]*|[A-Za-z0-9+/=]+)" + _BREAK + rb"++)*+[A-Za-z0-9+/=]*+[ \t]*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    rb"|" + _BEGIN + rb"(?:[ \t]*[A-Za-z0-9+/=]{16,})?+(?:" + _BREAK + rb"[A-Za-z0-9+/=]{16,}+(?=[ \t]*(?:\r|\n|\\n|\Z)))*+"
)
_KEY = rb"(?:token|secret|passw|pwd|passphrase|api.?key|access.?key|auth(?!or)|bearer|credential|private.?key|client.?key)[a-z0-9_-]*+"
_ASSIGN = rb"[\"'`]?[ \t]*+(?:(?:=>|:=|==?|:)[ \t]*+(?:(?:bearer|basic|token)[ \t]++)?|(?=[\"'`]))"
#: A key word (taken whole, so that a scan is linear) and its value: quoted, or up to a blank, a quote or the next assignment.
_VALUE = re.compile(_KEY + rb"(?:" + _ASSIGN + rb"(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`|[\"'`]?((?:(?![&,;][ \t]?[a-z0-9_]+[=:])[^\s\"'`])++)))?")
_LETTERS, _PARTS = re.compile(rb"[a-z]+"), re.compile(rb"[a-z]+|[0-9]+")
FEATURES = (
    "length", "transitions", "surprise", "coverage", "entropy", "digits", "upper", "symbols", "distinct", "hex", "dots", "dashes", "underscores", "slashes", "spaces",
    "assigned", "quoted", "nearest", "near", "own", "head", "first", "last", "path",
)
#: Dealt features by kind, for tests and figures of what each kind decides.
KINDS = {
    "length": ("length",), "transitions": ("transitions", "surprise"), "coverage": ("coverage",), "neighbours": ("assigned", "quoted", "nearest", "near"), "path": ("path",),
    "characters": ("entropy", "digits", "upper", "symbols", "distinct", "hex", "dots", "dashes", "underscores", "slashes", "spaces"), "own": ("own", "head", "first", "last"),
}
_CLASS = np.full(256, 3, np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = _HEX[65:71] = True


def near_words(before: bytes) -> list[bytes]:
    """The last words before a candidate, nearest first."""
    return _LETTERS.findall(before.lower())[: -NEAR_WORDS - 1 : -1]


def word_counts(docs: DataFrame) -> list[tuple[bytes, int]]:
    """The DICTIONARY_WORDS words that are in most documents, over all of them; a task counts in a bounded table."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = tc.words(*utf8(piece.column("text")))
                sizes = found.ends - found.starts
                letters = np.concatenate(([0], np.cumsum((found.data >= 97) & (found.data < 123))))
                fit = np.flatnonzero((sizes >= 3) & (sizes <= 12) & (letters[found.ends] - letters[found.starts] == sizes))
                if not len(fit):
                    continue
                codes, live, at = np.zeros(len(fit), np.int64), np.arange(len(fit)), found.starts[fit]
                for i in range(12):  # words as numbers, 5 bits a letter
                    live = live[sizes[fit[live]] > i]
                    codes[live] = codes[live] << 5 | (found.data[at[live] + i] - 96)
                names, which = np.unique(codes, return_inverse=True)
                counts = np.bincount(np.unique(which * piece.num_rows + found.documents()[fit]) // piece.num_rows)
                for code, n in zip(names.tolist(), counts.tolist()):
                    held[code] += n
                if len(held) > HELD_WORDS:
                    yield rows_of(held)
                    held.clear()
        if held:
            yield rows_of(held)

    def rows_of(held: Counter[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.int64()), pa.array(list(held.values()), pa.int64())], ["code", "n"])

    counts = checkpointed(docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    # Sizes of the words' classes by count (a few hundred rows) say how often a word has to be for the list, so that no task or driver sorts them all.
    octave = F.floor(F.log2("n") * 8)
    least, total = 0, 0
    for r in counts.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("octave")).collect():
        least, total = r.octave, total + r.words
        if total >= DICTIONARY_WORDS:
            break
    found = counts.where(octave >= least).orderBy(F.desc("n"), "code").limit(DICTIONARY_WORDS).collect()
    return [(spelt(r.code), r.n) for r in found]


def spelt(code: int) -> bytes:
    out = bytearray()
    while code:
        out.append(96 + (code & 31))
        code >>= 5
    return bytes(out[::-1])


class Knowledge:
    """What the features read: dictionary and letter transitions of the documents, and odds of words of labelled findings."""

    def __init__(self, words: Sequence[tuple[bytes, int]], findings: Sequence[tuple[bytes, bytes, bytes, bytes, int]]):
        around = Counter(w for r in findings for w in set(_LETTERS.findall(r[1].lower())) if 3 <= len(w) <= 12)
        self.words = frozenset([*(w for w, _ in words), *(w for w, n in around.items() if n >= WORD_FINDINGS)])
        pairs = np.full((26, 26), 0.5)
        for w, n in words:
            for a, b in zip(w, w[1:]):
                pairs[a - 97, b - 97] += n
        self.surprise = -np.log2(pairs / pairs.sum(axis=1, keepdims=True)) if words else np.full((26, 26), math.log2(26))
        seen: dict[str, dict[bytes, list[int]]] = {}
        for found, before, _, path, secret in findings:
            for kind, names in self.names(found, before, path).items():
                for name in set(names):
                    seen.setdefault(kind, {}).setdefault(name, [0, 0])[secret] += 1
        share = lambda n: math.log((n[1] + ODDS_PRIOR / 2) / (n[0] + ODDS_PRIOR / 2))
        self.odds = {kind: {name: share(n) for name, n in rows.items() if sum(n) > 1} for kind, rows in seen.items()}

    @staticmethod
    def names(found: bytes, before: bytes, path: bytes) -> dict[str, list[bytes]]:
        return {"near": near_words(before), "own": _LETTERS.findall(found.lower()), "head": [found[:3]], "first": [found[:1]], "last": [found[-1:]], "path": _PARTS.findall(path.lower())}

    def sum_of(self, kind: str, names: Iterable[bytes]) -> float:
        odds = self.odds.get(kind, {})
        return sum(odds.get(x, 0.0) for x in names)

    def covered(self, low: bytes) -> int:
        """Letters in dictionary words, taken longest first from the left of each run of letters."""
        total = 0
        for run in _LETTERS.findall(low):
            i = 0
            while i + 3 <= len(run):
                n = next((n for n in range(min(12, len(run) - i), 2, -1) if run[i : i + n] in self.words), 0)
                total += n
                i += n or 1
        return total

    def describe(self, found: bytes, before: bytes, after: bytes, path: bytes) -> list[float]:
        """The features of one candidate, in the order of FEATURES."""
        n, data = len(found), np.frombuffer(found, np.uint8)
        kinds = _CLASS[data]
        low = found.lower()
        small = np.frombuffer(low, np.uint8).astype(np.int64) - 97
        letter = (small >= 0) & (small < 26)
        both = np.flatnonzero(letter[:-1] & letter[1:])
        counts = np.bincount(data)
        share = counts[counts > 0] / n
        names = self.names(found, before, path)
        near = [self.sum_of("near", [w]) for w in names["near"]]
        return [
            math.log2(n), float((kinds[1:] != kinds[:-1]).sum()) / max(n - 1, 1), float(self.surprise[small[both], small[both + 1]].mean()) if len(both) else 0.0, self.covered(low) / n,
            float(-(share * np.log2(share)).sum()), float((kinds == 0).mean()), float((kinds == 1).mean()), float((kinds == 3).mean()), len(share) / n, float(_HEX[data].mean()),
            found.count(b".") / n, found.count(b"-") / n, found.count(b"_") / n, found.count(b"/") / n, found.count(b" ") / n,
            before.rstrip(b" \t\"'`")[-1:] in (b"=", b":"), before[-1:] in (b'"', b"'", b"`") and after[:1] in (b'"', b"'", b"`"), near[0] if near else 0.0, sum(near),
            self.sum_of("own", set(names["own"])), self.sum_of("head", names["head"]), self.sum_of("first", names["first"]), self.sum_of("last", names["last"]), self.sum_of("path", set(names["path"])),
        ]


def candidates(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) of every candidate, in order; places count from the start of all the data."""
    return sorted({*run_candidates(data, bounds), *value_candidates(data, bounds), *block_candidates(data, bounds)})


def block_candidates(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Private key blocks."""
    whole = data.tobytes()
    if b"PRIVATE KEY-----" not in whole:
        return []
    return [(d, *m.span()) for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) for m in _PRIVATE.finditer(whole, a, b)]


def value_candidates(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """What is assigned to a key word, or quoted after it."""
    low, out = LOWER[data].tobytes(), []
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for m in _VALUE.finditer(low, a, b):
            if m.lastindex is None:
                continue
            s, e = m.span(m.lastindex)
            if m.lastindex == 4:  # without quotes: closing punctuation is the text's
                e = s + len(low[s:e].rstrip(b".,;:)]}>"))
            if e - s >= MIN_VALUE:
                out.append((d, s, e))
    return out


def run_candidates(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Long runs with a letter and a digit."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _RUN[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = ends - starts >= MIN_LENGTH
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    holds = lambda which: np.add.reduceat(np.append(which[data], False).astype(np.int32), np.stack((starts, ends), 1).ravel())[::2] > 0
    both = holds(_DIGIT) & holds(_ALPHA)
    out = []
    for s, e in zip(starts[both].tolist(), ends[both].tolist()):
        d = int(np.searchsorted(bounds, s, side="right")) - 1
        run = data[s:e].tobytes()
        body = run.rstrip(b"=")
        parts = body.split(b"=")
        for i, part in enumerate(parts):  # name=value=...
            padded = part + run[len(body) :] if i == len(parts) - 1 else part
            left = len(padded) - len(padded.lstrip(b"=.-"))
            core = padded.lstrip(b"=.-").rstrip(b".-")
            if len(core) >= MIN_LENGTH:
                out.append((d, s + left, s + left + len(core)))
            s += len(part) + 1
    return out


class Forest:
    """Binary trees in flat arrays: feature, threshold, left, right and the share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = N_TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(nodes, x[rows], y[rows], depth, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, nodes: list[list[float]], x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        me = len(nodes)
        nodes.append([0, 0, me, me, y.mean()])
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return me
        best = (y.mean() * (1 - y.mean()) - 1e-9, None, None)
        for f in rng.permutation(x.shape[1])[: int(math.sqrt(x.shape[1])) + 1]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n = cut + 1.0
            left, right = ones[cut] / n, (ones[-1] - ones[cut]) / (len(y) - n)
            impurity = (n * left * (1 - left) + (len(y) - n) * right * (1 - right)) / len(y)
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = (impurity[k], f, v[cut[k]])
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = self._grow(nodes, x[low], y[low], depth - 1, rng)
            nodes[me][3] = self._grow(nodes, x[~low], y[~low], depth - 1, rng)
        return me

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                low = x[rows, tree[at, 0].astype(np.int64)] <= tree[at, 1]
                at = np.where(low, tree[at, 2], tree[at, 3]).astype(np.int64)
            total += tree[at, 4]
        return np.round(total / len(self.trees), 9)


#: Words that labelled findings are made of; no feature reads them.
_NOUNS = (
    "account admin agent archive asset author backup board branch browser build button cache calendar card channel chart client cloud code column command comment commit company config content "
    "context counter customer data date debug default deploy design detail device document domain driver editor email engine entry error event export factory feature field file filter folder "
    "font form frame gateway global group handler header height host image index input invoice item key label language layout level library line link list location login machine main manager "
    "map master media member menu message method model module monitor name network node number object option order output package page panel parent partner path person phone plugin policy port "
    "post price print process product profile program project property proxy query queue record release report request resource response result role route rule schema screen script search "
    "section select sequence server service session setting shop size source stage state storage store stream string style summary support system table target task team template text theme "
    "thread ticket time title tool tracking transfer type unit update upload user value version video view web widget window word work"
).split()
_SYLLABLES = "th er on an re st in ou ea de la ch ment ing tion com pre ver al ist ous ly en ness un ble".split()


def labelled_findings(n: int = N_FINDINGS, seed: int = SEED) -> list[tuple[bytes, bytes, bytes, bytes, int]]:
    """(found, before, after, path, is a secret) by rule: half of them secrets."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, alnum, marks = digits + "abcdef", upper + lower + digits, "!@#$%^&*?+~"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(_NOUNS)
    made = lambda k: "".join(rng.choice(_SYLLABLES) for _ in range(k))
    prose = lambda: " ".join(made(rng.randint(1, 3)) if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 6)))
    keys = ("token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "TOKEN", "passwd", "db_password", "private_key", "passphrase", "pwd", "credentials", "secretKey")
    told = ("commit", "sha1", "sha256", "md5", "checksum", "etag", "revision", "integrity", "digest", "uuid", "build", "id", "file", "url", "version", "hash", "rev", "parent", "tree", "blob", "trace_id", "request-id", "ref", "see", "at")
    said = ("enter", "your", "please", "invalid", "missing", "the", "is required", "must be set", "for", "expired", "forgot", "a new")
    leet = lambda x: "".join({"a": "@", "o": "0", "s": "$", "i": "!", "e": "3"}.get(c, c) if rng.random() < 0.7 else c for c in x) + draw(digits, 1)
    named = lambda: rng.choice(("token", "password", "secret", "api_key", word()))
    block = lambda name, lines: f"-----BEGIN {name}-----\n" + "\n".join(lines) + f"\n-----END {name}-----"
    anyhex = lambda: draw(hexes, rng.choice((32, 40, 40, 40, 64)))
    base64 = lambda k: draw(alnum + "+/", k) + rng.choice(("", "=", "=="))
    forms = (  # secrets that need no key word
        lambda: "AKIA" + draw(upper + digits, 16), lambda: rng.choice(("ghp_", "gho_", "ghs_")) + draw(alnum, 36), lambda: f"xoxb-{draw(digits, 11)}-{draw(alnum, 24)}", lambda: "sk-" + draw(alnum, 40), lambda: "AIza" + draw(alnum + "_-", 35),
        lambda: f"eyJ{draw(alnum, 20)}.eyJ{draw(alnum, 40)}.{draw(alnum + '_-', 43)}", lambda: block(rng.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY")), [draw(alnum + "+/", 64) for _ in range(rng.randint(0, 8))] + [base64(rng.randint(6, 60))]),
    )
    strong = (
        lambda: anyhex(), lambda: anyhex(), lambda: anyhex(), lambda: draw(alnum, rng.randint(16, 48)), lambda: draw(alnum, rng.randint(16, 48)), lambda: base64(rng.randint(20, 64)), lambda: made(rng.randint(2, 4)) + draw(digits, rng.randint(1, 4)) + draw(lower + upper, rng.randint(1, 4)),
        lambda: leet(named().title()) + rng.choice(marks) + (leet(word()) if rng.random() < 0.5 else named().title()) + draw(digits, rng.randint(0, 2)), lambda: word().title()[:8] + rng.choice(marks) + draw(digits, rng.randint(1, 4)) + rng.choice(marks) + word(),
        lambda: rng.choice(marks).join(draw(alnum, rng.randint(2, 6)) for _ in range(rng.randint(2, 4))).ljust(7, "7"), lambda: draw(rng.choice((lower + upper, lower, upper)), rng.randint(10, 40)), lambda: draw(alnum, rng.randint(7, 11)),
    )
    phrases = (lambda: rng.choice((" ", "-")).join(made(rng.randint(2, 3)) for _ in range(rng.randint(3, 6))), lambda: " ".join(word() for _ in range(rng.randint(4, 6))), lambda: made(rng.randint(3, 6)), lambda: "ä".join(made(2) for _ in range(2)) + draw(marks + digits, 3))
    no_value = (  # what stands at a key word and is none
        lambda: "${" + named() + "}", lambda: "${" + (word() + "_" + named()).upper() + "}", lambda: "$" + named() + "_" + word(), lambda: "<" + named() + ">", lambda: "<SECRET>", lambda: "{{ " + named() + " }}", lambda: "%" + named() + "%", lambda: rng.choice("*.x#-") * rng.randint(6, 20),
        lambda: rng.choice(("process.env.", "config.", "self.", "settings.")) + rng.choice((named(), "auth_" + named())), lambda: rng.choice(("getenv(", "os.environ[", "get_" + word() + "(")) + named(), lambda: "get" + word().title() + named().title() + "()",
        lambda: rng.choice(("undefined", "required", "optional", "string", "changeme", "your_" + named(), "null,", "None", "example", "placeholder", "redacted")).ljust(6, "."), lambda: word() + rng.choice("_-.") + named(), lambda: word().ljust(6, "s"), lambda: "your_" + named() + "_" + word() + "_" + str(rng.randint(1, 999)),
    )
    sayings = (*[lambda: " ".join(rng.sample((rng.choice(said), rng.choice(said), named(), word()), rng.randint(3, 4)))] * 3, lambda: word() + " " + named())
    no_secret = (  # long runs that are none
        lambda: anyhex(), lambda: anyhex(), lambda: anyhex(), lambda: "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: "_".join(word() for _ in range(rng.randint(2, 5))) + str(rng.randint(1, 99)), lambda: f"{word()}.{word()}{rng.randint(0, 9)}.{word()}",
        lambda: f"{word()}/{word()}-{rng.randint(1, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}/{word()}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}-{word()}", lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10",
        lambda: "".join(word().title() for _ in range(3)) + str(rng.randint(1, 2000)), lambda: draw(digits, 3) + made(rng.randint(4, 7)), lambda: "EXAMPLE" + draw(alnum, 4) + "1234567", lambda: "your_" + word() + "_key_123", lambda: f"www.{made(2)}{rng.randint(0, 99)}.com/{word()}/{rng.randint(1, 9999)}",
    )
    out = []
    for i in range(n):
        secret, kind, quote, lead = i % 2, rng.random(), "", prose()
        if secret and kind < 0.25:
            found, lead = rng.choice(forms)(), lead + rng.choice((" ", " = ", ": ", "=", " " + rng.choice(keys) + " = ", " " + word() + ": "))
            quote = rng.choice(('"', "'", "", "")) if lead[-1:] in " =" else ""
        elif secret:
            bare = rng.random() < 0.35
            found = rng.choice(strong if bare else strong + phrases)()
            quote, name = "" if bare else rng.choice(('"', '"', "'")), rng.choice(keys)
            lead += " " + ("Authorization: Bearer " if bare and rng.random() < 0.15 else name + rng.choice((" = ", "=", ": ", ":", " = ", *(() if bare else (" ",)))))
        elif kind < 0.45:
            bare = rng.random() < 0.4
            found = rng.choice(no_value if bare else no_value + sayings)()
            quote = "" if bare else rng.choice(('"', '"', "'"))
            lead += " " + rng.choice(keys) + rng.choice((" = ", "=", ": ", ":"))
        elif kind < 0.52:  # images and other data
            found, lead = base64(rng.choice((40, 80, 200, 600))), lead + rng.choice((' src="data:image/png;base64,', " url(data:font/woff;base64,", ' "integrity": "sha512-', " -----BEGIN CERTIFICATE----- ", " ssh-rsa "))
        else:
            found, quote = rng.choice(no_secret)(), rng.choice(("", "", '"'))
            lead += " " + (rng.choice(told) if rng.random() < 0.75 else prose()) + rng.choice((" ", ": ", "=", "-", " ", " = ")) + quote
        before = lead + (quote if not lead.endswith(quote or " ") or not quote else "")
        if rng.random() < 0.15 and "-----" not in found and secret == 0:
            found, before = found.upper(), before.upper()
        elif rng.random() < 0.1 and "-----" not in found:
            before = before.upper()
        path = rng.choice((f"src{rng.randint(0, 49)}", "", rng.choice(("app/config.yml", ".env", "settings.ini", "main.tf", "deploy/values.yaml") if rng.random() < (0.7 if secret else 0.3) else ("docs/a.md", "yarn.lock", "go.sum", "test/fixture.json", "src/app.py"))))
        out.append((found.encode(), before.encode()[-CONTEXT_BYTES:], (quote + rng.choice((" ", "###", "!!", ".", "\n"))).encode(), path.encode(), secret))
    return out


class Model:
    """What was learnt, and the forest over its features."""

    def __init__(self, words: Sequence[tuple[bytes, int]], findings: Sequence[tuple[bytes, bytes, bytes, bytes, int]] | None = None, without: Sequence[str] = ()):
        rows = labelled_findings() if findings is None else findings
        self.known = Knowledge(words, [r for i, r in enumerate(rows) if i // 2 % 2])  # pairs, as classes may alternate
        rest = [r for i, r in enumerate(rows) if not i // 2 % 2]
        self.off = [FEATURES.index(f) for f in without]
        self.forest = Forest(self.features(rest), np.array([r[4] for r in rest], float))

    def features(self, rows: Sequence[tuple]) -> np.ndarray:
        x = np.array([self.known.describe(*r[:4]) for r in rows], float).reshape(len(rows), len(FEATURES))
        x[:, self.off] = 0.0
        return x

    def scores(self, rows: Sequence[tuple]) -> np.ndarray:
        return self.forest.scores(self.features(rows))


def trained(docs: DataFrame, findings: Sequence | None = None) -> Model:
    return Model(word_counts(docs), findings)


def scan(data: np.ndarray, bounds: np.ndarray, paths: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Of each document the number of candidates, the highest score and the spans (in its bytes) of its secrets."""
    found = candidates(data, bounds)
    rows = []
    for d, s, e in found:
        low, high = int(bounds[d]), int(bounds[d + 1])
        rows.append((data[s:e].tobytes(), data[max(low, s - CONTEXT_BYTES) : s].tobytes(), data[e : min(high, e + 8)].tobytes(), (paths[d] or "").encode()))
    score = model.scores(rows)
    owner = np.array([f[0] for f in found], np.int64)
    n = np.bincount(owner, minlength=len(paths)) if len(paths) else np.zeros(0, np.int64)
    best = np.zeros(len(paths))
    np.maximum.at(best, owner, score)
    spans: list[list[tuple[int, int]]] = [[] for _ in paths]
    for (d, s, e), p in zip(found, score.tolist()):
        if p >= THRESHOLD:
            spans[d].append((s - int(bounds[d]), e - int(bounds[d])))
    return n, best, [united(x) for x in spans]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, last = [], 0
    for s, e in spans:
        parts += [text[last:s], MASK.encode()]
        last = e
    return b"".join([*parts, text[last:]])


def secret_scan(docs: DataFrame, findings: Sequence | None = None) -> DataFrame:
    """One row per input row: counts, secret spans (byte offsets, "start-end,..."), the highest score, and the redacted text's digest."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, findings))

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = utf8(piece.column("text"))
        n, best, spans = scan(data, bounds, piece.column("source").to_pylist(), model.value)
        digests = [hashlib.sha256(redact(data[a:b].tobytes(), s)).hexdigest() for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spans)]
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                pa.array([",".join(f"{a}-{b}" for a, b in s) for s in spans], pa.string()), pa.array(best), pa.array(digests, pa.string()),
            ],
            ["doc_id", "n_candidates", "n_secrets", "spans", "max_score", "redacted_sha256"],
        )

    return map_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")), "text", step, SCHEMA)


def redacted(docs: DataFrame, findings: Sequence | None = None) -> DataFrame:
    """``docs`` with every secret masked and n_chars set anew; all rows and columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, findings))
    names = docs.columns

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = utf8(piece.column("text"))
        paths = piece.column("source").to_pylist() if "source" in names else [None] * piece.num_rows
        _, _, spans = scan(data, bounds, paths, model.value)
        if not any(spans):
            return piece
        cols = [piece.column(c) for c in names]
        texts = cols[names.index("text")].to_pylist()
        sizes = cols[names.index("n_chars")].to_pylist() if "n_chars" in names else None
        for d, s in enumerate(spans):
            if s:
                texts[d] = redact(texts[d].encode(), s).decode()
                if sizes and sizes[d] is not None:
                    sizes[d] = len(texts[d])
        cols[names.index("text")] = pa.array(texts, cols[names.index("text")].type)
        if sizes:
            cols[names.index("n_chars")] = pa.array(sizes, cols[names.index("n_chars")].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return map_pieces(docs, "text", step, docs.schema)
