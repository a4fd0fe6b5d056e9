"""Secret scans: candidates by pattern, false positives removed by a random
forest.

Patterns propose candidates: values of assignments to credential-like names,
private-key blocks and long unbroken tokens. Features of a candidate are its
length and make-up, its character transitions under a model of ordinary words,
how much of it dictionary words cover, its path and its neighbouring words. The
dictionary and the ordinary words are the most frequent words of all documents,
counted in Spark, and the fixed ones below. The forest is trained in numpy on
labelled findings: those given, or the ones that ``labelled_findings`` makes from
rules (random keys in their usual places against placeholders, words, names,
paths, ids and checksums).

Every candidate is scored, over its whole value, before overlaps are looked at;
accepted candidates that overlap make one finding from the first start to the
last end, with kind and score of the best, the longer and then the first of
equal ones. So a rejected candidate hides nothing.

Defined cases: null, empty and candidate-less texts have no findings. A key
block (PEM, OpenPGP or SSH2) is taken from its BEGIN to its END marker, whatever
lies between; one without END ends with its last key line, and is no finding if
it has none. Nothing else is looked for inside of key blocks. Texts are scanned
whole. Repeated rows get a row each. A null path is an empty one. Only doc_id,
text and the path column are read; ``redact`` keeps all columns.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CONTEXT = 60
CORPUS_WORDS = 4000  # by frequency: a stated bound for the driver and the broadcast

_NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|signature)"
# Key blocks: their markers, and what the lines of one without an end are made of. Line ends and signs may be escaped as in JSON.
_MARKER = re.compile(r"-----(BEGIN|END) (?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?-----|---- (BEGIN|END) SSH2 (?:[A-Z]++ )*?PRIVATE KEY ----")
_NEWLINE = r"(?:\r?\n|\r|(?:\\++r)?\\++n|\\++r|\\++u000[aAdD])"
_SIGN = r"(?:[A-Za-z0-9+/=]|\\++/|\\++u00(?:2[bBfF]|3[dD]))"
_PIECES = rf"(?:{_SIGN}{{16,}}+[ \t]++)*+"
_LINE_END = rf"[ \t\"',;+]*+(?={_NEWLINE}|\Z)"
_LINE_START = rf"(?:{_NEWLINE}[ \t>|#*\"'-]*+)?+[ \t]*+"
_HEADER_LINE = re.compile(rf"{_LINE_START}[A-Za-z][A-Za-z0-9-]*+:[ \t](?:[^\\\r\n]++|(?!{_NEWLINE})\\++)*+")
_KEY_LINE = re.compile(rf"{_LINE_START}(?P<key>{_PIECES}{_SIGN}*+){_LINE_END}")
_KEY_PIECE = re.compile(rf"{_LINE_START}(?P<key>{_SIGN}{{16,}}+(?:[ \t]++{_SIGN}{{16,}}+)*+)")
# the kinds of candidates that patterns find, with what a text must hold (lower-cased) to be searched for them
PATTERNS = [
    (
        "assignment",
        ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential", "signature"),
        re.compile(rf"(?i:{_NAME}[a-z0-9_-]{{0,64}})[\"']?\s*+(?::=|=>|[:=])\s*+(?:\"([^\"\r\n]{{6,}})\"|'([^'\r\n]{{6,}})'|[\"']?([^\s\"'`,;<>]{{6,}}))"),
    ),
    ("url", ("://",), re.compile(r"://[^\s/:@\"'<>]{0,256}:([^\s/@\"'<>]{4,256})@")),
    ("bearer", ("bearer", "basic"), re.compile(r"(?i:\bbearer|\bbasic)\s+([A-Za-z0-9+/_.=-]{12,})")),
]
LONG = 16
_UNBROKEN = np.zeros(256, bool)
for _c in (string.ascii_letters + string.digits + "+/_-").encode():
    _UNBROKEN[_c] = True

# Words that ordinary names, placeholders and prose are made of.
DICTIONARY = """
about access account action address admin after agent alpha and another api apple application array auth author base
before beta blue body book build bytes cache call change check class client cloud code color config connection content
count create current data database date default delete demo description dev digest document domain dummy element email
empty entry error event example false field file final first folder form format from function green group handler hash
header hello home host house http https image index info input insert internal item java json key label language last
length level library line link list load local login long main manager master message method model module name network
new node none note null number object open option order output owner package page param password path person phone
place placeholder plugin point port post print process product project property public query queue random read record
release remove report request response result return river root row run sample save schema script search secret section
select server service session settings shared signature size source staging start state static status storage string
style system table target task template test text the thing this time title token tree true type update upload uri
url user username utils value version view water web window with word work world write year your
""".split()

_PATHS = {"test": ("test", "spec", "mock", "fixture"), "example": ("example", "sample", "demo", "doc", "readme", "tutorial"), "generated": ("lock", "sum", "dist", "vendor", "node_modules", "min."), "config": ("config", "settings", ".env", "credential", "deploy", "secret")}
_NEIGHBOURS = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential"),
    "digest": ("commit", "sha", "md5", "checksum", "digest", "hash", "etag", "revision", "integrity", "blob"),
    "example": ("example", "sample", "dummy", "placeholder", "your", "changeme", "fake", "insert", "todo"),
    "id": ("uuid", "guid", "id", "trace", "span", "request", "session", "isbn", "version", "order"),
    "link": ("http", "https", "www", "href", "src", "url", "path", "file", "import"),
}
_VOWELS = frozenset("aeiouyäöüáéíóúàèêç")


def by_start(words: list[str]) -> dict[str, list[str]]:
    """Words of three letters or more by their first three, longest first."""
    out: dict[str, list[str]] = {}
    for w in sorted({w for w in words if len(w) >= 3}, key=lambda w: (-len(w), w)):
        out.setdefault(w[:3], []).append(w)
    return out


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS, sample: int | None = None) -> list[str]:
    """The most frequent words (three letters or more, lower-case) of all texts, or
    of a sample of them where one is asked for: those drawn by a hash of their id so
    that ``sample`` are expected, all if there are fewer. Texts stay where they are;
    words are counted before they are shuffled."""
    if sample is not None:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < F.lit(float(sample) / max(docs.count(), sample, 1) * (1 << 30))
        docs = docs.where(draw)
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(3, 30))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def coverage(value: str, by: dict[str, list[str]]) -> float:
    """Share of the letters that lie in dictionary words, longest word first."""
    low, at, hit = value.lower(), 0, 0
    letters = sum(c.isalpha() for c in low)
    while at < len(low) - 2:
        w = next((w for w in by.get(low[at : at + 3], ()) if low.startswith(w, at)), None)
        hit += len(w) if w else 0
        at += len(w) if w else 1
    return hit / letters if letters else 0.0


def _cells(value: str) -> np.ndarray:
    """Letters 0-25, digits 26, other letters 27, signs 28."""
    code = np.frombuffer(value.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, which = np.unique(code, return_inverse=True)
    return np.array([c - 97 if 97 <= c <= 122 else 26 if chr(c).isdigit() else 27 if chr(c).isalpha() else 28 for c in kinds.tolist()], np.int64)[which]


def transitions(values: list[str]) -> np.ndarray:
    """Log-probabilities of one character class after another, add-one."""
    counts = np.ones((29, 29))
    for v in values:
        c = _cells(v)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


NAMES = ["length", "log_length", "digits", "upper", "signs", "entropy", "distinct", "hex", "class_changes", "longest_run", "vowels", "transition", "worst_transition", "dictionary", "assigned", "quoted", *[f"path_{k}" for k in _PATHS], *[f"near_{k}" for k in _NEIGHBOURS], "own_secret", "own_example"]


def features(value: str, before: str, after: str, path: str, table: np.ndarray, words: dict[str, list[str]]) -> list[float]:
    n = len(value)
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    signs, which, times = np.unique(code, return_inverse=True, return_counts=True)
    kind_of = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in map(chr, signs.tolist())]
    kinds = np.array(kind_of)[which]
    number = np.bincount(kinds, minlength=4)
    share = times / n
    turns = np.flatnonzero(np.diff(code) != 0)
    best = int(np.diff(np.concatenate(([-1], turns, [n - 1]))).max())
    letters = int(number[1] + number[2])
    cells = _cells(value)
    steps = table[cells[:-1], cells[1:]] if len(cells) > 1 else np.zeros(1)
    worst = max(1, n // 4)
    low_before, low_after, low_path, low = before.lower(), after.lower(), path.lower(), value.lower()
    near = set(re.findall(r"[a-z]+[0-9]*", low_before[-CONTEXT:] + " " + low_after[: CONTEXT // 3]))
    stems = near | {w.rstrip("0123456789") for w in near}
    vowels = sum(int(t) for c, t in zip(map(chr, signs.tolist()), times, strict=True) if c.lower() in _VOWELS)
    return [
        float(n),
        math.log(n),
        number[0] / n,
        number[1] / n,
        number[3] / n,
        float(-(share * np.log2(share)).sum()),
        len(signs) / n,
        float(all(c in string.hexdigits for c in map(chr, signs.tolist()))),
        int((np.diff(kinds) != 0).sum()) / n,
        best / n,
        vowels / letters if letters else 0.0,
        float(steps.mean()),
        float(np.sort(steps)[:worst].mean()),
        coverage(value, words),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"')),
        *[float(any(p in low_path for p in ps)) for ps in _PATHS.values()],
        *[float(any(w in stems for w in ws)) for ws in _NEIGHBOURS.values()],
        float(any(w in low for w in ("token", "secret", "passw", "key"))),
        float(any(w in low for w in ("example", "your", "change", "xxx", "todo", "dummy", "sample", "placeholder", "..."))),
    ]


@dataclass
class Finding:
    value: str
    before: str
    after: str
    path: str
    label: int


def labelled_findings(n: int = 3000, seed: int = 5) -> list[Finding]:
    """Labelled findings by rule, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(np.array(list(alphabet))[rng.integers(len(alphabet), size=k)])
    syllables = ["the", "ing", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "sch", "lich", "ung", "keit", "ción", "que", "ment", "eau", "tion", "éa", "ver", "ge", "do", "osa"]
    prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))
    word = lambda: pick(DICTIONARY)
    good_paths = ["src/app/main.py", "config/settings.yml", ".env", "deploy/prod.env", "server/index.js", "notes.txt", "", "", ""]
    bad_paths = ["tests/test_auth.py", "docs/readme.md", "examples/demo.py", "package-lock.json", "go.sum", "vendor/lib.js", "src/app/main.py", "notes.txt", "", "", ""]
    out = []
    for k in range(n):
        if k % 2:
            kind = int(rng.integers(7))
            if kind <= 1:
                value = chars("0123456789abcdef", pick([32, 40, 40, 48, 64]))
            elif kind == 2:
                value = chars(string.ascii_letters + string.digits, int(rng.integers(20, 65)))
            elif kind == 3:
                value = chars(string.ascii_letters + string.digits + "+/", int(rng.integers(24, 88))) + pick(["", "=", "=="])
            elif kind == 4:
                value = pick(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + "234567", 16)
            elif kind == 5:
                value = pick(["ghp_", "xoxb-", "sk_live_", "glpat-"]) + chars(string.ascii_letters + string.digits, int(rng.integers(20, 40)))
            else:
                value = chars(string.ascii_letters + string.digits + "!@#%^*()-_", int(rng.integers(10, 24)))
            if rng.random() < 0.1:
                value = value.upper()
            name = pick(["token", "TOKEN", "api_key", "apiKey", "secret", "client_secret", "password", "passwd", "auth", "access_key", "AWS_SECRET_ACCESS_KEY", "private_key", "credential"])
            form = pick([f'{name} = "', f"{name}='", f"{name}: ", f"{name}=", f'"{name}": "', f"{name} := ", "Authorization: Bearer "])
            out.append(Finding(value, prose(int(rng.integers(0, 8))) + " " + form, pick(['"', "'", " ", "\n"]) + prose(3), pick(good_paths), 1))
            continue
        kind, form = int(rng.integers(9)), ""
        if kind == 0:
            value = pick(["your", "my", "insert", "example", "sample", "dummy"]) + pick(["_", "-", ""]) + word() + pick(["_", "-", ""]) + pick(["here", "token", "key", "value", "secret"])
        elif kind == 1:
            value = pick(["x", "X", "*", "0", ".", "-", "abc", "123"]) * int(rng.integers(6, 24))
        elif kind == 2:
            value = "".join(pick(syllables) for _ in range(int(rng.integers(4, 12))))
        elif kind == 3:
            value = pick(["_", "-", "."]).join(word() for _ in range(int(rng.integers(2, 6)))) + pick(["", str(int(rng.integers(100)))])
        elif kind == 4:
            value = "".join(word().capitalize() for _ in range(int(rng.integers(2, 6)))) + pick(["", str(int(rng.integers(1000)))])
        elif kind == 5:
            value, form = "/".join(word() for _ in range(int(rng.integers(2, 6)))) + str(int(rng.integers(1000))), pick(["path: ", "href=", "import ", "file "])
        elif kind == 6:
            value, form = chars("0123456789abcdef", pick([32, 40, 64])), pick(["commit ", "sha256: ", "md5=", "checksum: ", "integrity sha512-", "etag: ", "revision "])
        elif kind == 7:
            h = chars("0123456789abcdef", 32)
            value, form = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", pick(["uuid: ", "id=", "request id ", "trace ", ""])
        else:
            value, form = chars("0123456789", int(rng.integers(6, 30))), pick(["", "order ", "isbn ", "id: ", "version "])
        if not form:
            form = pick(["", "", 'token = "', "key: ", "password=", "secret: ", 'name = "', "value: "]) if kind <= 4 else ""
        if kind in (2, 3, 4) and rng.random() < 0.5:
            form = ""
        out.append(Finding(value, prose(int(rng.integers(0, 8))) + " " + form, pick(['"', "'", " ", "\n"]) + prose(3), pick(bad_paths), 0))
    return out


@dataclass
class Forest:
    """Trees as flat arrays; a leaf has feature -1 and its own number as both
    children."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    table: np.ndarray
    words: dict[str, list[str]]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(x[row, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
        return self.value[at].mean(1)


def train(findings: list[Finding], ordinary: list[str] = DICTIONARY, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 3) -> Forest | None:
    """A forest over findings, None where they are of one class. ``ordinary``:
    the words of which coverage and transitions are taken."""
    y = np.array([f.label for f in findings], float)
    if len(set(y.tolist())) < 2:
        return None
    table, words = transitions([*ordinary, *(f.value for f in findings if not f.label and not any(c.isdigit() for c in f.value))]), by_start(ordinary)
    x = np.array([features(f.value, f.before, f.after, f.path, table, words) for f in findings])
    rng = np.random.default_rng(seed)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        me, p = len(feature), float(y[rows].mean())
        for column, v in ((feature, -1), (cut, 0.0), (left, me), (right, me), (value, p)):
            column.append(v)
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return me
        best = (2 * p * (1 - p) * len(rows) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)) + 1, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(order) + 1)
            ok = np.flatnonzero(v[:-1] < v[1:])
            ok = ok[(n[ok] >= least) & (len(order) - n[ok] >= least)]
            if len(ok):
                a, b = ones[ok], ones[-1] - ones[ok]
                na, nb = n[ok], len(order) - n[ok]
                loss = 2 * (a * (na - a) / na + b * (nb - b) / nb)
                k = int(loss.argmin())
                if loss[k] < best[0]:
                    best = (float(loss[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] is None:
            return me
        feature[me], cut[me] = best[1], best[2]
        low = x[rows, best[1]] <= best[2]
        left[me] = grow(rows[low], level + 1)
        right[me] = grow(rows[~low], level + 1)
        return me

    for _ in range(trees):
        roots.append(grow(rng.integers(len(y), size=len(y)), 0))
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), depth, table, words)


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    """Without a corpus: the fixed words only."""
    return train(labelled_findings())


def forest_for(docs: DataFrame, findings: list[Finding] | None = None) -> Forest:
    """Trained on the findings with the words of the documents."""
    return train(findings or labelled_findings(), sorted({*DICTIONARY, *corpus_words(docs)})) or default_forest()


def long_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of unbroken runs of LONG or more characters that are no plain word:
    with a digit, or an upper-case letter after a lower-case one."""
    data = text.encode("utf-8", "surrogatepass")
    start, end = common.runs(_UNBROKEN[np.frombuffer(data, np.uint8)])
    out, at, chars = [], 0, 0
    for k in np.flatnonzero(end - start >= LONG).tolist():
        s, e = int(start[k]), int(end[k])
        if re.search(rb"[0-9]|[a-z][A-Z]", data[s:e]):
            chars += len(data[at:s].decode("utf-8", "surrogatepass"))
            at = s
            pad = len(data[e : e + 2]) - len(data[e : e + 2].lstrip(b"="))
            out.append((chars, chars + e - s + pad))
    return out


def _key_lines(text: str, at: int, limit: int) -> int:
    """End of the run of key lines from ``at``, headers before them included;
    ``at`` if there are none."""
    end = at
    while m := _HEADER_LINE.match(text, at, limit):
        at = m.end()
    while at < limit and (m := _KEY_LINE.match(text, at, limit)) and m.end() > at:
        at = m.end()
        end = m.end("key") if m["key"] else end
    m = _KEY_PIECE.match(text, at, limit)  # the line goes on with other things
    return m.end("key") if m else end


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of private keys: from a BEGIN marker to the END marker that is next,
    or without one over the key lines that follow."""
    if "PRIVATE KEY" not in text:
        return []
    marks = [(*m.span(), m[1] or m[2]) for m in _MARKER.finditer(text)] + [(len(text), len(text), "")]
    out = []
    for (start, body, kind), (stop, end, then) in zip(marks, marks[1:], strict=False):
        if kind == "BEGIN":
            end = end if then == "END" else _key_lines(text, body, stop)
            if text[body : min(stop, end)].strip():
                out.append((start, end))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, the longer first; they can overlap."""
    blocks = key_blocks(text)
    edges = [0, *(x for b in blocks for x in b), len(text)]
    low = text.lower()
    patterns = [(kind, pattern) for kind, hints, pattern in PATTERNS if any(h in low for h in hints)]
    found = [(*b, "private_key") for b in blocks]
    for a, b in zip(edges[::2], edges[1::2], strict=True):  # what lies between key blocks
        found += [(a + s, a + e, "token") for s, e in long_tokens(text[a:b])]
        for kind, pattern in patterns:
            found += [(*m.span(m.lastindex or 0), kind) for m in pattern.finditer(text, a, b)]
    return sorted(set(found), key=lambda c: (c[0], -c[1], c[2]))


def findings_of(texts: list[str | None], paths: list[str | None], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of every candidate of every text; a key block
    says what it is and scores 1."""
    spots = [(i, *c) for i, t in enumerate(texts) if t for c in candidates(t)]
    rows = [features(texts[i][s:e], texts[i][max(0, s - CONTEXT) : s], texts[i][e : e + CONTEXT], paths[i] or "", forest.table, forest.words) for i, s, e, _ in spots]
    scores = forest.score(np.array(rows)) if rows else np.ones(0)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, s, e, kind), score in zip(spots, scores.tolist(), strict=True):
        out[i].append((s, e, kind, 1.0 if kind == "private_key" else score))
    return out


def accepted(found: list[tuple[int, int, str, float]], least: float) -> list[tuple[int, int, str, float]]:
    """The candidates that score ``least``, overlapping ones made one."""
    out: list[tuple[int, int, str, float]] = []
    best = (0.0, 0)
    for s, e, kind, score in found:  # by start
        if score < least:
            continue
        if out and s < out[-1][1]:
            start, end, was, top = out[-1]
            if (score, e - s) > best:
                was, top, best = kind, score, (score, e - s)
            out[-1] = (start, max(end, e), was, top)
        else:
            out.append((s, e, kind, score))
            best = (score, e - s)
    return out


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, path: str | None = "source", forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_secrets and secrets (start,
    end, kind, score), positions in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or forest_for(docs))  # 40 small trees and CORPUS_WORDS words
    rows = docs.select("doc_id", F.struct("text", (F.col(path).cast("string") if path in docs.columns else F.lit("")).alias("path")).alias("text"))

    def work(pairs: list) -> dict:
        found = findings_of([p["text"] for p in pairs], [p["path"] for p in pairs], shared.value)
        kept = [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in accepted(f, least)] for f in found]
        return {"n_candidates": pa.array([len({x[:2] for x in f}) for f in found], pa.int64()), "n_secrets": pa.array([len(k) for k in kept], pa.int64()), "secrets": pa.array(kept, FOUND)}

    return common.per_text(rows, ["doc_id"], "n_candidates long, n_secrets long, secrets array<struct<start:long,end:long,kind:string,score:double>>", work)


def redacted(text: str | None, found: list[tuple[int, int, str, float]], least: float, mark: str) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for s, e, _, _ in accepted(found, least):
        parts += [text[at:s], mark]
        at = e
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, path: str | None = "source", forest: Forest | None = None, least: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every secret of their texts replaced by ``mark``; an
    n_chars column follows."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or forest_for(docs))  # 40 small trees and CORPUS_WORDS words
    pair = F.struct("text", (F.col(path).cast("string") if path in docs.columns else F.lit("")).alias("path"))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), pair.alias("text"))

    def work(pairs: list) -> dict:
        texts = [p["text"] for p in pairs]
        found = findings_of(texts, [p["path"] for p in pairs], shared.value)
        return {"clean": pa.array([redacted(t, f, least, mark) for t, f in zip(texts, found, strict=True)], pa.string())}

    made = common.per_text(rows, ["row"], "clean string", work)
    cols = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.col("clean")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return made.select(*[cols[c].alias(c) for c in docs.columns])


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document; ``source`` is its path. The cases are those of
    the module."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
