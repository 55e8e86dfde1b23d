"""Secret scans: key-like strings of several kinds, judged by a random forest.

Candidates are runs of at least MIN_LENGTH key characters that hold a digit or a capital after a small letter, or are LONG; what is quoted or assigned
after a secret word, whatever its length and characters; passwords inside URLs; and PEM blocks. All are found on the bytes of whole texts. An = with a key
character behind it ends a run, so a name isn't part of its value. Most candidates are no secrets: checksums, commit ids, placeholders. A random forest
(numpy, grown here) tells them apart by length, character transitions, dictionary coverage, the path (of the row, else the last one named
nearby) and the four words on either side. It learns from labelled findings; example_findings makes a seeded set of them, for tables that bring none.

Edge cases: null and empty texts have no candidates; a null path counts as empty; a very long text is scanned whole, in pieces of whole rows, and a very long candidate
is judged whole; repeated rows are scanned each; other columns pass, but one of the name of an added column is an error: name another; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbframe.llm import hashing
from plumbframe.llm.common import table, unused

MIN_LENGTH = 12
LONG = 24
WORDS_NEAR = 4
REDACTED = b"[REDACTED]"
FINDINGS = T.ArrayType(T.StructType().add("start", "long").add("stop", "long").add("score", "double").add("secret", "boolean"))

KEY_BYTES = np.zeros(256, dtype=bool)
KEY_BYTES[[ord(c) for c in string.ascii_letters + string.digits + "+/=_-."]] = True
_DIGIT, _SMALL, _CAPITAL = (np.isin(np.arange(256), np.arange(a, a + n)) for a, n in ((48, 10), (97, 26), (65, 26)))

# Words near secrets, words near what only looks like one, and common words inside identifiers.
SECRET_WORDS = "token secret key apikey api_key password passwd passphrase pwd auth bearer credential credentials private access aws client_secret authorization".split()
BENIGN_WORDS = "example sample placeholder dummy test checksum sha sha1 sha256 md5 digest hash commit revision etag uuid guid request trace span build version id integrity hex".split()
DICTIONARY = "about access account action address admin agent alpha apple array async author backup basic batch beta block board build bytes cache call change channel check class client cloud code color commit config content control count create current data default delete demo design detail device digital document domain download dummy editor email engine entry error event example export false field file filter final first folder format found frame global graph group guide handler header hello here image import index info input insert install internal issue item java key label language large layout level library license light limit line link list local login main manager master memory message method mode model module monitor name network null number object offline online option order output package page panel parent password path pattern payment phone place plugin point policy private process product profile project proto public python query queue random range read record release remote report request resource response result root route sample schema screen script search secret section secure select server service session setting shared simple single size small source space stage start state static status storage store stream string style submit system table target template test text theme time title token total trace track tree trigger true type update upload user utils value vector version video view warning window word world write your".split()
TEST_PATH = re.compile(r"(?i)test|example|sample|fixture|mock|docs?/|readme|lock$|sum$")
KEY_PATH = re.compile(r"(?i)\.env|config|secret|credential|\.pem|\.key|settings|deploy")
#: What is quoted or assigned after a secret word; the value is looked at ahead, so that it can hold another name and value.
_ASSIGNED = re.compile(
    rb"""(?i)(?:token|secret|key|passw(?:or)?d|passphrase|pwd|auth|bearer|credential|private|access|aws)[\w.\-]*+["'`\])]*[ \t]*"""
    rb"""(?:(?::[ \t]*\w+[ \t]*=|[:!=]?==?>?|:)[ \t]*(?=(?:(?:bearer|basic)[ \t]+)?(?:"(?P<a>(?:[^"\\\r\n]|\\.)+)"|'(?P<b>(?:[^'\\\r\n]|\\.)+)'|`(?P<c>[^`\r\n]+)`|["'`]?(?P<d>[^\s"'`]+(?:["'`]+[^\s"'`,;:)\]}>]+)*)))"""
    rb"""|[(,]?[ \t]*(?=(?:"(?P<e>(?:[^"\\\r\n]|\\.)+)"|'(?P<f>(?:[^'\\\r\n]|\\.)+)'|`(?P<g>[^`\r\n]+)`)))"""
)
_NEAR = re.compile(r"[A-Za-z0-9_]+")
_NEAR_BYTES = re.compile(rb"[A-Za-z0-9_]+")
_URL_PASSWORD = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:([^\s/@]+)@")
_PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_PATH = re.compile(r"[\w./-]*(?:/[\w.-]+|\w\.(?:py|js|ts|go|rs|java|rb|php|sh|yml|yaml|json|toml|ini|cfg|conf|env|pem|key|md|txt|lock|sum|xml|properties))\b|\.env\b")
# How keys of well-known services begin.
_KNOWN = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|whsec_|sk-|AIza|npm_|pypi-|SG\.|eyJ|dop_v1_|shpat_)")

FEATURES = ["length", "entropy", "distinct", "digits", "upper", "lower", "other", "hex", "turns", "likelihood", "dictionary", "longest_run", "assigned", "quoted", "secret_before", "benign_before", "secret_after", "benign_after", "test_path", "key_path", "password_before", "spaces", "odd", "known", "private", "in_url", "braces"]


def transition_table() -> np.ndarray:
    """Log probabilities of one letter after another in ordinary words, from DICTIONARY."""
    counts = np.full((27, 27), 0.2)
    for w in DICTIONARY + SECRET_WORDS + BENIGN_WORDS:
        at = [ord(c) - 96 if c.isalpha() else 0 for c in f" {w} "]
        for a, b in zip(at, at[1:], strict=False):
            counts[a, b] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


_TRANSITIONS = transition_table()
_WORDS_BY_LENGTH = sorted({w for w in DICTIONARY if len(w) >= 4}, key=len, reverse=True)
_ANY_WORD = re.compile("|".join(map(re.escape, _WORDS_BY_LENGTH)))


def features(candidate: str, before: str = "", after: str = "", path: str = "") -> list[float]:
    """The numbers that FEATURES names."""
    n = len(candidate)
    counts = Counter(candidate)
    low = candidate.lower()
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in candidate]
    at = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
    run = longest = 1
    for a, b in zip(candidate, candidate[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    near = [w.lower() for w in _NEAR.findall(before)][-WORDS_NEAR:]
    then = [w.lower() for w in _NEAR.findall(after)][:WORDS_NEAR]
    path = path or next(reversed(_PATH.findall(before)), "")
    has = lambda words, known: float(any(w in known or any(p in known for p in w.split("_")) for w in words))
    gap = before.rstrip()
    return [
        n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(_TRANSITIONS[a, b] for a, b in zip(at, at[1:], strict=False)) / max(n - 1, 1),
        sum(len(m) for m in _ANY_WORD.findall(low)) / n,
        longest,
        float(gap.rstrip("\"'` ")[-1:] in ("=", ":")),
        float(before[-1:] in ("'", '"', "`")),
        has(near, SECRET_WORDS),
        has(near, BENIGN_WORDS),
        has(then, SECRET_WORDS),
        has(then, BENIGN_WORDS),
        float(bool(TEST_PATH.search(path))),
        float(bool(KEY_PATH.search(path))),
        float(any("pass" in w or "pwd" in w or "secret" in w for w in near[-1:])),
        candidate.count(" ") / n,
        sum(c in "!@#%^&*?~" for c in candidate) / n,
        float(bool(_KNOWN.match(candidate))),
        float(candidate.startswith("-----BEGIN") and "PRIVATE KEY" in candidate[:60]),
        float(bool(re.search(r"://[^\s:/@]*:$", before))),
        sum(c in "{}<>()$[]" for c in candidate) / n,
    ]


def example_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label) of n findings in seeded random order of kinds: about half secrets as they stand in configuration, code, logs
    and prose, half what only looks like one or stands in its place."""
    rnd = random.Random(seed)
    some = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
    hexes, alnum, capitals, signs = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "!@#$%^&*?~+-_=.:"
    pick, between = rnd.choice, rnd.randint
    syllables = lambda k: "".join(some("bcdfghjklmnprstvwz", 1) + some("aeiou", 1) + pick(["", "", "n", "r", "s"]) for _ in range(k))
    # Half the words are of the dictionary, half of no language: what stands around a finding must not be known by heart.
    word = lambda: pick(DICTIONARY) if rnd.random() < 0.5 else syllables(between(1, 3))
    prose = lambda: " ".join(word() for _ in range(between(0, 6)))
    case = lambda w: pick([w, w, w, w.upper(), w.capitalize()])
    hexkey = lambda *k: pick([str.lower, str.lower, str.upper])(some(hexes, pick(k)))
    b64 = lambda k: base64.b64encode(rnd.randbytes(k)).decode()
    uuid = lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))
    camel = lambda: syllables(2) + "".join(pick(DICTIONARY).capitalize() for _ in range(between(1, 4)))
    named = lambda: pick([case(pick(SECRET_WORDS)), f"{pick(DICTIONARY)}_{pick(SECRET_WORDS)}", f"{pick(DICTIONARY).upper()}_{pick(SECRET_WORDS).upper()}", f"x-{pick(DICTIONARY)}-{pick(SECRET_WORDS)}"])
    password = lambda: pick(["password", "passwd", "pwd", "passphrase", "secret", "db_password", "client_secret", "PASSWORD", "Password"])
    sign = lambda: pick([" = ", "=", ": ", ":", " := ", " is ", " => "])
    quotes = lambda: pick(["", '"', "'", '"', "`"])
    pem = lambda kind, k: f"-----BEGIN {kind}-----\n" + "\n".join(b64(48) for _ in range(k)) + f"\n-----END {kind}-----"
    services = [lambda: pick(["AKIA", "ASIA"]) + some(capitals, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + some(alnum, 36), lambda: "github_pat_" + some(alnum, 22) + "_" + some(alnum, 59), lambda: "glpat-" + some(alnum + "-_", 20), lambda: f"xox{pick('bpa')}-{some(string.digits, 11)}-{some(alnum, 24)}", lambda: pick(["sk_live_", "rk_live_"]) + some(alnum, 24), lambda: "whsec_" + some(alnum, 32), lambda: "sk-" + some(alnum, 48), lambda: "AIza" + some(alnum + "-_", 35), lambda: "npm_" + some(alnum, 36), lambda: "SG." + some(alnum, 22) + "." + some(alnum, 43), lambda: f"eyJ{b64(24).rstrip('=')}.eyJ{b64(45).rstrip('=')}.{some(alnum + '-_', 43)}", lambda: "shpat_" + some(hexes, 32)]
    strings = [lambda: hexkey(32, 40, 48, 64), lambda: some(alnum, between(16, 64)), lambda: some(alnum + "+/", 40), lambda: b64(between(12, 64)), lambda: some(alnum + "-_", between(20, 44)), lambda: some(string.ascii_letters, between(16, 40)), uuid]
    short = [lambda: some(alnum + "!@#$%&*?", between(8, 20)), lambda: syllables(3).capitalize() + some(string.digits, between(2, 4)) + some("!@#$%&*?", between(0, 2)), lambda: some(alnum + signs, between(8, 24)), lambda: some(string.ascii_letters, between(10, 15)), lambda: some(alnum, between(8, 15)), lambda: syllables(2).replace("a", "4").replace("e", "3").replace("o", "0") + some("&!#", 1) + some(alnum, between(1, 4))]
    phrase = lambda: pick([" ", "-"]).join(syllables(2) for _ in range(between(4, 7)))
    stands_in = ["changeme", "change_me", "<password>", "${TOKEN}", "$PASSWORD", "%s", "{}", "{{ password }}", "None", "null", "true", "false", "str", "string", "required", "your_password_here", "your-api-key", "YOUR_API_KEY", "xxxxxxxx", "********", "...", "REDACTED", "[REDACTED]", "<your-key>", "<token>", "yes", "no", "optional", "process.env.API_KEY", "TODO", "n/a"]

    def secret() -> tuple[str, str, str]:
        kind = rnd.randrange(9)
        quote = quotes()
        if kind == 0:
            return pick(services)(), pick([f"{named()}{sign()}{quote}", f"{prose()} ", f"{prose()} {quote}", "Authorization: Bearer "]), quote
        if kind in (1, 2, 3):
            return pick(strings)(), f"{named()}{sign()}{quote}", quote
        if kind in (4, 5):
            return pick(short)(), f"{password()}{sign()}{quote}", quote
        if kind == 6:
            quote = pick(['"', "'"])
            return phrase(), f"{password()}{sign()}{quote}", quote
        if kind == 7:
            return pick([*short, *strings])().replace("@", "").replace("/", "").replace(":", ""), f"{pick(['postgres', 'mysql', 'mongodb', 'redis', 'amqp', 'https'])}://{pick(DICTIONARY)}:", f"@{syllables(2)}.{pick(['com', 'net', 'local'])}"
        return pem(pick(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]), between(3, 20)), pick(["", f"{prose()}: ", "key: |\n"]), "\n"

    def other() -> tuple[str, str, str]:
        kind = rnd.randrange(16)
        quote = quotes()
        benign = f"{case(pick(BENIGN_WORDS))}{pick([' ', ': ', '=', ' = '])}{quote}"
        if kind in (0, 1):
            return hexkey(32, 40, 40, 64), pick([benign, f"{prose()} ", f"{prose()} ("]), quote
        if kind == 2:
            return uuid(), pick([benign, f"{prose()} id {quote}", f"{prose()} "]), quote
        if kind == 3:
            return "_".join([*rnd.sample(DICTIONARY, between(3, 5)), str(between(1, 99))]), pick([f"{named()}{sign()}{quote}", benign, f"{prose()} "]), quote
        if kind == 4:
            return pick(["x0X*1a", "xX*", "a1"])[0] * between(8, 40) + pick(["", "0"]), f"{named()}{sign()}{quote}", quote
        if kind == 5:
            return pick(["/", "."]).join([*rnd.sample(DICTIONARY, between(3, 6)), some(string.digits, 4)]), f"{pick(['see', 'at', 'www', 'in', 'from', 'import'])} ", ""
        if kind == 6:
            return some(string.digits, between(12, 24)), f"{prose()} {pick(['id', 'order', 'number', 'ref', 'call', 'phone', 'account'])} ", ""
        if kind == 7:
            return "-".join(syllables(between(1, 3)) for _ in range(between(3, 5))) + pick(["", f"-{between(1, 2030)}"]), f"{prose()} ", ""
        if kind == 8:
            return camel(), pick([f"{prose()} ", "return ", "import ", f"{named()}{sign()}"]), pick(["", "()", ";"])
        if kind == 9:
            return pick(["sha256-", "sha384-", "sha512-"]) + b64(pick([32, 48, 64])), f"integrity={quote}", quote
        if kind == 10:
            return pick(["base64,", "", "png;base64,"]) + b64(between(20, 200)), f"{prose()} data:image/", ""
        if kind == 11:
            return pick([f"{between(1990, 2030)}-0{between(1, 9)}-{between(10, 28)}T{between(10, 23)}:{between(10, 59)}:{between(10, 59)}Z", f"{syllables(2)}-{between(1, 9)}.{between(0, 20)}.{between(0, 9)}-{pick(['beta', 'linux', 'py3'])}", f"{syllables(3)}{between(10, 99)}.{pick(DICTIONARY)}.com", f"{syllables(2)}.{syllables(2)}{between(1, 99)}"]), f"{prose()} {pick(['', 'at ', 'version ', 'from ', 'mail '])}", ""
        if kind == 12:
            return pick(stands_in), f"{pick([named, password])()}{sign()}{quote}", quote
        if kind == 13:
            return pick(["os.environ", "config.", "self.", "get_", "settings.", "request.", "process.env."]) + pick(DICTIONARY) + pick(["", "()", "[0]", "_name", "(user)"]), f"{pick([named, password])()}{sign()}", pick(["", ";", ","])
        if kind == 14:
            return pick([pick(DICTIONARY), syllables(between(1, 3)), " ".join(rnd.sample(DICTIONARY, between(2, 5)))]), f"{pick([*SECRET_WORDS, 'key', 'access'])}{pick([': ', ' = ', ' is ', ' '])}{quote}", quote
        return pem(pick(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"]), between(3, 20)), pick(["", f"{prose()}: "]), "\n"

    paths = ["", "", "", "", "src/app.py", "config/settings.py", ".env", "deploy/prod.yml", "README.md", "tests/test_auth.py", "lib/http/client.go"]
    out = []
    for i in range(n):
        c, before, after = secret() if i % 2 == 0 else other()
        path = pick(paths) if i % 2 == 0 else pick([*paths, "package.lock", "go.sum", "tests/fixtures.json"])
        out.append((c, f"{prose()} {before}", f"{after}{pick([' ', '. ', ', ', chr(10)])}{prose()}", path, 1 - i % 2))
    return out


@dataclass
class Forest:
    """Trees as arrays: of node i, feature[i] <= cut[i] goes to left[i], else to right[i]; a leaf has feature -1 and value[i]."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[rows, np.maximum(f, 0)] <= cut[node]
                node = np.where(inner, np.where(below, left[node], right[node]), node)
            total += value[node]
        return total / max(len(self.trees), 1)


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
    """Each tree from rows drawn with repeats, each split the best by Gini impurity among sqrt(features) drawn features."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    tries = max(1, round(math.sqrt(d)))
    out = []
    for _ in range(trees):
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int, nodes: list[list] = nodes) -> int:
            me, ys = len(nodes), y[rows]
            nodes.append([-1, 0.0, 0, 0, float(ys.mean())])
            if level == depth or len(rows) < 2 * least or ys.min() == ys.max():
                return me
            best = (np.inf, 0, 0.0)
            for f in rng.choice(d, tries, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows, f][order], np.cumsum(ys[order])
                k = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(rows) - k >= least)
                if not ok.any():
                    continue
                a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(rows) - k)
                impurity = np.where(ok, k * a * (1 - a) + (len(rows) - k) * b * (1 - b), np.inf)
                j = int(impurity.argmin())
                if impurity[j] < best[0]:
                    best = (float(impurity[j]), int(f), float((v[j] + v[j + 1]) / 2))
            if best[0] < np.inf:
                below = x[rows, best[1]] <= best[2]
                left, right = grow(rows[below], level + 1), grow(rows[~below], level + 1)
                nodes[me][:4] = [best[1], best[2], left, right]
            return me

        grow(rng.integers(0, n, n), 0)
        cols = list(zip(*nodes, strict=True))
        out.append((np.array(cols[0]), np.array(cols[1], float), np.array(cols[2]), np.array(cols[3]), np.array(cols[4], float)))
    return Forest(out)


def train_forest(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    """From labelled findings (candidate, before, after, path, label), by default example_findings()."""
    findings = example_findings() if findings is None else findings
    return grow_forest(np.array([features(*f[:4]) for f in findings]), np.array([f[4] for f in findings], float))


def candidates(data: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the telling runs of key characters, in the bytes of a chunk."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = KEY_BYTES[data]
    # A row of = with a key character of the same text behind it separates; else it is padding.
    equal = np.flatnonzero(data == 61)
    if len(equal):
        last = np.flatnonzero(np.append(equal[1:] != equal[:-1] + 1, True))
        behind = equal[last] + 1
        inner = (behind < n) & KEY_BYTES[data[np.minimum(behind, n - 1)]] & ~np.isin(behind, offsets)
        inside[equal[np.repeat(inner, np.diff(last, prepend=-1))] + 1] = False
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] |= inside[cuts + 1]
    ends[cuts - 1] |= inside[cuts]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = end - start >= min_length
    start, end = start[long], end[long]
    # Digits, and capitals right after small letters, from the second byte of the run on.
    before = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    digits, turns = before(_DIGIT[data]), before(np.concatenate(([False], _SMALL[data[:-1]] & _CAPITAL[data[1:]])) if n else np.zeros(0, bool))
    some = (digits[end] > digits[start]) | (turns[end] > turns[start + 1]) | (end - start >= LONG)
    start, end = start[some], end[some]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def assigned(raw: bytes, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the values after secret words between start and stop."""
    for m in _ASSIGNED.finditer(raw, start, stop):
        s, e = m.span(m.lastgroup)
        if m.lastgroup == "d":
            e -= (e - s) - len(raw[s:e].rstrip(b".,;:)]}>"))  # what closes the sentence or the call
        if e > s:
            yield s, e


def others(raw: bytes, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """(start, end) of passwords in URLs and of PEM blocks between start and stop."""
    if raw.find(b"://", start, stop) >= 0:
        yield from (m.span(1) for m in _URL_PASSWORD.finditer(raw, start, stop))
    if raw.find(b"-----BEGIN ", start, stop) >= 0:
        yield from (m.span() for m in _PEM.finditer(raw, start, stop))


def neighbours(raw: bytes, low: int, start: int, end: int, high: int) -> tuple[str, str]:
    """The texts on either side of a candidate that hold WORDS_NEAR whole words, or all there is between low and high."""
    size = 48
    while True:
        a, b = max(low, start - size), min(high, end + size)
        before, after = raw[a:start], raw[end:b]
        enough = lambda side, whole: whole or len(_NEAR_BYTES.findall(side)) > WORDS_NEAR
        if enough(before, a == low) and enough(after, b == high):
            return before.decode("utf-8", "ignore"), after.decode("utf-8", "ignore")
        size *= 4


def _judged(batch: pa.RecordBatch, text: str, path: str | None, forest: Forest, threshold: float = 0.5) -> Iterator[tuple[bytes, list[tuple[int, int, float]]]]:
    """Of each row: its bytes (of rows with candidates) and (start, stop, score) of the candidates, in bytes."""
    paths = batch.column(path).to_pylist() if path else None
    for at, data, offsets in hashing.chunks(batch.column(text)):
        row, start, end = candidates(data, offsets)
        raw = data.tobytes()
        rows = len(offsets) - 1
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(rows)]
        x, where = [], []
        spans = set()
        for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            e -= len(raw[s:e]) - len(raw[s:e].rstrip(b"."))  # a full stop is the sentence's
            if e - s >= MIN_LENGTH:
                spans.add((r, s, e))
        for r in range(rows):
            a, b = int(offsets[r]), int(offsets[r + 1])
            spans |= {(r, s, e) for find in (assigned, others) for s, e in find(raw, a, b)}
        for r, s, e in sorted(spans):
            x.append(features(raw[s:e].decode("utf-8", "replace"), *neighbours(raw, int(offsets[r]), s, e, int(offsets[r + 1])), (paths[at + r] or "") if paths else ""))
            where.append((r, s - int(offsets[r]), e - int(offsets[r])))
        if x:
            for (r, s, e), score in zip(where, forest.scores(np.array(x)).tolist(), strict=True):
                found[r].append((s, e, score))
            # What lies within a longer secret is part of it.
            hit = [[(s, e) for s, e, p in f if p >= threshold] for f in found]
            found = [[d for d in f if not any(s <= d[0] and d[1] <= e and (s, e) != d[:2] for s, e in h)] if h else f for f, h in zip(found, hit, strict=True)]
        for r in range(rows):
            yield (raw[offsets[r] : offsets[r + 1]] if found[r] else b""), found[r]


def scan_secrets(docs: DataFrame, forest: Forest, *, text: str = "text", path: str | None = None, threshold: float = 0.5, findings: str = "findings", redacted: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (default all) with findings: array of (start, stop in bytes, score, secret); on request also redacted:
    the text with its secrets replaced (null stays null)."""
    keep = docs.columns if keep is None else keep
    if clash := {findings, redacted} & set(keep):
        raise ValueError(f"there is a column {', '.join(sorted(clash))} already; name another")
    read, of_path = text if text in keep else unused(keep, "_sec_text"), unused(keep, "_sec_path")
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(text).alias(read)]), *([F.col(path).cast("string").alias(of_path)] if path else []))
    sent = docs.sparkSession.sparkContext.broadcast(forest.trees)  # some 100 KB
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("secret", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Forest(sent.value)
        for b in batches:
            found, texts = [], b.column(read).to_pylist() if redacted else []
            for i, (raw, rows) in enumerate(_judged(b, read, of_path if path else None, grown, threshold)):
                found.append([{"start": s, "stop": e, "score": p, "secret": p >= threshold} for s, e, p in rows])
                if redacted and any(p >= threshold for *_, p in rows):
                    parts, at = [], 0
                    for s, e, p in rows:
                        if p >= threshold:
                            parts += [raw[at:s], REDACTED] if s >= at else []  # overlapping secrets go together
                            at = e
                    texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            columns = [*[b.column(c) for c in keep], pa.array(found, kind)] + ([pa.array(texts, pa.string())] if redacted else [])
            yield pa.RecordBatch.from_arrays(columns, [*keep, findings, *([redacted] if redacted else [])])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(findings, FINDINGS)
    return inputs.mapInArrow(run, schema.add(redacted, "string") if redacted else schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, score (of the likeliest candidate, 0 without) and first_secret (its start in bytes, or null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = scan_secrets(docs, train_forest(), path="source", keep=["doc_id"])
    secrets = F.filter("findings", lambda f: f.secret)
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), F.coalesce(F.array_max(F.transform("findings", lambda f: f.score)), F.lit(0.0)).alias("score"), F.array_min(F.transform(secrets, lambda f: f.start)).alias("first_secret"))
