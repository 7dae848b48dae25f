"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens (runs of letters, digits and _+/-, or single marks) as secret begin, inside or
outside, from their shape, the neighbouring words and the file's features; Viterbi gives the best tags. Its
structure: a secret begins at a run that isn't plain (8 or more characters with a digit, or a capital after a
small letter), or at any run within REACH tokens after one that holds a credential word; it goes on only in ASCII tokens that
touch the token before. Every other token is outside. So the best tags of the whole text are those of its
stretches, each from a token that can begin a secret to the first that can neither begin nor continue one (tests
compare with the whole chain). What is left out: secrets of letters only, or of less than 8 characters, or broken up
by marks, that have no credential word near before them, and those beyond ASCII.

Whole texts are looked at. The weights are trained on the driver, on lines written by a seeded generator.
Null and empty texts have no spans. Offsets are code points, ends exclusive. Null ids pass through,
repeated rows are scanned each. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_rows, slices
from weftline.session import prepare

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

FEATURES = 1 << 13
OUT, BEGIN, IN = 0, 1, 2
TOKEN = re.compile(r"[A-Za-z0-9_+/-]+|[^\sA-Za-z0-9_+/-]")
CAPABLE = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{8})(?=[A-Za-z_+/-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9_+/-]+")
#: A credential word within a token, and for how many tokens after it any run may begin a secret.
CREDENTIAL = re.compile(r"passw|passphrase|passcode|pwd|secret|token|credential|api[_-]?key|auth(?!or)|bearer|(?:private|access|encryption|signing)[_-]key|_key(?![a-z])|_pw(?![a-z])", re.I | re.A)
REACH = 4
_RUN = re.compile(r"[A-Za-z0-9_+/-]*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' matches, by start and then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def capable(token: str) -> bool:
    return CAPABLE.fullmatch(token) is not None


def shape(token: str) -> str:
    s = re.sub(r"[a-z]+", "a", token)
    s = re.sub(r"[A-Z]+", "A", s)
    return re.sub(r"[0-9]+", "0", s)[:8]


def entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in map(token.count, set(token)))


def file_features(text: str) -> tuple[str, ...]:
    """What the whole text says: is it like code or settings, is it long, is it full of numbers."""
    n = max(1, len(text))
    code = sum(map(text.count, "{};=")) / n
    digits = sum(map(text.count, "0123456789")) / n
    return (f"code{min(3, int(code * 100))}", f"digits{min(3, int(digits * 20))}", f"long{min(3, len(str(n)) - 1)}")


def is_mark(token: str) -> bool:
    return len(token) == 1 and not (token.isascii() and (token.isalnum() or token in "_+/-"))


def features(tokens: list[str], i: int, file: tuple[str, ...], glued: bool = False) -> list[int]:
    """Hashed features of token i; they look at the four tokens before it and the one after. ``glued``: it touches the one before."""
    t = tokens[i]
    near = [(k, tokens[i + k].lower() if 0 <= i + k < len(tokens) else "^") for k in (-4, -3, -2, -1, 1)]
    before = [w for k, w in near if k < 0]
    told = any(map(CREDENTIAL.search, before))
    if is_mark(t):
        own = ["mark", f"mark={t}", f"mark={t}&{glued}&{near[-1][1].isalnum()}"]
        able = False
    else:
        able = capable(t)
        low = t.lower()
        own = [f"able={able}", f"shape={shape(t)}", f"len={min(12, len(t) // 4)}", f"word={low if len(low) < 20 else '-'}", f"told={told}&{able}", f"told={told}&{glued}&{before[-1] if is_mark(before[-1]) else 'w'}"]
        digits = sum(c.isdigit() for c in t)
        if able or told:
            changes = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
            own += [f"{f}&{able}" for f in (f"ent={int(2 * entropy(t))}", f"alldigits={digits == len(t)}", f"hex={not set(low) - set('0123456789abcdef-')}", f"changes={min(6, changes)}", f"upper={t.upper() == t}", f"under={'_' in t}", f"dashes={min(4, t.count('-'))}")]
            own += [f"prefix={low[:4]}&{len(low) > 4}"]
            own += [f"{f}&able={able}" for f in file]
        if told and not able:
            own += [f"plain&{before[-1]}&{glued}&{min(4, len(t) // 4)}", f"plain&{before[-2]}|{before[-1]}", f"plain&digits={min(3, digits)}", f"plain&small={t.islower()}", f"plain&next={near[-1][1] if is_mark(near[-1][1]) else 'w'}&{glued}"]
    own += [f"{k}:{w if len(w) < 20 else '-'}&{able}" for k, w in near]
    own += [f"near:{w}&{able}" for w in before if w.isalpha()]
    own.append(f"{before[-2]}|{before[-1]}&{able}")
    own.append(f"glued={glued}&{told}&{before[-1] if is_mark(before[-1]) else shape(before[-1])}")
    return [zlib.crc32(f.encode()) % FEATURES for f in own]


def allowed(tokens: list[str], glued: list[bool]) -> np.ndarray:
    """Tokens x tags: which tags a token may have (0, or minus infinity)."""
    out = np.zeros((len(tokens), 3))
    for i, t in enumerate(tokens):
        if is_mark(t) or not (capable(t) or any(map(CREDENTIAL.search, tokens[max(0, i - REACH) : i]))):
            out[i, BEGIN] = -np.inf
        if not (glued[i] and t.isascii()):
            out[i, IN] = -np.inf
    return out


# Training lines ----------------------------------------------------------------------------------

_WORDS = "the of and for with this from value set user config please use note that server key line file is was der und la le de en run test build see id order call page total".split()
_NAMES = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "client_secret", "access_token", "auth", "credential", "private_key", "SECRET_KEY", "DB_PASSWORD", "aws_secret_access_key", "passphrase", "bearer"]


def _any(r: random.Random, alphabet: str, low: int, high: int) -> str:
    while True:
        s = "".join(r.choices(alphabet, k=r.randint(low, high)))
        if any(c.isdigit() for c in s):
            return s


_PARTS = "river stone copper window yellow basket mountain silver tiger orange winter pocket candle rocket garden purple engine marble coffee dragon sunny castle monkey apple bridge falcon hammer island jungle kettle lemon meadow needle ocean pepper quartz rabbit shadow timber velvet walnut zebra correct horse battery staple kitchen table letmein welcome admin qwerty summer hunter".split()
_MARKS = "!@#$%^&*~?"


def _typed(r: random.Random) -> str:
    """A password as people choose them: words, some with digits or marks."""
    w = lambda: r.choice(_PARTS)
    leet = lambda x: "".join({"a": "@", "o": "0", "e": "3", "i": "1", "s": "$"}.get(c, c) if r.random() < 0.5 else c for c in x)
    mixed = string.ascii_letters + string.digits + _MARKS
    return r.choice([
        lambda: "-".join(w() for _ in range(r.randint(3, 5))), lambda: "".join(w() for _ in range(r.randint(2, 4))), lambda: w().title() + w().title(), lambda: leet(w()) + r.choice(_MARKS) + r.choice("xyz") + str(r.randint(0, 99)), lambda: w().title() + str(r.randint(1, 2030)) + r.choice(_MARKS),
        lambda: r.choice(string.ascii_letters) + "".join(r.choices(mixed, k=r.randint(7, 20))), lambda: "".join(r.choices(string.ascii_uppercase, k=r.randint(10, 24))), lambda: "_".join(w() for _ in range(r.randint(2, 4))), lambda: "".join(r.choices(string.ascii_lowercase, k=r.randint(8, 20))), lambda: w() + str(r.randint(1, 9999)),
    ])()


def _secret(r: random.Random) -> str:
    an = string.ascii_letters + string.digits
    return r.choice([
        lambda: _any(r, an, 12, 44), lambda: _any(r, an + "+/", 28, 44) + r.choice(["", "=", "=="]), lambda: "ghp_" + _any(r, an, 36, 36), lambda: r.choice(["sk", "pk", "rk"]) + "_live_" + _any(r, an, 24, 24),
        lambda: f"xoxb-{_any(r, string.digits, 11, 12)}-{_any(r, an, 24, 24)}", lambda: f"eyJ{_any(r, an, 16, 30)}.eyJ{_any(r, an, 20, 40)}.{_any(r, an + '_-', 30, 43)}", lambda: _any(r, "0123456789abcdef", 12, 64), lambda: "AIza" + _any(r, an + "_-", 35, 35), lambda: _any(r, string.ascii_uppercase + string.digits, 16, 32), lambda: "glpat-" + _any(r, an + "_-", 20, 20),
    ])()


#: What stands after a credential word without being a secret.
_NOTHING = "required optional string str none null true false here expired reset changed missing invalid must should will was and or for field form page policy manager of in the a your is not self.get os.environ get_secret() getpass() input() <hidden> ${PASSWORD} {{token}} ******** int bool garden santa box ring text type file name service getToken(user); generateKey(32) config.get('x') request.headers['x'] createToken(id, load_secret(path) readPassword() $(cat this.state.value process.env.DB <your-password> changeToken()".split()


def _harmless(r: random.Random) -> str:
    d = string.digits
    w = lambda: r.choice(_WORDS)
    return r.choice([
        lambda: f"{w()}.{w()}{_any(r, d, 1, 4)}@{w()}{w()}.example.com", lambda: f"+{_any(r, d, 2, 2)} {_any(r, d, 3, 4)} {_any(r, d, 6, 8)}", lambda: f"({_any(r, d, 3, 3)}) {_any(r, d, 3, 3)}-{_any(r, d, 4, 4)}", lambda: f"{_any(r, d, 4, 4)}-{_any(r, d, 2, 2)}-{_any(r, d, 2, 2)}", lambda: f"{_any(r, d, 3, 3)}-{_any(r, d, 2, 2)}-{_any(r, d, 4, 4)}",
        lambda: f"https://{w()}.example.org/{w()}/{_any(r, d, 5, 9)}.html", lambda: f"{w()}_{w()}_{_any(r, d, 6, 8)}.jpg", lambda: f"request {_any(r, '0123456789abcdef', 8, 8)}-{_any(r, '0123456789abcdef', 4, 4)}-4{_any(r, '0123456789abcdef', 3, 3)}-{_any(r, '0123456789abcdef', 12, 12)}", lambda: f"commit {_any(r, '0123456789abcdef', 8, 14)}", lambda: f"ISBN {_any(r, d, 13, 13)}", lambda: f"order {_any(r, d, 8, 12)}", lambda: f"version-{_any(r, d, 1, 1)}.{_any(r, d, 1, 2)}.{_any(r, d, 1, 2)}-beta{_any(r, d, 1, 1)}",
        lambda: f"get{w().title()}By{w().title()}{r.choice(['', '2', 'Id'])}()", lambda: f"{_any(r, d, 4, 4)} {_any(r, d, 4, 4)} {_any(r, d, 4, 4)} {_any(r, d, 4, 4)}", lambda: f"{w()}{w()}{w()}{_any(r, d, 1, 3)}", lambda: f"{w().title()}{w().title()}{w().title()}", lambda: f"IBAN DE{_any(r, d, 20, 20)}", lambda: f"{_any(r, d, 1, 3)}.{_any(r, d, 1, 3)}.{_any(r, d, 1, 3)}.{_any(r, d, 1, 3)}", lambda: f"{_any(r, d, 9, 14)}",
    ])()


def training_lines(n: int, seed: int = 6) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the spans of the secrets in them."""
    r, out = random.Random(seed), []
    for _ in range(n):
        line, spans = "", []
        for _ in range(r.randint(1, 3)):
            line += " ".join(r.choices(_WORDS, k=r.randint(1, 6))) + " "
            if r.random() < 0.25:
                s, name, q = _typed(r), r.choice(_NAMES), r.choice(["", "", '"', "'"])
                lead = r.choice([f"{name}={q}", f"{name}: {q}", f"{name} = {q}", f"export {name.upper()}={q}", f'"{name}": "', f"{name} := {q}", f"--{name}={q}", f"{name} -> {q}", f"user=x;{name}={q}", f"{name}:{q}"])
                q = '"' if lead.endswith('": "') else q
                line += lead
                spans.append((len(line), len(line) + len(s)))
                line += s + q + r.choice([" ", " ", "; ", ", ", "\n", "    "])
            elif r.random() < 0.4:
                s, name, q = _secret(r), r.choice(_NAMES), r.choice(["", "", '"', "'"])
                lead = r.choice([f"{name}={q}", f"{name}: {q}", f"{name} = {q}", f"export {name.upper()}={q}", f'"{name}": "', f"{name} is ", f"Authorization: Bearer ", f"--{name} ", f"{name} := {q}", f"my {name} {q}"])
                line += lead
                spans.append((len(line), len(line) + len(s)))
                line += s + q + " "
            elif r.random() < 0.45:
                line += f"{r.choice(['the', 'a', 'your', 'set', ''])} {r.choice(_NAMES)}{r.choice([' is ', ' was ', ' ', ' and ', '=', ': ', ' = ', ', ', '. ', 's '])}{r.choice(_NOTHING + _WORDS)} {r.choice(_WORDS + _PARTS)} "
            else:
                line += _harmless(r) + " "
        out.append((line, spans))
    return out


def _sequences(lines):
    for line, spans in lines:
        places = [(m.start(), m.end()) for m in TOKEN.finditer(line)]
        tokens = [line[a:b] for a, b in places]
        glued = _glued(places)
        tags, ok = np.zeros(len(tokens), int), allowed(tokens, glued)
        for lo, hi in spans:
            began = False
            for i, (a, b) in enumerate(places):
                if lo <= a and b <= hi:
                    tag = IN if began else BEGIN
                    if ok[i, tag] == 0:
                        tags[i], began = tag, True
                    elif began:
                        break
        file = file_features(line)
        yield [features(tokens, i, file, glued[i]) for i in range(len(tokens))], tags, ok


def _glued(places: list[tuple[int, int]]) -> list[bool]:
    return [i > 0 and places[i - 1][1] == a for i, (a, _) in enumerate(places)]


@lru_cache(1)
def trained(lines: int = 5000, rounds: int = 6, batch: int = 64, rate: float = 0.15, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x tags, tag x next tag) by AdaGrad on the log-likelihood, batches padded and vectorised."""
    data = sorted(_sequences(training_lines(lines)), key=lambda x: len(x[1]))
    r = np.random.default_rng(6)
    w, move = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    gw, gm = np.full((FEATURES, 3), 1e-2), np.full((3, 3), 1e-2)
    move_ok = np.zeros((3, 3))
    move_ok[OUT, IN] = -1e9
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    for _ in range(rounds):
        for g in r.permutation(len(groups)):
            part = groups[g]
            n, most = len(part), max(len(x[1]) for x in part)
            rows = np.concatenate([np.full(len(f), s * most + i) for s, x in enumerate(part) for i, f in enumerate(x[0])])
            cols = np.concatenate([np.array(f) for x in part for f in x[0]])
            unary = np.zeros((n * most, 3))
            np.add.at(unary, rows, w[cols])
            unary = unary.reshape(n, most, 3)
            mask = np.zeros((n, most), bool)
            gold = np.zeros((n, most), int)
            for s, (_, tags, ok) in enumerate(part):
                mask[s, : len(tags)], gold[s, : len(tags)] = True, tags
                unary[s, : len(tags)] += np.maximum(ok, -1e9)
            t = move + move_ok
            a, b = np.zeros((n, most, 3)), np.zeros((n, most, 3))
            a[:, 0] = unary[:, 0] + np.array([0, 0, -1e9])
            for i in range(1, most):
                x = a[:, i - 1, :, None] + t
                top = x.max(axis=1)
                a[:, i] = np.where(mask[:, i, None], top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + unary[:, i], a[:, i - 1])
            for i in range(most - 2, -1, -1):
                x = t + (unary[:, i + 1] + b[:, i + 1])[:, None, :]
                top = x.max(axis=2)
                b[:, i] = np.where(mask[:, i + 1, None], top + np.log(np.exp(x - top[..., None]).sum(axis=2)), 0)
            top = a[:, -1].max(axis=1)
            z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(axis=1))
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            d = -p
            d[np.arange(n)[:, None], np.arange(most), gold] += mask
            grad = np.zeros_like(w)
            np.add.at(grad, cols, d.reshape(-1, 3)[rows])
            grad = grad / n - l2 * w
            pair = np.exp(a[:, :-1, :, None] + t + (unary[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            dm = -pair.sum(axis=(0, 1))
            np.add.at(dm, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            dm /= n
            gw += grad**2
            gm += dm**2
            w += rate * grad / np.sqrt(gw)
            move += rate * dm / np.sqrt(gm)
    return w, move + move_ok


def viterbi(unary: np.ndarray, move: np.ndarray, first: bool = True, last: bool = True) -> np.ndarray:
    """The best tags; unless it is the ``first`` or ``last`` part of a chain, the token before or after is outside."""
    best, back = unary[0] + (np.array([0, 0, -1e9]) if first else move[OUT]), np.zeros(unary.shape, int)
    for i in range(1, len(unary)):
        x = best[:, None] + move
        back[i] = x.argmax(axis=0)
        best = x.max(axis=0) + unary[i]
    tags = np.zeros(len(unary), int)
    tags[-1] = (best if last else best + move[:, OUT]).argmax()
    for i in range(len(unary) - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def beginnings(text: str) -> list[int]:
    """Where the runs begin that a secret may begin with, in order."""
    out = {m.start() for m in CAPABLE.finditer(text)}
    done = 0
    for m in CREDENTIAL.finditer(text):
        if m.end() > done:
            done = _RUN.match(text, m.end()).end()
            for _, near in zip(range(REACH), TOKEN.finditer(text, done)):
                if not is_mark(near[0]):
                    out.add(near.start())
    return sorted(out)


def _before(text: str, at: int, n: int = 4) -> list[tuple[int, int]]:
    """The last ``n`` tokens that end at ``at`` or before."""
    reach = 64
    while True:
        lo = max(0, at - reach)
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text, lo, at)]
        if lo == 0 or len(found) > n:  # the first may be cut
            return found[-n:]
        reach *= 4


def crf_spans(text: str, weights: tuple[np.ndarray, np.ndarray], taken: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """Secrets by the field that overlap none of the spans in ``taken``."""
    w, move = weights
    out, file, t, done = [], None, 0, 0
    taken = sorted((a, b) for _, a, b in taken)
    starts = beginnings(text)
    can = set(starts)
    for lo in starts:
        if lo < done:
            continue
        file = file or file_features(text)
        places = _before(text, lo)
        known, more = len(places), False
        for m in TOKEN.finditer(text, lo):
            places.append(m.span())
            if len(places) > known + 1 and m.start() not in can and not (m.start() == places[-2][1] and m[0].isascii()):
                more = True
                break
        tokens, glued = [text[a:b] for a, b in places], _glued(places)
        end = len(places) - more
        unary = np.array([w[features(tokens, i, file, glued[i])].sum(axis=0) for i in range(known, end)]) + allowed(tokens, glued)[known:end]
        tags = viterbi(unary, move, known == 0, not more)
        done = places[end - 1][1]
        for a, b in secret_runs(tags, [places[i] for i in range(known, end)], tokens[known:end]):
            while t < len(taken) and taken[t][1] <= a:
                t += 1
            if t == len(taken) or taken[t][0] >= b:
                out.append(("crf", a, b))
    return out


def secret_runs(tags, places: list[tuple[int, int]], tokens: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each begin with its insides; marks at the end, but for ``=`` and password marks, are cut off."""
    out, i = [], 0
    while i < len(tags):
        if tags[i] == BEGIN:
            j = i + 1
            while j < len(tags) and tags[j] == IN:
                j += 1
            end = j
            while end > i + 1 and is_mark(tokens[end - 1]) and tokens[end - 1] not in "=" + _MARKS:
                end -= 1
            out.append((places[i][0], places[end - 1][1]))
            i = j
        else:
            i += 1
    return out


def spans(text: str | None, weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The fixed patterns' spans, and all spans."""
    base = base_spans(text or "")
    more = crf_spans(text or "", weights, _merged(base))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _merged(found):
    out: list[tuple[str, int, int]] = []
    for k, a, b in sorted(found, key=lambda s: s[1]):
        if out and a < out[-1][2]:
            out[-1] = (k, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of (kind, start, end), for every row."""
    weights = trained()  # FEATURES x 3 numbers

    def run(lists):
        for rows in lists:
            yield [(r[0], *([{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans(r[1], weights))) for r in rows]

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; null texts stay null. ``size`` is set to the new length. Texts pass in slices of bounded size."""
    weights = trained()

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                out = []
                for t in part.column(at).to_pylist():
                    kept, end = [], 0
                    for _, a, b in _merged(spans(t, weights)[1]):
                        kept += [t[end:a], mark]
                        end = b
                    out.append("".join(kept) + t[end:] if kept else t)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    prepare(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size in docs.columns else out


def op6(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
