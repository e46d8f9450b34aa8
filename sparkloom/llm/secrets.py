"""Secret scan: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside
of a secret.

Tokens are runs of [A-Za-z0-9+/_.=-]; what is assigned to a cue word by = is a token of its own. Every token near a cue
word can be a secret, however short or plain. Elsewhere a token of fewer than 8 characters, or without a digit and of
fewer than 20, can only be outside: that is part of the model. So the best path falls apart at such tokens, and Viterbi
runs over each maximal run of the others, with the same result as over the whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

_CHARS = "A-Za-z0-9+/_.=-"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"passw|secret|token|api_?key")
_DIGIT = re.compile(r"[0-9]")
#: Tokens that may be secrets; the first look-behind keeps the search linear in long runs.
_TOKEN = re.compile(rf"(?<![{_CHARS}])(?:(?=[A-Za-z+/_.=-]*[0-9])[{_CHARS}]{{8,}}|[{_CHARS}]{{20,}})")
_ANY = re.compile(rf"[{_CHARS}]+")
#: Cue words, with the rest of their word and the = behind it. Tokens that start so many characters before or after are near.
_CUE = re.compile(r"(?:passw|passphrase|passcode|pwd|secret|token|bearer|credential|api_?key|(?:[_-]|\b(?:access|private|session|signing|encryption|deploy|auth)[ ])key)[A-Za-z_]*(=*)", re.I | re.A)
_NEAR_BEFORE, _NEAR_AFTER = 32, 64
KINDS = ("assign", "access", "hex", "crf")
TAGS = ("O", "B", "I")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, by start, then kind."""
    out = []
    if _HINT.search(text.lower()):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


# --- features -------------------------------------------------------------------------------------------------------

_SIZE = 1 << 13


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % _SIZE


@lru_cache(20_000)
def _slot_of(name: str) -> int:
    return _slot(name)


def shape(token: str) -> str:
    """Characters by kind, runs joined: aA0 and signs as they are; at most 8 runs."""
    out = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", token)))
    return out[:8]


def token_features(token: str) -> list[str]:
    n, counts = len(token), Counter(token)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    core = token.strip("=.-_/+")
    kinds = [k for k, p in (("hex", r"[0-9a-f]+"), ("HEX", r"[0-9A-F]+"), ("digits", r"[0-9.+-]+"), ("upper", r"[A-Z0-9]+"), ("lower", r"[a-z0-9]+"), ("mixed", r"[A-Za-z0-9]+"), ("base64", r"[A-Za-z0-9+/]+=*"), ("url64", r"[A-Za-z0-9_-]+"), ("dotted", r"[\w-]+(\.[\w-]+)+"), ("word", r"[A-Za-z]+[0-9]{0,4}"), ("path", r"[\w.-]*(/[\w.-]+)+"), ("date", r"\d{4}-\d\d-\d\d.*|\d{1,2}/\d{1,2}/\d{2,4}"), ("uuid", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")) if re.fullmatch(p, core)]
    changes = sum((a.isdigit() != b.isdigit()) for a, b in zip(core, core[1:]))
    out = [f"kind:{k}" for k in kinds] + [f"kindlen:{k}:{min(n, 64) // 8}" for k in kinds[:2]]
    out += [f"len:{min(n, 80) // 6}", f"bits:{int(bits * 2)}", f"bitslen:{int(bits * 2)}:{min(n, 48) // 8}", f"changes:{min(changes, 12) // 2}", f"shape:{shape(token)}", f"head:{token[:4]}", f"digits:{int(8 * sum(map(str.isdigit, token)) / n)}", f"upper:{int(8 * sum(map(str.isupper, token)) / n)}"]
    return out


_BEFORE = re.compile(r"([A-Za-z_-]{1,24})?([^A-Za-z0-9\n]{0,6})$")


def cue_features(left: str, token: str, gap: str) -> list[str]:
    """How many words lie between the last cue word before the token and the token, with the signs before it and its form."""
    last = None
    for last in _CUE.finditer(left):
        pass
    if last is None:
        return []
    between = left[last.end() :]
    n, sign = min(6, len(re.findall(r"\w+", between))), next((c for c in ":=" if c in last[1] + between), "")
    form = "".join(k for k, p in (("a", r"[a-z]"), ("A", r"[A-Z]"), ("0", r"[0-9]")) if re.search(p, token[1:])) + ("^" if token[0].isupper() else "")
    size = min(24, len(token)) // 3
    return [f"cue:{n}:{sign}", f"cueform:{n}:{sign}:{form}", f"cuelen:{n}:{sign}:{size}", f"cueformlen:{n}:{sign}:{form}:{size}", f"cuegap:{n}:{sign}:{gap[-2:]}", f"cueword:{n}:{sign}:{token.lower()[:12]}", f"own:{bool(_CUE.match(token))}"]


def context_features(text: str, start: int, end: int) -> list[str]:
    """Neighbouring words and the signs between them and the token."""
    left = text[max(0, start - 48) : start]
    m = _BEFORE.search(left)
    word, gap = (m[1] or "").lower(), m[2]
    before = re.findall(r"[A-Za-z]+", left[: m.start()])[-1:]
    after = re.match(r"([^A-Za-z0-9\n]{0,4})([A-Za-z]{0,16})", text[end : end + 24])
    own = re.sub(r"[^a-z]+", "", word)
    cut = [own[i : i + 4] for i in range(max(0, len(own) - 3))]
    return [f"prev:{own}", f"prev2:{before[0].lower() if before else ''}", f"gap:{gap[-3:]}", f"next:{after[2].lower()[:8]}", f"after:{after[1][:2]}", *(f"in:{c}" for c in cut), *cue_features(left, text[start:end][:64], gap)]


def file_features(text: str, n_tokens: int) -> list[str]:
    """What kind of file the whole text is: the number and share of possible secrets."""
    return [f"file:{min(6, int(math.log2(1 + n_tokens)))}", f"dense:{min(9, int(100 * n_tokens / (1 + len(text) / 6)))}"]


_AROUND = 200


def place_features(text: str, start: int, end: int) -> list[str]:
    """Signs that code and settings have, in and around a run of tokens: a text may be prose in one part and settings in another."""
    around = text[max(0, start - _AROUND) : end + _AROUND]
    return [f"code:{sum(around.count(c) > 2 for c in '={};')}"]


def near_cues(text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Stretches of the text near a cue word, joined where they meet, and the places where a token starts behind =."""
    out: list[tuple[int, int]] = []
    starts, at = set(), 0
    while m := _CUE.search(text, at):
        at = m.end()
        if m[1]:
            starts.add(at)
        a, b = max(0, m.start() - _NEAR_BEFORE), at + _NEAR_AFTER
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out, starts


def possible(text: str) -> list[tuple[int, int]]:
    """Tokens that may be secrets, by their form alone."""
    return [m.span() for m in _TOKEN.finditer(text)] if _DIGIT.search(text) or len(text) >= 20 else []


def tokens_of(text: str) -> list[tuple[int, int]]:
    """possible(text) and every token that starts near a cue word; at = behind a cue word a token is cut in two."""
    found, (near, starts) = set(possible(text)), near_cues(text)
    end = 0
    for a, b in near:
        a = max(a, end)
        if a and _ANY.match(text[a - 1]) and (m := _ANY.match(text, a)):
            a = end = m.end()  # within a token that starts before
        for m in _ANY.finditer(text, a):
            if m.start() >= b:
                break
            found.add(m.span())
            end = m.end()
    if not starts:
        return sorted(found)
    out, cuts = [], sorted(starts)
    for a, b in sorted(found):
        for c in cuts[bisect.bisect_right(cuts, a) : bisect.bisect_left(cuts, b)]:
            out.append((a, c))
            a = c
        out.append((a, b))
    return out


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of the tokens that can be secrets: nothing but signs and white space, and at most 8 of those, lies
    between them."""
    runs: list[list[tuple[int, int]]] = []
    for a, b in tokens_of(text):
        if runs and a - runs[-1][-1][1] <= 8 and not re.search(r"\w", text[runs[-1][-1][1] : a]):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    return runs


def run_slots(text: str, run: list[tuple[int, int]], own_file: list[str]) -> list[np.ndarray]:
    own = [*own_file, *place_features(text, run[0][0], run[-1][1]), "bias"]
    return [np.fromiter(map(_slot_of, [*token_features(text[a:b]), *context_features(text, a, b), *own]), np.int64) for a, b in run]


# --- the model ------------------------------------------------------------------------------------------------------


class Crf:
    """Weights: emit[slot, tag] and move[tag, tag]; an I must follow a B or an I, also after a run's start."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, slots: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[s].sum(0) for s in slots])

    def viterbi(self, slots: list[np.ndarray]) -> list[int]:
        """The tags with the largest sum; of equals, the earlier tag of TAGS."""
        e = self.scores(slots)
        best = e[0] + np.array([0, 0, -1e9]) + self.move[0]
        back = []
        for row in e[1:]:
            total = best[:, None] + self.move + _FORBIDDEN
            back.append(total.argmax(0))
            best = total.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


_FORBIDDEN = np.zeros((3, 3))
_FORBIDDEN[0, 2] = -1e9


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(runs: list[tuple[list[np.ndarray], list[int]]], rounds: int = 8, rate: float = 0.2, ridge: float = 1e-4, seed: int = 3) -> Crf:
    """Stochastic gradient ascent (AdaGrad) on the conditional log-likelihood, by forward and backward sums."""
    emit, move = np.zeros((_SIZE, 3)), np.zeros((3, 3))
    emit_2, move_2 = np.full((_SIZE, 3), 1e-6), np.full((3, 3), 1e-6)
    rng, start = random.Random(seed), np.array([0, 0, -1e9])
    for _ in range(rounds):
        order = list(range(len(runs)))
        rng.shuffle(order)
        for k in order:
            slots, tags = runs[k]
            e, t, n = np.array([emit[s].sum(0) for s in slots]), move + _FORBIDDEN, len(slots)
            alpha, beta = np.zeros((n, 3)), np.zeros((n, 3))
            alpha[0] = e[0] + start + move[0]
            for i in range(1, n):
                alpha[i] = _log_sum(alpha[i - 1][:, None] + t, 0) + e[i]
            for i in range(n - 2, -1, -1):
                beta[i] = _log_sum(t + (e[i + 1] + beta[i + 1])[None], 1)
            z = _log_sum(alpha[-1], 0)
            p = np.exp(alpha + beta - z)
            g_move = np.zeros((3, 3))
            g_move[0] += np.eye(3)[tags[0]] - p[0]
            for i in range(1, n):
                g_move[tags[i - 1], tags[i]] += 1
                g_move -= np.exp(alpha[i - 1][:, None] + t + (e[i] + beta[i])[None] - z)
            g_move -= ridge * move
            move_2 += g_move**2
            move += rate * g_move / np.sqrt(move_2)
            for i, s in enumerate(slots):
                g = np.eye(3)[tags[i]] - p[i] - ridge * emit[s]
                emit_2[s] += g**2
                emit[s] += rate * g / np.sqrt(emit_2[s])
    return Crf(emit, move)


# --- training lines -------------------------------------------------------------------------------------------------

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Words before secrets and before harmless tokens, and prefixes of well-known key formats.
_SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key", "bearer", "credential", "passphrase", "session_key", "signing_key", "webhook_secret", "db_password", "encryption_key"]
_PLAIN_WORDS = ["version", "commit", "sha", "revision", "phone", "tel", "order", "invoice", "date", "ip", "host", "server", "mail", "email", "card", "account", "build", "release", "id", "ticket", "isbn", "model", "checksum", "path", "file", "url", "page", "figure", "call", "address"]
_FUNCTION_WORDS = "the a an of to in for and or is are was must can may will not be by with from on at it this that each every when if has have need needs your their its reset expired holder holders based should used uses after before per".split()
_HARMLESS_VALUES = "required optional none null true false string invalid expired missing see the a not your given always never needed used unknown".split()
_PREFIXES = ["AKIA", "sk-", "ghp_", "xoxb-", "AIza", "glpat-", "SG.", "eyJ"]


def training_lines(n: int = 2500, seed: int = 11, plain: float = 0.0) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts by rule, from a seeded generator, with the spans of their secrets: settings, code, mails and prose with
    invented words. They are no text of any corpus, so n bounds the work of training at any size of input.

    plain: the share of secrets that are short or have no digit; with it, cue words in prose come too."""
    r = random.Random(seed)

    def some(chars: str, a: int, b: int) -> str:
        return "".join(r.choices(chars, k=r.randint(a, b)))

    def word() -> str:
        return some(_LOWER, 2, 9)

    def plain_secret() -> list[str]:
        """Short, or without digits; only a cue word tells it."""
        kind = r.randrange(6)
        if kind == 0:
            return [some(_LOWER, 3, 7) + some(_DIGITS, 1, 3)]
        if kind == 1:
            return ["".join(word().capitalize() for _ in range(r.randint(2, 3)))]
        if kind == 2:
            return [some(_LOWER, 11, 19)]
        if kind == 3:
            return [some(_UPPER + _LOWER, 7, 19)]
        if kind == 4:
            return [some(_UPPER + _LOWER + _DIGITS, 5, 7) + r.choice(_DIGITS)]
        return [some(_UPPER + _DIGITS, 3, 3) + r.choice(_DIGITS) for _ in range(r.randint(2, 6))]

    def after_cue() -> str:
        """Prose behind a cue word: nothing in it is secret."""
        first = r.choice([" ", " ", " ", "s ", ", ", ". ", ": ", " is "])
        if first in (": ", " is "):
            return first + r.choice(_HARMLESS_VALUES) + r.choice([" ", ". ", ", "]) + " ".join(prose() for _ in range(r.randint(0, 4)))
        return first + " ".join(prose() for _ in range(r.randint(1, 6)))

    def prose() -> str:
        return r.choice(_FUNCTION_WORDS) if r.random() < 0.5 else word()

    def secret() -> list[str]:
        if r.random() < plain:
            return plain_secret()
        kind = r.randrange(8)
        if kind == 0:
            return [some("0123456789abcdef", 16, 64)]
        if kind == 1:
            return [r.choice(_PREFIXES) + some(_UPPER + _LOWER + _DIGITS, 16, 36)]
        if kind == 2:
            return ["AKIA" + some(_UPPER + "234567", 16, 16)]
        if kind == 3:
            return [some(_UPPER + _LOWER + _DIGITS + "+/", 24, 60) + "=" * r.randrange(3)]
        if kind == 4:
            return [".".join("eyJ" * (i < 2) + some(_UPPER + _LOWER + _DIGITS + "_-", 12, 40) for i in range(3))]
        if kind == 5:
            return [some(_UPPER + _LOWER + _DIGITS + "_-", 10, 24) + r.choice(_DIGITS)]
        if kind == 6:  # in groups
            return [some("0123456789abcdefABCDEF", 8, 12) + r.choice(_DIGITS) for _ in range(r.randint(2, 4))]
        return [some("0123456789abcdef", 8, 8) + "".join("-" + some("0123456789abcdef", 4, 4) for _ in range(3)) + "-" + some("0123456789abcdef", 12, 12)]

    def harmless() -> str:
        return r.choice(
            [
                lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
                lambda: ".".join(str(r.randint(10, 255)) for _ in range(4)),
                lambda: some(_DIGITS, 10, 16),
                lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}",
                lambda: f"555-{r.randint(1000, 9999)}",
                lambda: f"{word()}.{r.randint(1, 99)}",
                lambda: f"{word()}{r.randint(1, 99)}.{word()}.{r.choice(['com', 'org', 'net'])}",
                lambda: f"{r.randint(1, 30)}.{r.randint(0, 99)}.{r.randint(0, 999)}-rc{r.randint(1, 9)}",
                lambda: f"{word()}/{word()}/{word()}{r.randint(1, 999)}.{r.choice(['html', 'txt', 'py'])}",
                lambda: f"{word()}_{word()}_{r.randint(1, 9999)}",
                lambda: word() + word() + word() + word() + word(),
                lambda: some("0123456789abcdef", 7, 12) if r.random() < 0.3 else f"{word()}{r.randint(1, 9999):04}",
            ]
        )()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 6)):
            text += " ".join(word() for _ in range(r.randint(0, 9)))
            text += r.choice([" ", "\n", ". ", "", ", "]) or " "
            roll = r.random()
            if plain and r.random() < 0.3:
                text += r.choice(_SECRET_WORDS).replace("_", " ") + after_cue() + r.choice(["", ".", ",", "\n"])
            elif roll < 0.4:
                parts = secret()
                bare = len(parts[0]) >= 20 and len(parts) == 1 and r.random() < 0.35
                if not bare:
                    name = r.choice(_SECRET_WORDS)
                    text += (name.upper() if r.random() < 0.2 else name) + r.choice([" = ", "=", ": ", ":", " is ", '="', "='", ' = "', " "])
                for i, p in enumerate(parts):
                    text += " " * (i > 0)
                    spans.append((len(text), len(text) + len(p)))
                    text += p
                text += r.choice(["", '"', "'", ",", ";", "\n"])
            elif roll < 0.9:
                if r.random() < 0.5:
                    text += r.choice(_PLAIN_WORDS) + r.choice([" ", ": ", "=", " is ", " @"])
                text += harmless() + r.choice(["", ",", ".", "\n", ")"])
            text += " "
        out.append((text, spans))
    return out


def labelled_runs(lines) -> list[tuple[list[np.ndarray], list[int]]]:
    """A group of tokens in one secret is B I I; a single token is B."""
    out = []
    for text, spans in lines:
        runs = runs_of(text)
        own = file_features(text, len(possible(text)))
        for run in runs:
            tags, last = [], -2
            for a, b in run:
                hit = next((i for i, (s, e) in enumerate(spans) if a < e and s < b), None)
                tags.append(0 if hit is None else 2 if hit == last + 1 and tags and tags[-1] and spans[hit][0] - spans[last][1] == 1 else 1)
                last = hit if hit is not None else -2
            out.append((run_slots(text, run, own), tags))
    return out


@lru_cache(1)
def trained(n: int = 2500) -> Crf:
    return train(labelled_runs(training_lines(n) + training_lines(n // 2, 12, 0.6)))


# --- scanning -------------------------------------------------------------------------------------------------------


def crf_spans(text: str, model: Crf) -> list[tuple[int, int]]:
    runs = runs_of(text)
    if not runs:
        return []
    own, out = file_features(text, len(possible(text))), []
    for run in runs:
        for tag, (a, b) in zip(model.viterbi(run_slots(text, run, own)), run):
            if tag == 1:
                out.append((a, b))
            elif tag == 2:
                out[-1] = (out[-1][0], b)
    return out


def all_spans(text: str, model: Crf) -> tuple[list, list]:
    """Base spans, and all spans: to them are added those of the model that touch none of them."""
    base = base_spans(text)
    merged = joined_spans(base)
    starts, more = [s for s, _ in merged], []
    for a, b in crf_spans(text, model):
        k = bisect.bisect_left(starts, b)  # the last stretch that begins before b, if any, is the one that may touch
        if not k or merged[k - 1][1] <= a:
            more.append((a, 3, b))
    return base, sorted(base + more)


def joined_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches that spans, sorted by start, cover; apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(model: Crf):
    def run(batches):
        common.held("secrets")
        for batch in batches:
            found = [all_spans(t.as_py() or "", model)[1] for t in batch.column("_text")]
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.list_(_SPAN))], names=[*names, "spans"])

    return run


def scan(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), model: Crf | None = None) -> DataFrame:
    """keep's columns and spans array<struct<kind, start, end>> for each row, by start, then kind.

    Places are code points, end exclusive. Null and empty texts have no spans; repeated rows are each answered; an
    empty table gives none. A column of keep called spans is left out, other columns are not read. The model is fitted
    on training_lines() where none is given.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(*(c for c in keep if c != "spans"), F.col(text_column).alias("_text"))
    schema = rows.drop("_text").withColumn("spans", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")).schema
    return rows.mapInArrow(_scan(model or trained()), schema)


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]", model: Crf | None = None) -> DataFrame:
    """The rows of docs, all columns, with each span's characters in the text replaced by mark, overlapping spans by one.

    Null texts stay null, repeated rows are each answered, an empty table stays empty.
    """
    common.ship(docs.sparkSession)
    model, at = model or trained(), docs.columns.index(text_column)

    def run(batches):
        common.held("secrets")
        for batch in batches:
            new = [t if t is None else _redacted(t, all_spans(t, model)[1], mark) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += (text[at:s], mark)
        at = max(at, e)
    return "".join([*out, text[at:]])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of all documents, whole texts; a row for each document, null and empty texts without spans."""
    found = scan(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("crf").alias("n_crf"))
