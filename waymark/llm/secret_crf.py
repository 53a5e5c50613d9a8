"""Secret scans by fixed patterns and a linear-chain conditional random field.

Tokens are runs between ASCII white space, tagged B (a secret begins), I (goes on) or O by a CRF over the token's
shape, its neighbours' words and features of the file, decoded by Viterbi. The model is trained here, by gradient
ascent on the likelihood, on ``TRAIN_WINDOWS`` generated windows (a fixed seed): no corpus pass, the same model for
every input. Tagged tokens, less quotes and brackets around them, are spans of kind ``crf``, but for the parts that a
base span covers.

Decoding is exact and fast: for a token whose O score beats the best that context and transitions could ever give to
B or I, O is certain. These certain tokens cut the chain, and Viterbi runs on what lies between. No rule but the scores
says that a token is O.

Defined results: a null or empty text has no spans (hash of the empty string); rows with a null ``doc_id``, repeated rows
and ids are scanned each; work grows with a text's length, so very long ones are taken whole; further columns, whatever
their names, are kept by ``redact`` and ignored by ``scan``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# The base patterns, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

KEYWORDS = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential|auth|bearer|private|access|key)", re.IGNORECASE | re.ASCII)
KNOWN = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|eyJ|AIza|ya29\.)")
CORE = re.compile(r"[A-Za-z0-9+/_.=~-]+")
TRAIN_WINDOWS, WINDOW, STEPS = 3000, 16, 100
KEPT_WORDS, KEPT_SHAPES = 200_000, 50_000
B, I, O = 0, 1, 2  # noqa: E741
OWN, NEAR, PAIR, FILE = 44, 12, 4, 4  # numbers of features


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# --- features -----------------------------------------------------------------------------------------------------


_CHANGE = re.compile(r"(.)(?=(?!\1).)")
_CLOG = [0.0, 0.0, *(c * math.log2(c) for c in range(2, 4096))]
SIGNS = frozenset(("=", ":", ":=", "=>", "->"))
HEX_DIGITS = "0123456789abcdefABCDEF-"
#: One of these, in lower case, is in every match of KEYWORDS.
KEY_PARTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth", "bearer", "private", "access", "key")


class _Shapes(dict):
    """Code point -> 0 for ASCII digits, A and a for letters, é and ² for letters and digits beyond ASCII, € for others there."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if point < 128:
            self[point] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
        else:
            return "é" if c.isalpha() else "²" if c.isdigit() else "€"
        return self[point]


_SHAPES = _Shapes()


def shape(word: str) -> str:
    """The word's kinds of signs; ASCII signs other than letters and digits stay."""
    return word.translate(_SHAPES)


def shape_features(shape: str) -> tuple[int, int, list[int], list[int]]:
    """What the shape alone tells: start and end of the token's core, own and near features."""
    at = max((m.span() for m in CORE.finditer(shape)), key=lambda x: x[1] - x[0], default=(0, 0))
    core, bare = shape[at[0] : at[1]], shape.strip(_MARKS)
    n, digits, upper, lower = len(core), core.count("0"), core.count("A"), core.count("a")
    f = [min(n // 4, 9)]  # 0-9
    f.append(10 + (0 if not digits else 1 if digits * 5 < n else 2 if digits * 2 < n else 3 if digits < n else 4))
    f.append(15 + (bool(upper) + 2 * bool(lower)))
    f.append(19 + min(len(_CHANGE.findall(re.sub("[^0A]", "-", core))) // 2, 5))  # 19-24
    f += [i for i, on in ((31, "://" in shape or "@" in shape), (32, n < len(shape) - 4), (34, core.count(".") > 1), (36, "=" in shape or ":" in shape), (37, not shape.isascii()), (38, "-----" in shape), (39, n >= 16 and digits > 1 and upper + lower > 3), (40, bare.isalpha()), (41, n < 6), (42, n + 2 < len(bare)), (43, shape[:1] in "\"'`")) if on]
    near = [0 if shape.isalpha() else 1]
    near += [i for i, on in ((3, shape in SIGNS), (4, shape.endswith((":", "="))), (5, "-----" in shape), (7, len(shape) > 24), (8, "0" in shape or "²" in shape)) if on]
    return *at, f, near


def word_code(word: str, core: str, keyed: bool = True) -> int:
    """What the word tells beyond its shape, as a number: entropy of its core (0-4), then one bit each for a known
    beginning, hexadecimal digits alone, a keyword (never without ``keyed``), and two short lists."""
    n = len(core)
    if n < 2:
        code = 0
    elif n >= len(_CLOG):
        code = 4
    elif len(set(core)) == n:
        code = min(int(math.log2(n) + 1e-9), 4)
    else:
        code = min(int(math.log2(n) - sum([_CLOG[c] for c in Counter(core).values()]) / n + 1e-9), 4)
    if n > 2 and KNOWN.match(core):
        code += 8
    if not core.strip(HEX_DIGITS):
        code += 16
    if keyed and KEYWORDS.search(word):
        code += 32
    if len(word) < 4:
        low = word.lower()
        code += 64 * (low in ("is", "the", "my")) + 128 * (low in ("is", "was", "set", "to"))
    return code


def code_features(code: int) -> tuple[list[int], list[int]]:
    """Own and near features of a code."""
    own = [25 + code % 8, *(f for f, bit in ((30, 8), (33, 16), (35, 32)) if code & bit)]
    return own, [f for f, bit in ((2, 32), (6, 64)) if code & bit]


def own_features(word: str) -> list[int]:
    """A token's shape and letters: indexes below OWN."""
    a, z, own, _ = shape_features(shape(word))
    return own + code_features(word_code(word, word[a:z]))[0]


def near_features(word: str) -> list[int]:
    """What a token tells of its neighbour: indexes below NEAR."""
    a, z, _, near = shape_features(shape(word))
    return near + code_features(word_code(word, word[a:z]))[1]


def flags(word: str) -> tuple[bool, bool, bool, bool]:
    """Keyword, sign of assignment, word of statement, letters alone."""
    return bool(KEYWORDS.search(word)), word in SIGNS, word.lower() in ("is", "was", "set", "to"), word.isalpha()


def pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """The PAIR features of flags (tokens, 4) of the two tokens before."""
    key, sign = first[:, 0], second[:, 1]
    return key & sign, key & second[:, 2], sign & ~key, key & second[:, 3]


def file_features(text: str) -> list[int]:
    """What a file tells of all its tokens: indexes below FILE."""
    return [i for i, on in enumerate((True, "=" in text, "{" in text or ";" in text, text.count("\n") * 40 > len(text))) if on]


# --- training -----------------------------------------------------------------------------------------------------


def _generated(rng: random.Random) -> tuple[list[str], list[int]]:
    """One window of tokens with tags."""
    syllables = ["th", "er", "on", "an", "re", "ou", "ing", "de", "le", "ment", "tion", "ei", "ch", "qu", "es", "la", "ción", "è", "ü", "é"]
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def plain() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
        k = rng.random()
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 16)))
        if k < 0.70:
            return rng.choice([w, w.capitalize(), w + rng.choice(".,;:!?")])
        return rng.choice([w.upper() + "!!", w + rng.choice(["***", "&&&", "$$$", "###", "%%%"]), "|", digits, f"{w}.{w}{rng.randint(1, 99)}@{w}.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), f"https://{w}.org/{w}/{digits}?a={w}", "+" + digits, f"{w}-{w}", f"({w})", f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", w * 3, "Copyright", "MIT", "License:", "the", "of", "=", "password", "token", "key"])

    def secret(after_key: bool) -> str:
        size = rng.randint(6, 44) if after_key else rng.randint(12, 44)
        body = "".join(rng.choice(alnum) for _ in range(size))
        kind = rng.randint(0, 9)
        if kind == 0:
            return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40, 64])))
        if kind == 1:
            return rng.choice(["AKIA", "ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "AIza", "eyJ"]) + (body if rng.random() < 0.7 else "".join(rng.choice(alnum[:52]) for _ in range(rng.randint(10, 30))))
        if kind == 2:
            return "".join(rng.choice(alnum + "+/") for _ in range(size)) + "=="
        if after_key and kind < 6:  # what people choose: letters, often with digits or marks behind or between
            w = "".join(rng.choice(syllables[:16]) for _ in range(rng.randint(2, 5)))[:15].ljust(6, "x")
            tail = "".join(rng.choice("0123456789!$#@%&*_-") for _ in range(rng.randint(0, 5)))
            return rng.choice([w, w.capitalize(), w + rng.choice("XYZAB") * 2]) + tail
        if kind == 7:
            return body[: size // 2] + rng.choice("$!@#%^&*") + body[size // 2 :]
        return body

    words = [plain() for _ in range(WINDOW)]
    tags = [O] * WINDOW
    if rng.random() < 0.6:
        i = rng.randint(4, WINDOW - 3)
        lead = rng.choice([[], [], ["password", "="], ["token", "="], ["api_key:"], ["secret", ":"], ["key", "is"], ["Bearer"], ["auth", "token"], ["the", "password", "is"], ["DB_PASSWORD", "="], ["passwd:"], ["my", "pwd:"], ["private", "key", ":"]])
        words[i - len(lead) : i] = lead
        wrap = rng.choice(["{}", '"{}"', "'{}'", "{},", "{}."])
        words[i], tags[i] = wrap.format(secret(bool(lead))), B
        if rng.random() < 0.15:  # a secret over two tokens
            words[i + 1], tags[i + 1] = secret(bool(lead)), I
    elif rng.random() < 0.5:  # the words around secrets, without one
        i = rng.randint(3, WINDOW - 3)
        common = rng.choice(["required", "empty", "wrong", "the", "of", "and", "for", "holder", "ring", "a", "not", "reset", "manager", "field", "words", "strong"])
        lead = rng.choice([["the", "password", "is", common], ["a", "secret", common], ["token", common], ["key", "=", "value"], ["x", "=", plain()], ["name", ":", plain()], ["the", "key", "to"], ["private", common], ["access", common], ["note", ":", common], ["secret", ":", common], ["api_key", "is", common]])
        words[i - len(lead) + 1 : i + 1] = lead
    return words[:WINDOW], tags


@lru_cache(maxsize=1)
def train() -> dict[str, np.ndarray]:
    """Weights of the CRF: own (OWN, 3), before and after (NEAR, 3), pair (PAIR, 3), file (FILE, 3), step (3, 3), from training."""
    rng = random.Random(20240607)
    data = [_generated(rng) for _ in range(TRAIN_WINDOWS)]
    n, size = TRAIN_WINDOWS, OWN + 2 * NEAR + FILE + PAIR
    x = np.zeros((n, WINDOW, size), np.float32)
    y = np.array([t for _, t in data])
    for a, (words, _) in enumerate(data):
        file = file_features(" ".join(words))
        for t, w in enumerate(words):
            x[a, t, own_features(w)] = 1
            x[a, t, [OWN + 2 * NEAR + f for f in file]] = 1
            if t:
                x[a, t, [OWN + f for f in near_features(words[t - 1])]] = 1
            if t > 1:
                on = pairs(np.array([flags(words[t - 2])]), np.array([flags(words[t - 1])]))
                x[a, t, [OWN + 2 * NEAR + FILE + f for f in range(PAIR) if on[f][0]]] = 1
            if t + 1 < WINDOW:
                x[a, t, [OWN + NEAR + f for f in near_features(words[t + 1])]] = 1
    flat = x.reshape(-1, size)
    w, step = np.zeros((size, 3)), np.zeros((3, 3))
    gold_w = flat.T @ np.eye(3)[y.ravel()]
    gold_step = np.zeros((3, 3))
    np.add.at(gold_step, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    seen_w, seen_step = np.zeros_like(w), np.zeros_like(step)
    for _ in range(STEPS):
        e = (flat @ w).reshape(n, WINDOW, 3)
        lse = lambda z, axis: (m := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis=axis))
        f, b = np.empty_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, WINDOW):
            f[:, t] = e[:, t] + lse(f[:, t - 1, :, None] + step, 1)
        for t in range(WINDOW - 2, -1, -1):
            b[:, t] = lse(step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        total = lse(f[:, -1], 1)
        p = np.exp(f + b - total[:, None, None])
        pair = sum(np.exp(f[:, t, :, None] + step + (e[:, t + 1] + b[:, t + 1])[:, None, :] - total[:, None, None]).sum(axis=0) for t in range(WINDOW - 1))
        g_w, g_step = (gold_w - flat.T @ p.reshape(-1, 3)) / n - 0.002 * w, (gold_step - pair) / n - 0.002 * step
        seen_w, seen_step = seen_w + g_w**2, seen_step + g_step**2
        w, step = w + 0.5 * g_w / np.sqrt(seen_w + 1e-8), step + 0.5 * g_step / np.sqrt(seen_step + 1e-8)
    return {"own": w[:OWN], "before": w[OWN : OWN + NEAR], "after": w[OWN + NEAR : OWN + 2 * NEAR], "file": w[OWN + 2 * NEAR : OWN + 2 * NEAR + FILE], "pair": w[OWN + 2 * NEAR + FILE :], "step": step}


# --- decoding -----------------------------------------------------------------------------------------------------


class Words(dict):
    """word -> its class: words of one shape and code have the same features, so a class has what they add to the scores
    of B and I (own, before, after) and their flags. Words and classes are both bounded."""

    def __init__(self, rel: dict[str, np.ndarray]) -> None:
        super().__init__()
        self.tables = [rel[k].tolist() for k in ("own", "before", "after")]
        self.scores, self.flags = np.zeros((1 << 12, 6)), np.zeros((1 << 12, 4), bool)
        self.shapes: dict[str, tuple[int, int, list[int], list[int]]] = {}
        self.classes: dict[tuple[str, int], int] = {}
        self.keyed = True  # whether the text in hand may hold a keyword

    def _class(self, of: str, code: int) -> int:
        at = self.classes[of, code] = len(self.classes)
        if at == len(self.scores):
            self.scores, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.flags))
        _, _, own, near = self.shapes[of]
        more_own, more_near = code_features(code)
        both = (own + more_own, near + more_near, near + more_near)
        self.scores[at] = [sum([table[f][k] for f in on]) for table, on in zip(self.tables, both, strict=True) for k in (B, I)]
        self.flags[at] = bool(code & 32), of in SIGNS, bool(code & 128), of.isalpha()
        return at

    def __missing__(self, word: str) -> int:
        of = word.translate(_SHAPES)
        kept = self.shapes.get(of)
        if kept is None:
            kept = self.shapes[of] = shape_features(of)
        code = word_code(word, word[kept[0] : kept[1]], self.keyed)
        at = self.classes.get((of, code))
        at = self[word] = self._class(of, code) if at is None else at
        return at


class Tagger:
    """Viterbi over a text's tokens, with certain tokens as cuts. Scores are taken against that of O."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        w = {k: np.asarray(v) for k, v in weights.items()}
        self.rel = {k: (m - m[:, O : O + 1])[:, :O] for k, m in w.items() if k != "step"}
        self.step = step = w["step"]
        # a best path has no B (I) where O in its place would score more, whatever the tags beside it
        self.turn = np.array([max(0.0, (step[:, k] - step[:, O]).max()) + max(0.0, (step[k] - step[O]).max()) for k in (B, I)])
        self.words = Words(self.rel)

    def emissions(self, words: list[str], file: list[int], text: str | None = None) -> np.ndarray:
        """(tokens, 2): scores of B and I."""
        if len(self.words) > KEPT_WORDS or len(self.words.shapes) > KEPT_SHAPES:
            self.words = Words(self.rel)
        low = " ".join(words).lower() if text is None else text.lower()
        self.words.keyed = any(part in low for part in KEY_PARTS)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        x, on = self.words.scores[at], self.words.flags[at]
        e = x[:, 0:2] + self.rel["file"][file].sum(axis=0)
        e[1:] += x[:-1, 2:4]
        e[:-1] += x[1:, 4:6]
        if len(words) > 2 and on[:, :2].any():
            first, second = on[:-2], on[1:-1]
            for k, hit in enumerate(pairs(first, second)):
                e[2:][hit] += self.rel["pair"][k]
        return e

    def viterbi(self, e: np.ndarray, begins: bool, ends: bool) -> list[int]:
        """Best tags of a run; begins/ends: a certain O stands before/after it."""
        step = self.step
        best = e[0] + (step[O] if begins else 0)
        back = []
        for t in range(1, len(e)):
            to = best[:, None] + step
            back.append(to.argmax(axis=0))
            best = to.max(axis=0) + e[t]
        if ends:
            best = best + step[:, O]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, words: list[str], file: list[int], text: str | None = None) -> dict[int, int]:
        """The tokens that aren't O, with their tags."""
        e = self.emissions(words, file, text)
        open_ = np.flatnonzero((e + self.turn >= 0).any(axis=1))
        out: dict[int, int] = {}
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            scores = np.c_[e[run], np.zeros(len(run))]
            for t, tag in zip(run.tolist(), self.viterbi(scores, run[0] > 0, run[-1] + 1 < len(words)), strict=True):
                if tag != O:
                    out[t] = tag
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, 3, end) of the tagged secrets."""
        words = _words(text)
        tags = self.tags(words, file_features(text), text) if words else {}
        if not tags:
            return []
        tagged: list[list[int]] = []
        for t, tag in tags.items():
            if tag == I and tagged and tagged[-1][1] == t:
                tagged[-1][1] = t + 1
            else:
                tagged.append([t, t + 1])
        at, out = [m.span() for m in _WORD.finditer(text)], []
        for a, z in tagged:
            cores = [m.span() for m in CORE.finditer(text, at[a][0], at[z - 1][1])]
            if cores:
                out.append((cores[0][0], 3, cores[-1][1]))
        return out


_MARKS = ".,;:!?\"'()[]{}<>*&$%#|-"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# white space to str.split() that isn't in _WORD's class
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _words(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def all_spans(text: str, tagger: Tagger) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): what the CRF adds are the parts of its spans that no base span covers."""
    base = base_spans(text)
    more = []
    k, covered = 0, 0  # base spans by start; ``covered``: the furthest end of those passed
    for s, kind, e in tagger.spans(text):
        while k < len(base) and base[k][0] <= s:
            covered = max(covered, base[k][2])
            k += 1
        at = max(s, covered)
        j = k
        while j < len(base) and base[j][0] < e:
            if base[j][0] > at:
                more.append((at, kind, base[j][0]))
            at = max(at, base[j][2])
            j += 1
        if at < e:
            more.append((at, kind, e))
    return base, sorted(base + [x for x in more if CORE.search(text, x[0], x[2])])


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_TAGGERS: dict[bytes, Tagger] = {}


def _tagger(weights: dict[str, np.ndarray]) -> Tagger:
    """One tagger for a worker process and all its tasks: it keeps the scores of words met."""
    key = hashlib.sha256(b"".join(weights[k].tobytes() for k in sorted(weights))).digest()
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(weights)
    return _TAGGERS[key]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text, and n_crf."""
    weights = train()

    def run(batches):
        tagger = _tagger(weights)
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, joined = [], []
            for text in b.column(1):
                base, spans = all_spans(text.as_py() or "", tagger)
                kinds = [k for _, k, _ in spans]
                for k in range(4):
                    counts[k].append(kinds.count(k))
                sha.append(hashlib.sha256(_join(base).encode()).hexdigest())
                joined.append(_join(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(counts[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every span of ``text`` replaced by ``mask``; overlapping spans become one. Null stays null."""
    weights, where = train(), docs.columns.index("text")

    def run(batches):
        tagger = _tagger(weights)
        for b in batches:
            out = []
            for x in b.column(where):
                text = x.as_py()
                if text:
                    end, parts, at = -1, [], 0
                    for s, _, e in all_spans(text, tagger)[1]:
                        if s >= end:
                            parts += [text[at:s], mask]
                        end = max(end, e)
                        at = end
                    text = "".join(parts) + text[at:] if parts else text
                out.append(text)
            yield b.set_column(where, b.schema.names[where], pa.array(out, pa.string()))

    return map_texts(docs, run, docs.schema)
