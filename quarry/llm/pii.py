"""PII: a skip-chain conditional random field labels tokens as e-mail, phone, IP address, card, secret, social security number, IBAN or name; redaction.

A token is a run of non-space characters, and every token is a variable of the field. Neighbouring variables share chain potentials, and each
variable shares a skip potential with the next one of the same core text in the document, however far, and, where it has a digit or ``@``, with the next
of the same shape. Labels are the greatest marginals of loopy sum-product belief propagation, run over all
graphs of a batch at once, so a repeated token takes its label from whichever of its places has the telling context.

Messages are passed only where a label can change. A word without digits and ``@`` that is short, not of mixed case and not near a cue ("password", "name",
...), nor repeats a token that is, has features for which outside wins whatever its neighbours are; it enters as that, its potentials
going to its neighbours as evidence (``everything`` keeps all variables; the tests hold one against the other).

Weights are fitted by pseudo-likelihood on generated documents (``training_set``): no table has labels of spans. A number counts as a card only if its
check sum holds, as does an IBAN.

Defined results: null and empty texts stay as they are; a null doc_id is handled as any row; repeated rows are each
redacted alike; ties go to the first of ``LABELS``, that is outside; very long texts are one graph; an empty table gives
an empty table; ``redact`` keeps all columns, with ``n_chars``, where there is one, set to the new length of a changed text.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm._text import _BYTE, as_strings, chunks, mix, raw

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN", "NAME")
NEAR = 4  # tokens after a cue
LONG = 16  # bytes of a token that can be a secret without a digit or a cue
FEATURES = 1 << 14
ROUNDS = 30
_TRIM_LEFT, _TRIM_RIGHT = b"\"'([{<`*_|", b"\"')]}>`*_|.,;:!?#%$&"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HINT = np.zeros(256, bool)
_HINT[48:58] = True
_HINT[64] = True
_LETTER = np.zeros(256, np.uint8)  # of a letter its lower case, else 0
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTERS = np.where(_LETTER > 0, _BYTE[_LETTER], np.uint64(0))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CLASS = re.compile(rb"([0-9]+)|([a-z\x80-\xff]+)|([A-Z]+)|(.)", re.S)
_EMAIL = re.compile(rb"[^\s@<>\"']+@[^\s@<>\"']+\.[A-Za-z]{2,}")
_IP = re.compile(rb"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_HEX = re.compile(rb"[0-9a-fA-F]+")
_IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_KEYISH = re.compile(rb"(?:sk|pk|ghp|gho|akia|xox[bp]|token|key|secret|bearer|api|pass|pwd)[-_A-Za-z0-9]*", re.I)
_KEYVAL = re.compile(rb"[\"']?(?:pass\w*|pwd|secret|token|api[-_]?key|\w+[-_](?:key|token|secret))[\"']?[=:]+[^=:\s]{4,}", re.I)


def _band(n: int) -> int:
    return n if n <= 4 else 5 if n <= 6 else 7 if n <= 9 else 10 if n <= 12 else 13 if n <= 19 else 20 if n <= 31 else 32


def core(token: bytes) -> tuple[int, int]:
    """Where the token's core begins and ends: without quotes, brackets and closing punctuation."""
    a, b = 0, len(token)
    while a < b and token[a] in _TRIM_LEFT and not (token[a] == 40 and b - a > 1):
        a += 1
    while b > a and token[b - 1] in _TRIM_RIGHT and not (token[b - 1] == 41 and 40 in token[a : b - 1]):
        b -= 1
    return a, b


def shape(c: bytes) -> bytes:
    """Runs of digits and letters as their class and banded length, at most 24 of them; other characters as they are."""
    out = []
    for m in _CLASS.finditer(c):
        k = m.lastindex
        out.append(m[0] if k == 4 else b"9aA"[k - 1 : k] + str(_band(m.end() - m.start())).encode())
        if len(out) == 24:
            break
    return b"".join(out)


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = d - 48
        v = v * 2 if i & 1 else v
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _iban(c: bytes) -> bool:
    """The check digits of ISO 13616."""
    return bool(_IBAN.fullmatch(c)) and int("".join(str(int(chr(x), 36)) for x in c[4:] + c[:4])) % 97 == 1


def groups(tokens: list[bytes]) -> bytes:
    """Which kind of number the tokens from the first on make when put together: b"iban", b"card" or b"", and how many tokens, as one byte more."""
    if re.fullmatch(rb"[A-Z]{2}[0-9]{2}", tokens[0]):
        for k in range(len(tokens), 3, -1):
            if _iban(b"".join(tokens[:k])):
                return b"iban" + bytes([k])
    if re.fullmatch(rb"[0-9]{4}", tokens[0]) and len(tokens) > 3:
        whole = b"".join(tokens[:4])
        if re.fullmatch(rb"[0-9]{16}", whole) and _luhn(whole):
            return b"card" + bytes([4])
    return b""


def features(token: bytes, before: tuple[bytes, bytes], after: bytes, part: bytes = b"") -> list[int]:
    """Hashed features of a token in its context: the two tokens before it and the one after; ``part``: of what kind of number in groups it is one."""
    a, b = core(token)
    c = token[a:b]
    digits = bytes(x for x in c if 48 <= x < 58)
    plain = len(digits) == len(c)
    found = ["bias"]
    if digits or b"@" in c:
        found.append(b"shape:" + shape(c))
    else:
        n = _band(len(c))
        case = "cap" if c[:1].isupper() and not any(65 <= x < 91 for x in c[1:]) else "lower" if not any(65 <= x < 91 for x in c) else "upper" if not any(97 <= x < 123 for x in c) else "mixed"
        found += [f"word:{case}", f"{case}{n}"]
    if part:
        found.append(b"part:" + part)
    if _KEYVAL.fullmatch(token):
        found.append("keyval")
    if re.fullmatch(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}", c):
        found.append("ssn")
    if _IBAN.fullmatch(c):
        found.append("iban" if _iban(c) else "noiban")
    bare = c.replace(b"-", b"")
    if not plain and len(digits) == len(bare) and 13 <= len(bare) <= 19:
        found += ["cardlen-", "luhn" if _luhn(bare) else "noluhn"]
    if _EMAIL.fullmatch(c):
        found += ["email", "email+"]  # twice, as what tells most
    elif b"@" in c:
        found.append("at")
    ip = _IP.fullmatch(c)
    if ip:
        found += ["ip", "ip+"] if all(int(x) < 256 for x in ip.groups()) else ["badip"]
    if plain:
        found.append(f"plain{_band(len(c))}")
        if 13 <= len(c) <= 19:
            found += ["cardlen", "luhn" if _luhn(c) else "noluhn"]
    elif not c.translate(None, b"0123456789-().+/ "):
        found.append(f"phonish{min(15, len(digits))}")
    if len(c) >= 16 and _HEX.fullmatch(c) and not plain:
        found.append(f"hex{_band(len(c))}")
    if len(c) >= 16 and not plain and b"@" not in c and b"." not in c and b"/" not in c and re.search(rb"[A-Za-z]", c):
        found.append(f"dense{min(4, len(re.findall(rb'[0-9]+', c)))}")
    if token[:1] in b"\"'" and token[:1]:
        found.append("quoted")
    near = []
    for k, t in (("p", before[1]), ("pp", before[0]), ("n", after)):
        i, j = core(t)
        w = t[i:j] or t
        low = w.lower().strip(b":=.,\"'")
        kind = b"" if not t else b"num:" + shape(w) if re.search(rb"[0-9@]", w) else w.lower() if w in (b"=", b":", b"=>", b"-") or (len(w) <= 12 and _KEYISH.fullmatch(w)) else low if low in _CUES else b"Word" if w[:1].isupper() else b"word"
        near.append(k.encode() + b":" + kind)
    found += near
    size = b"long" if len(c) >= LONG else b"short"
    found += [near[0] + near[1] + size, near[0] + size, near[0] + (b"cap" if c[:1].isupper() else b"low")]
    return [_bucket(x if isinstance(x, bytes) else x.encode()) for x in found]


_SECRET_CUES = {b"password", b"passwd", b"pwd", b"passphrase", b"token", b"secret", b"key", b"apikey", b"bearer", b"credential", b"credentials"}
_NAME_CUES = {b"name", b"mr", b"mrs", b"ms", b"dr", b"prof", b"dear", b"sincerely", b"regards", b"signed", b"patient", b"customer", b"contact"}
_CUES = _SECRET_CUES | _NAME_CUES | {b"phone", b"tel", b"call", b"mobile", b"fax", b"mail", b"email", b"e-mail", b"ip", b"host", b"server", b"card", b"visa", b"ssn", b"social", b"iban", b"account", b"is", b"my", b"version", b"v", b"page", b"isbn", b"order", b"no", b"on", b"at", b"in", b"the", b"id", b"commit", b"sha", b"price"}


def _words(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of the letters of each token in any order, whatever their case and what else is in it; 0 without letters."""
    return np.add.reduceat(_LETTERS[body], start) if len(start) else np.zeros(0, np.uint64)


def _count(marked: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of the ``marked`` bytes (all in tokens, and few) each token has."""
    return np.bincount(np.searchsorted(start, marked, side="right") - 1, minlength=len(start))


def _cue_hashes() -> np.ndarray:
    body = np.frombuffer(b" ".join(sorted(_SECRET_CUES | _NAME_CUES)), np.uint8)
    start = np.append(0, np.flatnonzero(body == 32) + 1)
    return np.sort(_words(body, start))


def _bucket(x: bytes) -> int:
    h = 2166136261
    for v in x:
        h = ((h ^ v) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % FEATURES


@dataclass
class Graph:
    """Variables of some documents: document, token number, span in bytes, features; edges of the three kinds."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feature: np.ndarray | None  # flat
    owner: np.ndarray | None
    chain: np.ndarray  # (n, 2), neighbours in order
    same: np.ndarray
    alike: np.ndarray
    lone: np.ndarray | None  # (variables, 2): whether the token before, after is no variable


def variables(body: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The tokens that can be other than outside: with a digit or ``@``, long, of mixed case, soon after a cue, or a repetition of one of these."""
    if not len(start):
        return np.zeros(0, np.int64)
    upper = _count(np.flatnonzero(_UPPER[body]), start)
    hint = _count(np.flatnonzero(_HINT[body]), start)
    first = _UPPER[body[start]]
    word = _words(body, start)
    pick = (hint > 0) | (end - start >= LONG)
    inner = upper - first
    mixed = (inner > 0) & (end - start >= 8) & (inner < end - start - 2)
    cue = np.isin(word, _cue_hashes())
    assigned = cue & (end - start > 8)  # password:value in one token
    near = np.zeros(len(start), bool)
    for k in range(1, NEAR + 1):
        near[k:] |= cue[:-k] & (row[k:] == row[:-k])
    head = (end - start == 4) & (upper == 2) & (hint == 2)  # of an IBAN in groups
    for k in (1, 2):
        near[k:] |= head[:-k] & (row[k:] == row[:-k])
    pick |= mixed | near | assigned
    again = np.flatnonzero((mixed | near | (end - start >= LONG)) & (hint == 0) & (first | (end - start >= 6)) & (word > 0))
    if len(again):
        key = mix(word ^ row.astype(np.uint64))
        pick |= np.isin(key, key[again])
    return np.flatnonzero(pick)


def graph(part: pa.Array, everything: bool = False) -> tuple[Graph, bytes, np.ndarray]:
    """The graph of a chunk of texts, its bytes, and where each row begins in them. Without ``everything``, of the ``variables``."""
    body, offsets = raw(as_strings(part))
    inside = ~_SPACE[body]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(body)]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    every = np.searchsorted(offsets, start, side="right") - 1
    pick = np.arange(len(start)) if everything else variables(body, offsets, start, end, every)
    row = every[pick]
    text = body.tobytes()
    flat, owner, skey, akey, a0, b0 = [], [], {}, {}, [], []
    same, alike = [], []
    first, last = offsets[row], offsets[row + 1] if len(row) else offsets[:0]
    known: dict[tuple, list[int]] = {}
    part_of: dict[int, bytes] = {}
    for i, (k, r, lo, hi) in enumerate(zip(pick.tolist(), row.tolist(), first.tolist(), last.tolist(), strict=True)):
        s, e = int(start[k]), int(end[k])
        near = [text[start[j] : end[j]] if 0 <= j < len(start) and lo <= start[j] < hi else b"" for j in (k - 2, k - 1, k + 1)]
        token = text[s:e]
        if e - s == 4 and k not in part_of and token.isalnum() and near[2]:
            ahead = [text[start[j] : end[j]] for j in range(k, min(k + 9, len(start))) if start[j] < hi]
            ahead[-1] = ahead[-1].rstrip(b".,;:)")
            made = groups(ahead)
            for j in range(made[-1] if made else 0):
                part_of[k + j] = made[:4]
        key = (token, *near, part_of.get(k, b""))
        f = known.get(key)
        if f is None:
            f = known[key] = features(token, (near[0], near[1]), near[2], key[-1])
        flat += f
        owner += [i] * len(f)
        x, y = core(token)
        a0.append(s + x)
        b0.append(s + y)
        c = token[x:y]
        hinted = b"@" in c or any(48 <= v < 58 for v in c)
        if not hinted and (len(c) < 6 and not c[:1].isupper()):
            continue  # a short word of small letters repeats for no reason
        for kind, seen, out in (((r, c), skey, same), *((((r, shape(c)), akey, alike),) if hinted else ())):
            j = seen.get(kind)
            if j is not None and (out is same or (text[a0[j] : b0[j]] != c and len(c) > 5)):
                out.append((j, i))
            seen[kind] = i
    follows = (np.diff(pick) == 1) & (np.diff(row) == 0) if len(pick) > 1 else np.zeros(0, bool)
    chain = np.flatnonzero(follows)
    # neighbours that aren't variables are outside, as evidence
    has_left, has_right = np.append(False, follows)[: len(pick)], np.append(follows, False)[: len(pick)]
    lone = np.zeros((len(pick), 2), bool)
    if len(pick):
        lone[:, 0] = ~has_left & (pick > 0) & (every[np.maximum(pick - 1, 0)] == row)
        lone[:, 1] = ~has_right & (pick + 1 < len(start)) & (every[np.minimum(pick + 1, len(start) - 1)] == row)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(row, pick, np.array(a0, np.int64), np.array(b0, np.int64), np.array(flat, np.int64), np.array(owner, np.int64), np.stack([chain, chain + 1], 1), pairs(same), pairs(alike), lone), text, offsets


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


@dataclass
class Crf:
    unary: np.ndarray  # (features, labels)
    pair: dict[str, np.ndarray]  # chain, same, alike: (labels, labels)

    def scores(self, g: Graph) -> np.ndarray:
        own = np.stack([np.bincount(g.owner, weights=self.unary[g.feature, k], minlength=len(g.row)) for k in range(len(LABELS))], 1)
        return own + g.lone[:, :1] * self.pair["chain"][0] + g.lone[:, 1:] * self.pair["chain"][:, 0]

    def edges(self, g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From, to and potential of each edge, both ways."""
        a, b, w = [], [], []
        for kind in ("chain", "same", "alike"):
            e, p = getattr(g, kind), self.pair[kind]
            a += [e[:, 0], e[:, 1]]
            b += [e[:, 1], e[:, 0]]
            w += [np.broadcast_to(p, (len(e), *p.shape)), np.broadcast_to(p.T, (len(e), *p.shape))]
        return np.concatenate(a), np.concatenate(b), np.concatenate(w)

    def marginals(self, g: Graph, own: np.ndarray | None = None, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
        """Log marginals by loopy belief propagation; exact where the graph has no loop."""
        own = self.scores(g) if own is None else own
        if not len(own):
            return own
        # edges come in blocks of (there, back) of one kind: where each edge's reverse is
        a, b, w = self.edges(g)
        back = np.empty(len(a), np.int64)
        at = 0
        for kind in ("chain", "same", "alike"):
            n = len(getattr(g, kind))
            back[at : at + n], back[at + n : at + 2 * n] = np.arange(at + n, at + 2 * n), np.arange(at, at + n)
            at += 2 * n
        msg = np.zeros((len(a), len(LABELS)))
        belief = own
        for _ in range(rounds if len(a) else 0):
            new = _logsumexp((belief[a] - msg[back])[:, :, None] + w, axis=1)
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = (1 - damping) * new + damping * msg
            belief = own + np.stack([np.bincount(b, weights=msg[:, k], minlength=len(own)) for k in range(len(LABELS))], 1)
            if moved < 1e-4:
                break
        return belief - _logsumexp(belief, 1)[:, None]

    def label(self, g: Graph) -> np.ndarray:
        """The labels of greatest marginals.

        No message can raise a label over outside by more than its potential's greatest difference. Where a variable's own score is out of reach of all its
        neighbours' messages together it is outside; messages are passed among the others and their neighbours.
        """
        if not len(g.row):
            return np.zeros(0, np.int64)
        own = self.scores(g)
        reach = np.zeros(len(own))
        kinds = ("chain", "same", "alike")
        for kind in kinds:
            e, p = getattr(g, kind), self.pair[kind]
            for at, w in ((e[:, 1], p), (e[:, 0], p.T)):
                reach += np.bincount(at, minlength=len(own)) * max(0.0, float((w[:, 1:] - w[:, :1]).max()))
        open_ = own[:, 0] - own[:, 1:].max(1) <= reach
        keep = open_.copy()
        for kind in kinds:
            a, b = getattr(g, kind).T
            keep[a[open_[b]]] = True
            keep[b[open_[a]]] = True
        out = np.zeros(len(own), np.int64)
        if keep.any():
            new = np.cumsum(keep) - 1
            some = {k: new[getattr(g, k)[keep[getattr(g, k)].all(1)]].reshape(-1, 2) for k in kinds}
            out[keep] = self.marginals(Graph(g.row[keep], g.place[keep], g.start[keep], g.end[keep], None, None, some["chain"], some["same"], some["alike"], None), own[keep]).argmax(1)
        return out


def training_set(n: int = 900, seed: int = 11) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Generated texts, and the byte spans of what is private in each."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = rng.choice
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 11)))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(rng.choices(letters + letters.upper() + "0123456789", k=k))
    octets = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))

    def checked(k: int, good: bool) -> str:
        """A number of ``k`` digits whose check sum holds, or doesn't."""
        head = num(k - 1)
        right = next(d for d in "0123456789" if _luhn((head + d).encode()))
        return head + (right if good else pick([d for d in "0123456789" if d != right]))

    def iban(good: bool) -> str:
        country, rest = pick(["DE", "FR", "GB", "NL", "ES", "IT", "CH"]), pick(["", pick(["ABNA", "WEST", "BARC"])]) + num(rng.randrange(12, 19))
        check = 98 - int("".join(str(int(x, 36)) for x in rest + country + "00")) % 97
        return f"{country}{check if good else (check + 7) % 97:02d}{rest}"

    name = lambda: word().capitalize()
    spaced = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4))
    tagged = lambda text, kind: [(t, kind) for t in text.split(" ")]

    def private() -> list[tuple[str, str]]:
        """Tokens with labels."""
        kind = rng.randrange(8)
        if kind == 0:
            user = pick([word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{word()}", f"{word()}-{num(3)}", f"{word()},{word()}", f"{word()}+{word()}", f"{name()}.{name()}"])
            host = pick([f"{word()}.com", f"{word()}.co.uk", f"{word()}-{word()}.org", f"{word()}.{word()}.net", f"{word()}{num(1)}.{word()}.io"])
            return [*([(pick(["mail", "email", "contact:"]), "O")] if rng.random() < 0.2 else []), (f"{user}@{host}", "EMAIL")]
        if kind == 1:
            return tagged(pick([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"+{num(11)}", f"+1-{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), "PHONE")
        if kind == 2:
            return [*([(pick(["ip", "host", "server"]), "O")] if rng.random() < 0.2 else []), (octets(), "IP")]
        if kind == 3:
            n = checked(rng.randrange(15, 17), True)
            return [*([(pick(["card", "visa"]), "O")] if rng.random() < 0.2 else []), *(tagged(spaced(n), "CARD") if len(n) == 16 and rng.random() < 0.2 else [(spaced(n).replace(" ", "-") if len(n) == 16 and rng.random() < 0.2 else n, "CARD")])]
        if kind == 4:
            return [*([(pick(["ssn", "SSN:"]), "O")] if rng.random() < 0.4 else []), (f"{num(3)}-{num(2)}-{num(4)}", "SSN")]
        if kind == 5:
            x = iban(True)
            return [*([(pick(["IBAN", "iban:", "account"]), "O")] if rng.random() < 0.4 else []), *(tagged(spaced(x), "IBAN") if rng.random() < 0.3 else [(x, "IBAN")])]
        if kind == 6:
            cue = pick([["name", "is"], ["Mr."], ["Mrs"], ["Ms."], ["Dr."], ["Dear"], ["Dear", "Mrs."], ["Dear", "Dr."], ["name:"], ["Name:"], ["Patient"], ["Signed"], ["Contact:"], ["My", "name", "is"], ["Sincerely,"]])
            return [*[(c, "O") for c in cue], *[(name(), "NAME") for _ in range(rng.randrange(1, 3))]]
        letters_only = "".join(word() if small else pick([word(), word().upper(), name()]) for small in [rng.random() < 0.4] for _ in range(rng.randrange(2, 5)))
        key = pick([hexes(2 * rng.randrange(12, 33)), mixed(rng.randrange(20, 44)), mixed(rng.randrange(20, 44)), f"sk-{mixed(32)}", f"ghp_{mixed(36)}", f"AKIA{mixed(16).upper()}", letters_only, letters_only])
        known = key.startswith(("sk-", "ghp_", "AKIA"))
        cue = pick([["token", "="], ["key", "="], ["secret:"], ["password", "="], ["password:"], ["passphrase", "is"], ["api_key", "="], ["token:"]])
        if known and rng.random() < 0.5:
            cue = []
        if cue[:1] and cue[0] in ("password", "password:") and rng.random() < 0.4:
            key = f"{word()}{num(rng.randrange(1, 4))}"
        if not known and rng.random() < 0.25:
            return [(pick(["password=", "pwd:", "secret=", "api_key="]) + key, "SECRET")]
        return [*[(c, "O") for c in cue], (f'"{key}"' if rng.random() < 0.5 else key, "SECRET")]

    def decoy() -> str:
        return pick([num(4), num(2), num(1), f"{num(1)}.{num(1)}.{num(1)}", f"{num(1)}.{num(1)}", f"{num(1)}.{num(2)}", f"{num(2)}.{num(1)}", f"{num(3)}.{num(2)}", f"({num(2)})", f"{num(3)}", f"{num(4)}-{num(4)}", f"{num(2)}:{num(2)}", f"{1900 + rng.randrange(130)}-{num(2)}-{num(2)}", f"${num(2)},{num(3)}.00", f"{num(3)}%", f"{word()}{num(2)}", f"http://{word()}.com/{word()}/{num(3)}", f"@{word()}", f"{word()}@", f"commit {hexes(40)}", f"v{num(1)}.{num(2)}", f"#{num(5)}", f"{num(5)}", f"{num(6)}", f"{num(3)},{num(3)},{num(3)}", f"[{num(1)}]", f"({num(4)})", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(2)}.{num(3)}.{num(1)}.{num(2)}", f"999.{num(3)}.{num(3)}.{num(3)}9", f"{word()}-{num(2)}-{word()}", f"{num(3)}-{num(2)}", f"{num(2)}.{num(4)}", f"x{hexes(6)}",
            checked(16, False), checked(16, False), checked(16, False), checked(15, False), iban(False), f"{num(4)} {num(4)}", f"{name()} {name()}", f"{name()}", word() + word() + word(), f"{name()}-{name()}", word().upper(), f"{word().upper()} {word().upper()}", f"the password {word()}", f"a secret {word()} {word()}", f"a token {word()}", f"the name of {word()}", f"the key {word()}", f"{word()} is {word()}", f"is {name()}", f"is {word()}", f"My {name()}", f"{word().capitalize()}: {word()}", f"= {word()}", f'"{word()}"', f"{word()}_{word()}_{word()}"])

    texts, spans = [], []
    for _ in range(n):
        tokens: list[tuple[str, str]] = []
        seen: list[list[tuple[str, str]]] = []
        for _ in range(rng.randrange(3, 10)):
            tokens += [(word(), "O") for _ in range(rng.randrange(1, 7))]
            u = rng.random()
            if u < 0.45:
                new = private()
                seen.append(new)
                tokens += new
            elif u < 0.6 and seen:
                tokens += [x for x in pick(seen) if x[1] != "O"]
            else:
                tokens += [(x, "O") for x in decoy().split(" ")]
        at, mine, out = 0, [], []
        for t, y in tokens:
            t = t + pick([",", "."]) if rng.random() < 0.06 else t
            if y != "O":
                mine.append((at, at + len(t.encode()), y))
            out.append(t)
            at += len(t.encode()) + 1
        texts.append(pick([" ", " ", "\n"]).join(out))
        spans.append(mine)
    return texts, spans


def truth(g: Graph, offsets: np.ndarray, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    y = np.zeros(len(g.row), np.int64)
    for i, (r, s) in enumerate(zip(g.row.tolist(), g.start.tolist(), strict=True)):
        at = s - int(offsets[r])
        y[i] = next((LABELS.index(k) for a, b, k in spans[r] if a <= at < b), 0)
    return y


def fit(texts: list[str], spans: list[list[tuple[int, int, str]]], epochs: int = 200, rate: float = 0.4, l2: float = 1e-5) -> Crf:
    """Pseudo-likelihood, Adagrad on the full batch: each variable given its neighbours' true labels."""
    g, _, offsets = graph(pa.array(texts, pa.string()), everything=True)
    y = truth(g, offsets, spans)
    k = len(LABELS)
    hot = np.eye(k)
    # many variables have the same features: scores and gradients go by distinct rows
    bounds = np.searchsorted(g.owner, np.arange(len(y) + 1))
    ids: dict[tuple, int] = {}
    which = np.array([ids.setdefault(tuple(g.feature[i:j].tolist()), len(ids)) for i, j in zip(bounds, bounds[1:], strict=False)], np.int64)
    col = np.fromiter((f for x in ids for f in x), np.int64)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    used, col = np.unique(col, return_inverse=True)
    w = {"unary": np.zeros((len(used), k)), **{x: np.zeros((k, k)) for x in ("chain", "same", "alike")}}
    seen = {x: np.full(v.shape, 1e-6) for x, v in w.items()}
    add = lambda at, x, n: np.stack([np.bincount(at, weights=x[:, c], minlength=n) for c in range(k)], 1)
    edges = {x: getattr(g, x) for x in ("chain", "same", "alike")}
    for _ in range(epochs):
        z = add(owner, w["unary"][col], len(ids))[which]
        for kind, e in edges.items():
            z += add(e[:, 0], w[kind].T[y[e[:, 1]]], len(y)) + add(e[:, 1], w[kind][y[e[:, 0]]], len(y))
        d = np.exp(z - _logsumexp(z, 1)[:, None]) - hot[y]
        d /= len(y)
        grad = {"unary": add(col, add(which, d, len(ids))[owner], len(used)) + l2 * w["unary"]}
        for kind, e in edges.items():
            gp = hot[y[e[:, 0]]].T @ d[e[:, 1]] + d[e[:, 0]].T @ hot[y[e[:, 1]]]
            # a skip edge has no direction
            grad[kind] = (gp if kind == "chain" else (gp + gp.T) / 2) + 1e-3 / max(1, len(y)) * w[kind]
        for name, value in w.items():
            seen[name] += grad[name] ** 2
            value -= rate * grad[name] / np.sqrt(seen[name])
    unary = np.zeros((FEATURES, k))
    unary[used] = w.pop("unary")
    return Crf(unary, w)


def train(seed: int = 11, n: int = 1500) -> Crf:
    return fit(*training_set(n, seed))


def entities(model: Crf, column: pa.Array) -> tuple[list[list[tuple[int, int, str]]], list[int]]:
    """Spans in bytes and labels of each row, in order; neighbouring tokens of a number or name in parts are one span."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(column))]
    for at, part in chunks(column):
        g, _, offsets = graph(part)
        y = model.label(g)
        for i in np.flatnonzero(y):
            r, s, e, k = int(g.row[i]), int(g.start[i]), int(g.end[i]), LABELS[y[i]]
            base, mine = int(offsets[r]), out[at + int(g.row[i])]
            if (k in ("PHONE", "NAME") or (k in ("CARD", "IBAN") and e - s <= 4)) and i and y[i - 1] == y[i] and g.place[i - 1] == g.place[i] - 1 and g.row[i - 1] == r and mine:
                mine[-1] = (mine[-1][0], e - base, k)
            else:
                mine.append((s - base, e - base, k))
    return out, [len(x) for x in out]


def _redacted(model: Crf, column: pa.Array) -> tuple[list[str | None], list[list[tuple[int, int, str]]]]:
    found, _ = entities(model, column)
    texts = column.to_pylist() if any(found) else None
    new: list[str | None] = []
    for i, spans in enumerate(found):
        if not spans:
            new.append(None)
            continue
        t, at, out = texts[i].encode(), 0, []
        for a, b, k in spans:
            out += [t[at:a], f"[{k}]".encode()]
            at = b
        new.append(b"".join([*out, t[at:]]).decode())
    return new, found


def redact(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with each entity's text replaced by its label in brackets."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        for b in batches:
            new, found = _redacted(model, b.column(at))
            changed = [i for i, s in enumerate(found) if s]
            if not changed:
                yield b
                continue
            mask = np.zeros(len(b), bool)
            mask[changed] = True
            mask = pa.array(mask)
            columns = list(b.columns)
            columns[at] = pa.compute.replace_with_mask(b.column(at), mask, pa.array([new[i] for i in changed], b.column(at).type))
            if count >= 0:
                columns[count] = pa.compute.replace_with_mask(b.column(count), mask, pa.array([len(new[i]) for i in changed], b.column(count).type))
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema.fields])).toDF(*docs.columns)


def scan(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, text (redacted), entities: label, start and end (bytes of the original text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            column = b.column("text")
            new, found = _redacted(model, column)
            mask = np.array([bool(s) for s in found], bool)
            text = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in np.flatnonzero(mask)], column.type)) if mask.any() else column
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array([[{"label": k, "start": a, "end": e} for a, e, k in s] for s in found], spans)], ["doc_id", "text", "entities"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, entities array<struct<label: string, start: int, end: int>>")
