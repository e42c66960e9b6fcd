"""Personal data in texts: patterns, and a conditional random field over word shapes.

Four kinds have base patterns with checks (``base_spans``).  They miss what is
written another way or runs into its neighbour: a telephone number without a plus,
one followed by an address, two card numbers side by side.  A linear-chain
conditional random field adds those.  Its tokens are runs of letters, runs of digits
and single other characters; its features are the shapes of a token and of those
around it, lengths of neighbouring digit runs, whether digits sum up as a card's or
make a dotted quad, how many digits there are together, and the word before.  It is
trained by penalised likelihood from ``LABELLED``, a small table of marked lines.

Decoding is exact over the whole text: tokens of words without a digit or an at-sign
can only be outside, so they split the chain, and the best path is found for each
island of other words, many islands at a time.  Spans of the field count if they pass
their kind's check and touch no base span; base spans always stay.

Defined cases: a null or empty text has no spans; positions are code points, ends
exclusive; rows that share an id, or have none, keep a row each; very long texts
count whole, and patterns take time in proportion to them; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: The training table: lines with marked spans.  Card numbers are the card companies'
#: published test numbers, telephone numbers and addresses lie in ranges kept for examples.
LABELLED = """\
call me at <phone>+1 (743) 555-3824</phone> today
reach us on <phone>(743) 555-0182</phone> or by post
phone <phone>743-555-0199</phone>, room 12
tel. <phone>212.555.0123</phone> before 5
fax <phone>(212) 555-0147</phone> 2 pages
my number is <phone>555 0100 200</phone> since 2019
ring <phone>020 7946 0958</phone> in the week of 14 may
Tel <phone>030 2345 67890</phone> ab 9 Uhr
Telefon <phone>0049 30 234567</phone> oder 10 Mails
llame al <phone>(415) 555-0133</phone> 24 horas
le <phone>01 99 00 12 34</phone> de 8 à 18
numero <phone>+33 1 99 00 12 34</phone> poste 7
<phone>+1 (826) 555-4081</phone> <ip>190.137.223.204</ip> seen twice
<phone>+1 (826) 555-4081</phone> <card>4111111111111111</card> paid
<phone>+1 (826) 555-4081</phone> <phone>+1 (743) 555-3824</phone> both
<ip>190.137.223.204</ip> <phone>+1 (826) 555-4081</phone> late
<ip>10.0.0.1</ip> <ip>192.168.1.254</ip> routed
<phone>(826) 555-4081</phone> <phone>(743) 555-3824</phone> both
paid with <card>4242 4242 4242 4242</card> in 2023
card <card>5555-5555-5555-4444</card> exp 11/27
card <card>4111111111111111</card> <card>4242424242424242</card> twice
<card>5105105105105100</card> <card>4111111111111111</card> <card>4242424242424242</card> thrice
<card>378282246310005</card> <card>6011111111111117</card> refused
amex <card>3782 822463 10005</card> cvc 123
visa <card>4222222222222</card> old
<card>4242.4242.4242.4242</card> by dots
<card>4111111111111111</card> <ip>203.0.113.77</ip> logged
<ip>203.0.113.77</ip> <card>4111111111111111</card> logged
<card>4111111111111111</card> <phone>+1 (743) 555-3824</phone> logged
<card>6011111111111117</card>, <card>3530111333300000</card>
number 9807915762804490 is no card
number 9000426309966109 nor 1232810148878564 are cards
9807915762804490 1232810148878564 in order
order 4438189355774160 of 2021
order 48291034 was sent on 2024-03-01
from <ip>203.0.113.77</ip> at 10:30:15
host <ip>198.51.100.23</ip>:8080 down
<ip>198.51.100.23</ip>, <ip>203.0.113.77</ip>
version 4.0.1 and 2.10.3 and 1.2
licensed under CC BY-NC 4.0.
the GNU General Public License, version 3.
release 999.12.300.1 is no address
mail <email>jane.doe@example.com</email> or 2 others
write to <email>26@mail6.example.com</email> of
e-mail: <email>ops+alerts@example.co.uk</email>;
(<email>a_b@example.org</email>)
<email>jane.doe@example.com</email>,<email>joe@example.com</email>
<email>jane.doe@example.com</email> <phone>(743) 555-0182</phone> and 3
<email>müller@example.de</email> schrieb 2 mal
an <email>josé.núñez@example.es</email> el 3
@home we sat 4 hours
follow @handle and @other2
root@localhost logged in
5@ each, 10 @ 3.50
token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" found
sha 9233A8ECF7C5B09FE5949719B6B82BC439E9329B
id 550e8400-e29b-41d4-a716-446655440000 of the run
isbn 978-3-16-148410-0 and 0-306-40615-2
in 1999, 2004 and 2010 we had 3
pages 102-119, 340-352 of vol. 12
on 12.05.2024 and 1.6.2024 at 8.30
costs $1,299.00 or 1.299,00 EUR
scores 3-2, 1-0 and 10-9
from 1939-1945 to 1989-1991
2024-01-15 10:22:33 INFO 200 OK 512
lat 52.5200 lon 13.4050
1 2 3 4 5 6 7 8 9 10 11 12
10 20 30 40 50 60 70 80
100 200 300 400 500 600
1000 2000 3000 4000
3.14159265358979 and 2.71828182845905
row 17 | 23 | 4.5 | 6e10
12345678901234567890123456789012 long
part no 123-456-789012 rev 3
zip 10115 or 12345-6789
tax 12 345 678 of 2020
""".splitlines()

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Digits and what joins them are different characters, so that no match begins within
# a run of digits, gives back what it took, or is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]*+")


def luhn(digits: str) -> bool:
    """Whether digits carry the check digit of card numbers."""
    d = [ord(x) - 48 for x in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def passes(kind: str, found: str) -> bool:
    """The check of a kind."""
    if kind == "email":
        local, _, host = found.partition("@")
        return bool(local) and "." in host.strip(".") and "@" not in host
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and 0 <= int(x[-4:] or 256) <= 255 for x in parts)
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by start and kind."""
    out: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        local = text[free:at]
        start = at - (len(local) - len(local.rstrip(_LOCAL)))
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if passes("ip", m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and passes("card", m[0])]
    if "+" in text:
        for m in _PHONE.finditer(text):
            found = m[0].rstrip(" ().-")
            if passes("phone", found):
                out.append(("phone", m.start(), m.start() + len(found)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Tokens: classes of characters, and shapes made of them.
_SPACE, _DIGIT, _LOWER, _UPPER, _MARK, _OTHER = range(6)
_CLASSES = np.full(128, _MARK, np.uint8)
_CLASSES[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASSES[48:58], _CLASSES[97:123], _CLASSES[65:91] = _DIGIT, _LOWER, _UPPER
_WIDE_SPACES = np.array([0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x3000], np.uint32)
_LONGEST = 20
_SHAPE_OF_MARK = np.full(128, _LONGEST + 38, np.int64)
_SHAPE_OF_MARK[[ord(x) for x in string.punctuation]] = _LONGEST + 6 + np.arange(32)
_SHAPES = 2 * (_LONGEST + 39)  # with and without a space before; 0 beyond the island
_SIZES = {"shape": _SHAPES, "before": _SHAPES, "after": _SHAPES, "before2": _SHAPES, "after2": _SHAPES, "pair": _SHAPES**2, "next_pair": _SHAPES**2, "runs": (_LONGEST + 1) ** 3, "quad": 3, "sum": 3, "small": 2, "at": 3, "together": 6, "always": 1}
_OFFSETS = dict(zip(_SIZES, np.concatenate([[0], np.cumsum(list(_SIZES.values()))[:-1]]).tolist(), strict=True))
_CUES_AT = sum(_SIZES.values())
LABELS = ("O", *(f"{at}-{kind}" for kind in KINDS for at in "BI"))


class Tokens:
    """Tokens of the words with a digit or an at-sign in some texts, in islands of
    words with one space between them."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.text = "\n".join(texts) + "\n"
        points = np.frombuffer(self.text.encode("utf-32-le", "replace"), np.uint32)
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        kind = np.where(points < 128, _CLASSES[np.minimum(points, 127)], _OTHER).astype(np.uint8)
        wide = points > 127
        if wide.any():
            kind[np.flatnonzero(wide)[np.isin(points[wide], _WIDE_SPACES)]] = _SPACE
        solid = kind != _SPACE
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
        word_start, word_end = edge[::2], edge[1::2]
        hot = np.flatnonzero((kind == _DIGIT) | (points == 64))
        words = np.unique(np.searchsorted(word_start, hot, "right") - 1)
        lo, hi = word_start[words], word_end[words]
        # A word goes on with an island if one space lies before it.
        joins = np.zeros(len(words), bool)
        joins[1:] = (words[1:] == words[:-1] + 1) & (lo[1:] - hi[:-1] == 1)
        joins &= self.at(points, lo - 1) == 32
        size = hi - lo
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + size, size)
        k = kind[index]
        run = np.where((k == _LOWER) | (k == _UPPER) | (k == _OTHER), _LOWER, k)
        begins = np.ones(len(index), bool)
        begins[1:] = (run[1:] != run[:-1]) | (run[1:] == _MARK)
        opens = ends - size  # where words open
        begins[opens] = True
        at = np.flatnonzero(begins)
        self.start = index[at]
        self.length = np.diff(np.append(at, len(index)))
        self.end = self.start + self.length
        self.spaced = np.zeros(len(at), bool)
        word_token = np.searchsorted(at, opens)
        self.spaced[word_token] = True
        #: First token of each island.
        self.islands = word_token[~joins]
        self.island = np.cumsum(np.bincount(self.islands, minlength=len(at))[: len(at)]) - 1 if len(at) else np.empty(0, np.int64)
        count = lambda c: np.add.reduceat((k == c).astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        upper, other = count(_UPPER), count(_OTHER)
        letters = np.where(other > 0, 5, np.where(upper == 0, 1, np.where(upper == self.length, 2, np.where((upper == 1) & (k[at] == _UPPER), 3, 4))))
        self.digit, self.mark = run[at] == _DIGIT, run[at] == _MARK
        self.char = np.where(self.mark, points[self.start], 0) if len(at) else np.empty(0, np.uint32)
        self.shape = 1 + np.where(self.digit, np.minimum(self.length, _LONGEST) - 1, np.where(self.mark, _SHAPE_OF_MARK[np.minimum(self.char, 127)], _LONGEST - 1 + letters))
        self.cue = [self._word_before(points, word_start, word_end, w) for w in words[~joins].tolist()]

    @staticmethod
    def at(points: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.where(where >= 0, points[np.maximum(where, 0)] if len(points) else 0, 0)

    def _word_before(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, word: int) -> str:
        if not word or end[word - 1] - start[word - 1] > 20 or 10 in points[end[word - 1] : start[word]]:
            return ""
        return self.text[start[word - 1] : end[word - 1]].lower().strip(string.punctuation)

    def near(self, values: np.ndarray, by: int) -> np.ndarray:
        """``values`` of the token ``by`` further on in the island; 0 beyond it."""
        out = np.zeros(len(values), values.dtype)
        if 0 < abs(by) < len(values):
            a, b = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
            out[b] = np.where(self.island[a] == self.island[b], values[a], 0)
        return out

    def _quads(self) -> np.ndarray:
        """1 where a dotted quad begins, 2 within it."""
        n = len(self.start)
        small = self.small()
        ok = small.copy()
        for by in range(1, 7):
            here = self.near((self.char == 46) & ~self.spaced, by) if by % 2 else self.near(small & ~self.spaced, by)
            ok &= here
        out = np.zeros(n, np.int64)
        for by in range(6, -1, -1):
            where = np.flatnonzero(ok) + by
            out[where] = 2 if by else 1
        return out

    def small(self) -> np.ndarray:
        """Digit runs up to 255."""
        out = self.digit & (self.length <= 3)
        for i in np.flatnonzero(out & (self.length == 3)).tolist():
            out[i] = int(self.text[self.start[i] : self.end[i]]) <= 255
        return out

    def _sums(self) -> np.ndarray:
        """1 where digit runs joined by a space, hyphen or dot begin that have the check
        digit of a card together, 2 within them; the fewest runs that do."""
        out = np.zeros(len(self.start), np.int64)
        done = 0
        for i in np.flatnonzero(self.digit & (self.length <= 19)).tolist():
            if i < done:
                continue
            digits, j = self.text[self.start[i] : self.end[i]], i
            while True:
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out[i], out[i + 1 : j + 1], done = 1, 2, j + 1
                    break
                after = j + 1
                if after < len(out) and self.char[after] in (45, 46) and not self.spaced[after]:
                    after += 1
                    if after < len(out) and self.spaced[after]:
                        break
                elif after < len(out) and not self.spaced[after]:
                    break
                if after >= len(out) or not self.digit[after] or self.island[after] != self.island[i] or len(digits) + self.length[after] > 19:
                    break
                digits, j = digits + self.text[self.start[after] : self.end[after]], after
        return out

    def features(self, cues: dict[str, int]) -> np.ndarray:
        """Numbers of each token's features, a row for each token."""
        shape = 2 * self.shape + self.spaced
        near = {by: self.near(shape, by) for by in (-2, -1, 1, 2)}
        # Lengths of the digit runs around: the token's own, or the nearest, and those next to it.
        at = np.flatnonzero(self.digit)
        size = np.minimum(self.length, _LONGEST)
        rank = np.searchsorted(at, np.arange(len(shape)))
        pick = lambda k: np.where((k >= 0) & (k < len(at)) & (self.island[at[np.clip(k, 0, max(len(at) - 1, 0))]] == self.island), size[at[np.clip(k, 0, max(len(at) - 1, 0))]], 0) if len(at) else np.zeros(len(shape), np.int64)
        runs = (pick(rank - 1) * (_LONGEST + 1) + pick(rank)) * (_LONGEST + 1) + pick(rank + 1)
        # Digits together: of tokens that numbers are written with.
        loose = ~(self.digit | np.isin(self.char, [40, 41, 45, 46, 43]))
        cut = loose | (self.char == 43)
        cut[self.islands] = True
        group = np.cumsum(cut)
        total = np.bincount(group, np.where(self.digit, self.length, 0), minlength=int(group[-1]) + 1 if len(group) else 0)[group] if len(group) else np.zeros(0)
        together = np.where(loose, 0, 1 + np.searchsorted([7, 9, 16, 20], total, "right"))
        sign = np.cumsum(self.char == 64)
        before = np.concatenate([[0], sign])[:-1]
        opens = np.maximum.accumulate(np.where(self.spaced, np.arange(len(shape)), 0)) if len(shape) else np.empty(0, np.int64)
        ends = np.append(np.flatnonzero(self.spaced)[1:], len(shape))[np.cumsum(self.spaced) - 1] - 1 if len(shape) else opens
        side = np.where(sign - before[opens] > 0, 2, np.where(sign[ends] - sign > 0, 1, 0)) if len(shape) else opens
        columns = {
            "shape": shape, "before": near[-1], "after": near[1], "before2": near[-2], "after2": near[2], "pair": near[-1] * _SHAPES + shape, "next_pair": shape * _SHAPES + near[1],
            "runs": runs, "quad": self._quads(), "sum": self._sums(), "small": self.small().astype(np.int64), "at": side, "together": together, "always": np.zeros(len(shape), np.int64),
        }
        cue = np.array([cues.get(c, 0) for c in self.cue], np.int64)
        return np.stack([*(c + _OFFSETS[name] for name, c in columns.items()), _CUES_AT + cue[self.island] if len(shape) else np.zeros(0, np.int64)], 1)


def _lockstep(islands: np.ndarray, n: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of about equal length together: (first tokens, lengths), longest first,
    with at most about ``most`` places in each part."""
    size = np.diff(np.append(islands, n))
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        many = max(1, most // int(size[order[at]]))
        part = order[at : at + many]
        yield islands[part], size[part]
        at += many


class Crf:
    """Weights of features by label, and of a label after a label."""

    def __init__(self, cues: dict[str, int]) -> None:
        self.cues = cues
        self.weights = np.zeros((_CUES_AT + len(cues) + 1, len(LABELS)))
        self.steps = np.zeros((len(LABELS), len(LABELS)))
        #: What may follow: a span's inside only its own begin or inside.
        self.barred = np.array([[b[0] == "I" and (a == "O" or a[2:] != b[2:]) for b in LABELS] for a in LABELS])
        self.never_first = np.array([b[0] == "I" for b in LABELS])

    def unary(self, features: np.ndarray, islands: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(LABELS)))
        for column in features.T:
            out += self.weights[column]
        out[islands[:, None], np.flatnonzero(self.never_first)] = -1e9
        return out

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best label of each token, by Viterbi, all chains of a part in step."""
        n = len(tokens.start)
        best = np.zeros(n, np.int64)
        if not n:
            return best
        unary, steps = self.unary(tokens.features(self.cues), tokens.islands), np.where(self.barred, -1e9, self.steps)
        for first, size in _lockstep(tokens.islands, n):
            score, back = unary[first], []
            for t in range(1, int(size[0])):
                alive = int(np.searchsorted(-size, -t, "left"))  # chains longer than t
                through = score[:alive, :, None] + steps
                came = through.argmax(1)
                back.append(came)
                score[:alive] = np.take_along_axis(through, came[:, None], 1)[:, 0] + unary[first[:alive] + t]
            label = score.argmax(1)
            for t in range(int(size[0]) - 1, 0, -1):
                alive = int(np.searchsorted(-size, -t, "left"))
                best[first[:alive] + t] = label[:alive]
                label[:alive] = back[t - 1][np.arange(alive), label[:alive]]
            best[first] = label
        return best

    def fit(self, tokens: Tokens, gold: np.ndarray, rounds: int = 120, penalty: float = 0.02, rate: float = 0.15) -> None:
        """Maximise the penalised likelihood of ``gold`` (Adam on all chains at once)."""
        features, n = tokens.features(self.cues), len(gold)
        moments = [np.zeros_like(x) for x in (self.weights, self.weights, self.steps, self.steps)]
        starts = np.zeros(n, bool)
        starts[tokens.islands] = True
        seen = np.zeros_like(self.weights)
        for column in features.T:
            np.add.at(seen, (column, gold), 1)
        inner = np.flatnonzero(~starts)
        steps_seen = np.zeros_like(self.steps)
        np.add.at(steps_seen, (gold[inner - 1], gold[inner]), 1)
        for k in range(1, rounds + 1):
            share, pairs = self._expected(features, tokens.islands, n)
            expected = np.zeros_like(self.weights)
            for column in features.T:
                np.add.at(expected, column, share)
            for x, grad, m, v in ((self.weights, seen - expected - penalty * self.weights, *moments[:2]), (self.steps, steps_seen - pairs - penalty * self.steps, *moments[2:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                x += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    def _expected(self, features: np.ndarray, islands: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels of each token, and label pairs, by forward and backward sums."""
        unary, steps = self.unary(features, islands), np.where(self.barred, -1e9, self.steps)
        share, pairs = np.zeros_like(unary), np.zeros_like(self.steps)
        for first, size in _lockstep(islands, n):
            ahead = np.full((int(size[0]), len(first), len(LABELS)), -1e9)
            ahead[0] = unary[first]
            for t in range(1, len(ahead)):
                alive = int(np.searchsorted(-size, -t, "left"))
                ahead[t, :alive] = np.logaddexp.reduce(ahead[t - 1, :alive, :, None] + steps, 1) + unary[first[:alive] + t]
            total = np.logaddexp.reduce(ahead[size - 1, np.arange(len(first))], 1)
            rest = np.zeros((len(first), len(LABELS)))  # backward sums at t
            for t in range(len(ahead) - 1, -1, -1):
                alive = int(np.searchsorted(-size, -t, "left"))
                share[first[:alive] + t] = np.exp(ahead[t, :alive] + rest[:alive] - total[:alive, None])
                if t:
                    onward = steps + (unary[first[:alive] + t] + rest[:alive])[:, None, :]
                    pairs += np.exp(ahead[t - 1, :alive, :, None] + onward - total[:alive, None, None]).sum(0)
                    rest[:alive] = np.logaddexp.reduce(onward, 2)
        return share, pairs

    def spans(self, texts: Sequence[str]) -> list[list[Span]]:
        """The field's spans of each text, before any check."""
        tokens = Tokens(texts)
        best = self.decode(tokens)
        out: list[list[Span]] = [[] for _ in texts]
        begin = np.flatnonzero(best % 2 == 1)
        if not len(begin):
            return out
        # A span ends where neither its own inside follows nor the island goes on.
        inside = np.concatenate([(best > 0) & (best % 2 == 0), [False]])
        last = np.flatnonzero(~inside[1:])
        stop = tokens.end[last[np.searchsorted(last, begin)]]
        owner = np.searchsorted(tokens.first, tokens.start[begin], "right") - 1
        for i, a, b, label in zip(owner.tolist(), tokens.start[begin].tolist(), stop.tolist(), best[begin].tolist(), strict=True):
            at = int(tokens.first[i])
            out[i].append((LABELS[label][2:], a - at, b - at))
        return out


_TAG = re.compile(r"<(/?)(email|ip|card|phone)>")


def unmarked(line: str) -> tuple[str, list[Span]]:
    """A marked line's text and spans."""
    text, spans, open_at, at = "", [], 0, 0
    for m in _TAG.finditer(line):
        text += line[at : m.start()]
        if m[1]:
            spans.append((m[2], open_at, len(text)))
        open_at, at = len(text), m.end()
    return text + line[at:], spans


def train(lines: Sequence[str] = LABELLED) -> Crf:
    """A field fitted to marked lines, a small table that the driver holds."""
    rows = [unmarked(x) for x in lines]
    tokens = Tokens([t for t, _ in rows])
    model = Crf({c: i + 1 for i, c in enumerate(sorted(set(tokens.cue) - {""}))})
    gold = np.zeros(len(tokens.start), np.int64)
    for i, (_, spans) in enumerate(rows):
        for kind, a, b in spans:
            inside = np.flatnonzero((tokens.start >= tokens.first[i] + a) & (tokens.end <= tokens.first[i] + b))
            gold[inside] = 2 + 2 * KINDS.index(kind)
            gold[inside[:1]] -= 1
    model.fit(tokens, gold)
    return model


def all_spans(texts: Sequence[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans the field adds) of each text."""
    out = []
    for text, more in zip(texts, model.spans(texts), strict=True):
        base = base_spans(text)
        free = [s for s in more if passes(s[0], text[s[1] : s[2]]) and not any(a < s[2] and s[1] < b for _, a, b in base)] if more else []
        out.append((base, free))
    return out


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def personal_data(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans and n_added for each document;
    with ``redact`` also ``redacted``, the text with each span's kind in its place."""
    box = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint" + ", redacted string" * redact

    def cut(text: str, spans: Sequence[Span]) -> str:
        parts, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = all_spans(texts, box.value)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([joined(a + b) for a, b in found], pa.string()), pa.array([len(b) for _, b in found], pa.int64())]
            if redact:
                cols.append(pa.array([cut(t, a + b) for t, (a, b) in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op11``: personal data of all ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"), train())
