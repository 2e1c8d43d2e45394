"""Personal information inside free text (problem 9): a linear-chain conditional random field over word-shape features."""

from __future__ import annotations

import base64
import hashlib
import inspect
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.labelled import STREET_TYPES, known_names, labelled_table
from tidemark.llm.words import words as words_of
from tidemark.session import shared_folder, table

#: Default vocabulary: lines of base64 bytes and rank. Its common words are features; the frequency of words is public knowledge.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

KINDS = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
#: O, then B- and I- of each kind.
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Words to either side whose features count.
REACH = 2
TOKEN = re.compile(r"(\s*)([^\W_]+|[^\w\s]|_)")
#: Decoding runs over windows of CORE tokens with MARGIN more on either side.
CORE, MARGIN = 128, 24
#: Distinct words a task remembers before it starts afresh.
REMEMBERED = 60_000
#: Known names are broadcast up to this many words (some 20 bytes each); more of them are looked up by a shuffled join.
BROADCAST_NAMES = 200_000
#: Occurrences in the labelled table from which on a word is a feature of its own.
LEAST_SEEN = 4
PAD = ("\n", "")


def tokens(text: str) -> list[tuple[str, str]]:
    """(white space before it, word) of a text; a text begins as if after a line break."""
    return TOKEN.findall("\n" + text)


def token_ends(text: str) -> tuple[list[int], list[int]]:
    """(start, end) of each word."""
    at = [m.span(2) for m in TOKEN.finditer(text)]
    return [a for a, _ in at], [b for _, b in at]


def common_words(path: str = VOCABULARY) -> dict[str, int]:
    """Whole words of a public vocabulary by its rank, as written there (capitals count)."""
    out = {}
    with open(path, "rb") as f:
        for raw, rank in (line.split() for line in f if line.strip()):
            t = base64.b64decode(raw)
            if t[:1] == b" " and len(t) > 1:
                w = t[1:].decode("utf-8", "ignore")
                if w.isalpha():
                    out[w] = int(rank)
    return out


_STREET = frozenset(STREET_TYPES)
_STREET_END = ("straße", "strasse", "weg", "platz", "gasse")


#: Endings of English words that are formed from others.
_ENDINGS = ("ed", "d", "ing", "er", "r", "s", "es", "y", "ly", "ness", "less", "ful", "able", "ish", "like", "wise")


def _derived(low: str, common: dict[str, int]) -> bool:
    """Whether a word is a common word with a usual ending, or two common words of three letters and more."""
    for e in _ENDINGS:
        stem = low[: -len(e)]
        if low.endswith(e) and len(stem) > 2 and (stem in common or stem + "e" in common or (stem[-1] == stem[-2] and stem[:-1] in common) or (stem[-1] == "i" and stem[:-1] + "y" in common)):
            return True
    return any(low[:i] in common and low[i:] in common for i in range(3, len(low) - 2))


def letter_case(text: str) -> str:
    """How a text is written: l without capitals, u without small letters, m mixed."""
    return "l" if text.islower() else "u" if text.isupper() else "m"


def features(space: str, word: str, case: str, common: dict[str, int], given: bool, family: bool) -> list[str]:
    """Shape features of one word in a text of the given case; those that start with * are used at the word and its direct neighbours only."""
    if not word:
        return ["pad"]
    gap = 0 if not space else 2 if "\n" in space else 1
    low = word.lower()
    shape = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.islower() else c if not c.isalnum() else "y" for c in word)
    short = re.sub(r"(.)\1+", r"\1+", shape)
    out = [f"s={case}{short}", f"g={gap}"]
    if word.isalnum():
        out += [f"w={low}"] if not word.isdigit() else [f"d={min(len(word), 12)}", f"d0={word[0] == '0'}{min(len(word), 12)}"]
    else:
        out += [f"w={low}", f"wg={low}{gap}"]
    if any(c.isdigit() for c in word):
        out.append(f"f={shape[:12].upper()}")
        if re.fullmatch(r"[A-Za-z]{1,3}\d{5,9}[A-Za-z]?|\d{6,9}[A-Za-z]?", word):
            out.append("code")
    elif word.isalpha():
        rank = common.get(low)
        kind = "none" if rank is None else "a" if rank < 4_000 else "b" if rank < 15_000 else "c"
        if rank is None:
            kind = "proper" if low.capitalize() in common else "derived" if _derived(low, common) else "none"
        out += [f"v={kind}", f"vs={case}{kind}{short}", f"*p3={low[:3]}", f"*x2={low[-2:]}", f"*x3={low[-3:]}", f"*l={min(len(word), 10)}"]
        if given:
            out.append("given")
        if family:
            out.append("family")
        if low in _STREET:
            out.append("street")
        elif low.endswith(_STREET_END):
            out.append("streetend")
        if len(word) == 1:
            out.append("letter")
    return out


class _Numbered(dict):
    """Numbers keys as they are first asked for; `new` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


@dataclass
class Tagger:
    """Weights per offset and feature; what a word adds to each offset is summed once per distinct word. A word is (space, word), or
    (space, word, case of the text, is given name, is family name) where the text is not in mixed case or the known names do not travel
    with the tagger."""

    index: dict[str, int]
    weights: np.ndarray  # offsets x features x labels
    moves: np.ndarray  # labels x labels
    first: np.ndarray
    common: dict[str, int]
    given: frozenset = frozenset()
    family: frozenset = frozenset()
    known: dict = field(default_factory=dict)
    sums: np.ndarray | None = None

    def described(self, key: tuple) -> list[str]:
        low = key[1].lower()
        case, given, family = key[2:] or ("m", False, False)
        return features(key[0], key[1], case, self.common, given or low in self.given, family or low in self.family)

    def rows(self, keys: list[tuple]) -> np.ndarray:
        """The row of each word in `sums`, which grows by the words not met before."""
        if len(self.known) > REMEMBERED or self.sums is None:
            self.known, self.sums = _Numbered(), np.zeros((0, 2 * REACH + 1, len(LABELS)), np.float32)
        known = self.known
        found = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        new, known.new = known.new, []
        if new:
            more = np.zeros((len(new), 2 * REACH + 1, len(LABELS)), np.float32)
            for i, k in enumerate(new):
                fs = [self.index[f] for f in self.described(k) if f in self.index]
                more[i] = self.weights[:, fs].sum(1)
            self.sums = np.concatenate([self.sums, more])
        return found

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Scores of each position; `rows` has REACH pads at both ends of every text."""
        n = len(rows) - 2 * REACH
        out = np.zeros((n, len(LABELS)), np.float32)
        for o in range(2 * REACH + 1):
            out += self.sums[rows[o : o + n], o]
        return out

    def with_names(self, given: frozenset, family: frozenset) -> Tagger:
        return Tagger(self.index, self.weights, self.moves, self.first, self.common, self.given | given, self.family | family)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "sums": None}

    def packed(self) -> bytes:
        """Weights and feature names as bytes; the vocabulary and the public names are not in them."""
        out = io.BytesIO()
        np.savez_compressed(out, index=np.array(json.dumps(list(self.index))), weights=self.weights, moves=self.moves, first=self.first)
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes, common: dict[str, int]) -> Tagger:
        z = np.load(io.BytesIO(raw), allow_pickle=False)
        given, family = _name_words()
        return Tagger({f: i for i, f in enumerate(json.loads(str(z["index"])))}, z["weights"], z["moves"], z["first"], common, given, family)


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label sequences of a batch (batch x time x labels); positions beyond a length are 0."""
    n, t, _ = scores.shape
    back, across = np.zeros((n, t, scores.shape[2]), np.int8), np.ascontiguousarray(moves.T)
    best = scores[:, 0] + first
    for i in range(1, t):
        all_ = best[:, None, :] + across[None]
        top = all_.argmax(2)
        back[:, i] = top
        step = np.take_along_axis(all_, top[:, :, None], 2)[:, :, 0] + scores[:, i]
        best = np.where((i < lengths)[:, None], step, best)
    out = np.zeros((n, t), np.int8)
    at, rows = best.argmax(1), np.arange(n)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        out[inside, i] = at[inside]
        at = np.where(inside & (i > 0), back[rows, i, at], at)
    return out


def _name_words() -> tuple[frozenset, frozenset]:
    words = lambda xs: frozenset(w.lower() for x in xs for w in re.findall(r"[^\W\d_]+", x))
    return tuple(map(words, known_names()))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], common: dict[str, int], epochs: int = 12, batch: int = 160, rate: float = 0.08, l2: float = 2e-3, seed: int = 3, drop: float = 0.3) -> Tagger:
    """Maximum likelihood by Adam over the labelled table. In each batch a share `drop` of the words loses its identity and its
    place among the known names, so that shape and context are learnt as well."""
    rng = np.random.default_rng(seed)
    given, family = _name_words()
    seqs = []
    for text, spans in rows:
        case = letter_case(text)
        keys = [(*k, case) for k in tokens(text)]
        starts, ends = token_ends(text)
        y = np.zeros(len(keys), np.int64)
        for a, b, kind in spans:
            inside = [i for i in range(len(keys)) if starts[i] >= a and ends[i] <= b]
            for j, i in enumerate(inside):
                y[i] = 1 + 2 * KINDS.index(kind) + (j > 0)
        if keys:
            seqs.append((keys, y))
    types: dict = {(*PAD, "m"): 0}
    times = [LEAST_SEEN]
    for keys, _ in seqs:
        for k in keys:
            if types.setdefault(k, len(types)) == len(times):
                times.append(0)
            times[types[k]] += 1
    named = [features(*k, common, k[1].lower() in given, k[1].lower() in family) for k in types]
    count: dict[str, int] = {}
    for fs, n in zip(named, times):
        for f in fs:
            count[f] = count.get(f, 0) + n
    named = [[f for f in fs if count[f] >= LEAST_SEEN] for fs in named]
    index = {f: i for i, f in enumerate(dict.fromkeys(f for fs in named for f in fs))}
    nf, nl, no = len(index), len(LABELS), 2 * REACH + 1
    wide = max(map(len, named))
    feat = np.full((len(named), wide), nf, np.int64)  # nf: a feature that is always 0
    near_only = np.zeros((len(named), wide), bool)
    special = np.zeros((len(named), wide), bool)
    for i, fs in enumerate(named):
        feat[i, : len(fs)] = [index[f] for f in fs]
        near_only[i, : len(fs)] = [f[0] == "*" for f in fs]
        special[i, : len(fs)] = [f in ("given", "family") or (f.startswith("w=") and len(f) > 4) for f in fs]
    far = np.where(near_only, nf, feat)
    w = np.zeros((no, nf + 1, nl), np.float32)
    moves, first = np.zeros((nl, nl), np.float32), np.zeros(nl, np.float32)
    for j in range(2, nl, 2):  # I- only after B- or I- of its kind
        moves[[i for i in range(nl) if i not in (j - 1, j)], j] = -8
        first[j] = -8
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, moves, first)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(seqs))
        order = order[np.argsort([len(seqs[i][0]) // 24 for i in order], kind="stable")]
        cuts = [order[a : a + batch] for a in range(0, len(order), batch)]
        rng.shuffle(cuts)
        for part in cuts:
            lens = np.array([len(seqs[i][0]) for i in part])
            t, n = lens.max(), len(part)
            ids = np.full((n, t + 2 * REACH), 0)
            y = np.zeros((n, t), np.int64)
            for r, i in enumerate(part):
                ids[r, REACH : REACH + lens[r]] = [types[k] for k in seqs[i][0]]
                y[r, : lens[r]] = seqs[i][1]
            mask = np.arange(t)[None] < lens[:, None]
            used, inv = np.unique(ids, return_inverse=True)
            inv = inv.reshape(ids.shape)
            hide = (rng.random(len(used)) < drop)[:, None] & special[used]
            f_near, f_far = np.where(hide, nf, feat[used]), np.where(hide, nf, far[used])
            f_of = [f_near if abs(o - REACH) <= 1 else f_far for o in range(no)]
            em = np.zeros((n, t, nl), np.float32)
            for o in range(no):
                em += w[o][f_of[o]].sum(1)[inv[:, o : o + t]]
            # forward and backward
            al = np.zeros((n, t, nl), np.float32)
            al[:, 0] = em[:, 0] + first
            for i in range(1, t):
                al[:, i] = np.where(mask[:, i, None], _lse(al[:, i - 1, :, None] + moves[None], 1) + em[:, i], al[:, i - 1])
            be = np.zeros((n, t, nl), np.float32)
            for i in range(t - 2, -1, -1):
                be[:, i] = np.where(mask[:, i + 1, None], _lse(moves[None] + (em[:, i + 1] + be[:, i + 1])[:, None], 2), 0)
            z = _lse(al[np.arange(n), lens - 1], 1)
            node = np.exp(al + be - z[:, None, None]) * mask[:, :, None]
            g = node
            np.subtract.at(g, (np.arange(n)[:, None], np.arange(t)[None], y), mask.astype(np.float32))
            g_moves = np.zeros_like(moves)
            for i in range(1, t):
                live = mask[:, i]
                if live.any():
                    p = np.exp(al[live, i - 1, :, None] + moves[None] + (em[live, i] + be[live, i])[:, None] - z[live, None, None])
                    g_moves += p.sum(0)
                    np.subtract.at(g_moves, (y[live, i - 1], y[live, i]), 1.0)
            g_first = g[:, 0].sum(0)
            g_w = np.zeros_like(w)
            for o in range(no):
                at = inv[:, o : o + t].ravel()
                flat, fo = g.reshape(-1, nl), f_of[o]
                for lab in range(nl):
                    per_type = np.bincount(at, flat[:, lab], len(used))
                    g_w[o, :, lab] = np.bincount(fo.ravel(), np.repeat(per_type, wide), nf + 1)
            g_w[:, nf] = 0
            step += 1
            lr = rate * min(1.0, 1.6 * (1 - step / (epochs * len(cuts) + 1)))
            for p, gr, (m, v) in zip((w, moves, first), (g_w / n + l2 * w, g_moves / n, g_first / n), state):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w[:, nf] = 0
    for o in range(no):  # what only direct neighbours use must not act from afar in the summed form either
        if abs(o - REACH) > 1:
            w[o, [i for f, i in index.items() if f[0] == "*"]] = 0
    return Tagger(index, w[:, :nf].copy(), moves, first, common, given, family)


def tag_texts(tagger: Tagger, texts: list[str], names: list[tuple[frozenset, frozenset]] | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text's spans, before the exact check. `names` has each text's known given and family names where
    these do not travel with the tagger."""
    keys: list[tuple] = []
    base, size = [], []
    for d, text in enumerate(texts):
        found = tokens(text)
        given, family = names[d] if names is not None else (frozenset(), frozenset())
        case = letter_case(text)
        if case != "m" or given or family:
            found = [(a, w, case, w.lower() in given, w.lower() in family) for a, w in found]
        keys += [PAD] * REACH
        base.append(len(keys) - REACH)
        size.append(len(found))
        keys += found
    keys += [PAD] * REACH
    em = tagger.emissions(tagger.rows(keys))
    wins = sorted(((d, a) for d, n in enumerate(size) for a in range(0, n, CORE)), key=lambda x: min(size[x[0]], x[1] + CORE + MARGIN) - max(0, x[1] - MARGIN))
    labels = [np.zeros(n, np.int8) for n in size]
    for s in range(0, len(wins), 1_000):
        part = wins[s : s + 1_000]
        lo = np.array([max(0, a - MARGIN) for _, a in part])
        hi = np.array([min(size[d], a + CORE + MARGIN) for d, a in part])
        pos = np.array([base[d] for d, _ in part]) + lo
        t = int((hi - lo).max())
        at = np.minimum(pos[:, None] + np.arange(t)[None], len(em) - 1)
        got = viterbi(em[at], hi - lo, tagger.moves, tagger.first)
        for (d, a), l, row in zip(part, lo, got):
            b = min(a + CORE, size[d])
            labels[d][a:b] = row[a - l : b - l]
    out = []
    for text, y in zip(texts, labels):
        spans, open_ = [], None
        hits = np.flatnonzero(y)
        starts, ends = token_ends(text) if len(hits) else ([], [])
        for i in hits:
            lab = LABELS[y[i]]
            if open_ and lab[0] == "I" and open_[2] == lab[2:] and open_[3] == i - 1:
                open_[1], open_[3] = ends[i], i
            else:
                if open_:
                    spans.append(tuple(open_[:3]))
                open_ = [starts[i], ends[i], lab[2:], i]
        if open_:
            spans.append(tuple(open_[:3]))
        out.append(spans)
    return out


_AT = r"(?:@|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_EXACT = {
    "EMAIL": re.compile(rf"[^\W_][\w.+%-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+", re.I),
    "PHONE": re.compile(r"(?<![\w+])[+(]?\d(?:[\d ()./ -]{6,22})\d(?![\w])"),
    "ID_NUMBER": re.compile(r"(?<![\w-])(?:[A-Z]{1,3}-[A-Z]{1,3}-|[A-Z]{1,3}[ -]?)?\d(?:[ -]?\d){4,11}(?:[ -]?[A-Z])?(?![\w'’-])", re.I),
}


def exact_span(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact check after the tagger: ends of a span moved to where its form ends, or None where it has no such form."""
    if kind in _EXACT:
        lo, hi = max(0, a - 40), min(len(text), b + 40)
        if kind == "ID_NUMBER":  # a neighbouring word could pass for its letters: only the rest of a cut word is added
            lo, hi = a - len(re.search(r"[\w-]*$", text[lo:a])[0]), b + len(re.match(r"[\w-]*", text[b:hi])[0])
        # what the tagger proposes stands if it has the form, else the nearest text of that form takes its place
        whole = text[lo:hi] if kind == "ID_NUMBER" else text[a:b]
        best = (1, lo, hi) if kind == "ID_NUMBER" and _EXACT[kind].fullmatch(whole) and text[hi : hi + 1] not in ("'", "’") else (1, a, b) if _EXACT[kind].fullmatch(whole) and not text[b : b + 1].isalnum() and (kind != "EMAIL" or text[b : b + 1] not in ".@") else None
        for m in () if best else _EXACT[kind].finditer(text, lo, hi):
            shared = min(b, m.end()) - max(a, m.start())
            if shared > 0 and (best is None or shared > best[0]):
                best = (shared, m.start(), m.end())
        if best is None:
            return None
        digits = sum(c.isdigit() for c in text[best[1] : best[2]])
        if kind == "PHONE" and not 9 <= digits <= 15 or kind == "ID_NUMBER" and not 6 <= digits <= 12:
            return None
        return best[1], best[2]
    s = text[a:b]
    if kind == "NAME":
        if letter_case(text) == "m":  # then names have capitals: words without, other than particles, do not stand at the ends
            capital = [m for m in re.finditer(r"[^\W\d_]+", s) if not m[0].islower()]
            if not capital:
                return None
            first = re.search(r"\b(?:van|von|de|der|da|di|la|el|al|ten)(?:\s+(?:van|von|de|der|la))?\s+$", s[: capital[0].start()])
            s, a = s[first.start() if first else capital[0].start() : capital[-1].end()], a + (first.start() if first else capital[0].start())
        s = re.sub(r"['’]s$", "", s, flags=re.I).rstrip(" ,;:'’-=|\n\t")
        words = re.findall(r"[^\W\d_]+", s)
        return (a, a + len(s)) if len(words) >= 2 and max(map(len, words)) >= 3 and not re.search(r"[\d@]", s) else None
    m = re.match(r"(?:(?:dr|mr|mrs|ms)\.?\s+)", s, re.I)
    s = s.rstrip(" ,;:-")
    if s.endswith(".") and not re.search(r"\b(?:st|ave|rd|ln|blvd|ct|dr|sq|izq|dcha|str|apt|no)\.$", s, re.I):
        s = s[:-1]  # the sentence's, not an abbreviation's
    return (a, a + len(s)) if not m and any(c.isdigit() for c in s) and re.search(r"[^\W\d_]{3,}", s) else None


def find_spans(tagger: Tagger, texts: list[str], names: list[tuple[frozenset, frozenset]] | None = None) -> list[list[tuple[int, int, str]]]:
    """Checked spans of each text, in order and without overlaps."""
    out = []
    for text, spans in zip(texts, tag_texts(tagger, texts, names)):
        good: list[tuple[int, int, str]] = []
        for a, b, kind in spans:
            at = exact_span(text, a, b, kind)
            if at and (not good or at[0] >= good[-1][1]):
                good.append((*at, kind))
        out.append(good)
    return out


def known_words(people: DataFrame) -> DataFrame:
    """(word, given, family) of people's names (given_name, family_name), lower-cased; each word once."""
    each = people.select(F.explode(F.concat(F.transform(words_of(F.col("given_name")), lambda w: F.struct(w.alias("word"), F.lit(True).alias("given"))), F.transform(words_of(F.col("family_name")), lambda w: F.struct(w.alias("word"), F.lit(False).alias("given"))))).alias("x")).select("x.*")
    return each.groupBy("word").agg(F.max("given").alias("given"), F.max(~F.col("given")).alias("family"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut to as many texts as make some 300,000 characters."""
    for pdf in batches:
        size = np.array([len(x) if isinstance(x, str) else 0 for x in pdf["text"]], np.int64).cumsum()
        cuts = np.searchsorted(size, np.arange(300_000, size[-1] if len(size) else 0, 300_000)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if b > a:
                yield pdf.iloc[a:b]


def find_personal(docs: DataFrame, doc_id: str, text: str, tagger: Tagger, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans, redacted): spans is an array of (start, stop, kind, span) in characters, redacted the text with <KIND> instead.

    One row for each row of `docs`. Null texts give a null redacted text and no spans, empty ones themselves. Texts are tagged whole,
    however long. A null id stays. An empty table gives an empty result; other columns are ignored. `names` (word, given, family) are
    more known names; they are features, so a name among them is likelier to be found, and any other may be found too.

    Method: each task scores its words by the tagger's weights (summed once per distinct word) and decodes batches of windows by
    Viterbi in numpy; what the tagger proposes is then checked against the exact form of its kind. No shuffle, unless the names are
    more than BROADCAST_NAMES: then each document's own known names come to it by a join, with the same result.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    few = names is None or names.count() <= BROADCAST_NAMES
    if names is not None and few:
        got = names.collect()
        tagger = tagger.with_names(frozenset(r.word for r in got if r.given), frozenset(r.word for r in got if r.family))
    elif names is not None:
        keyed = rows.withColumn("h", F.xxhash64("text"))
        said = keyed.select("id", "h", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).distinct()
        own = said.join(names, "word").groupBy("id", "h").agg(F.collect_list(F.when(F.col("given"), F.col("word"))).alias("g"), F.collect_list(F.when(F.col("family"), F.col("word"))).alias("f"))
        own = own.select(F.col("id").alias("oid"), F.col("h").alias("oh"), "g", "f")
        rows = keyed.join(own, F.col("id").eqNullSafe(F.col("oid")) & (F.col("h") == F.col("oh")), "left").select("id", "text", "g", "f")
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # features of the bounded labelled table, a vocabulary, at most BROADCAST_NAMES names

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        own = lambda c: [frozenset(x if x is not None else ()) for x in c]
        for pdf in _texts(batches):
            texts = [x if isinstance(x, str) else None for x in pdf["text"]]
            known = list(zip(own(pdf["g"]), own(pdf["f"]))) if "g" in pdf else None
            all_spans, reds = [], []
            for x, spans in zip(texts, find_spans(t, [x or "" for x in texts], known)):
                red, last = [], 0
                for a, b, k in spans:
                    red += [x[last:a], f"<{k}>"]
                    last = b
                all_spans.append([{"start": a, "stop": b, "kind": k, "span": x[a:b]} for a, b, k in spans])
                reds.append("".join(red) + x[last:] if x is not None else None)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "spans": all_spans, "redacted": pd.Series(reds, dtype=object).to_numpy()})

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(work, f"id {kind}, spans array<struct<start:int,stop:int,kind:string,span:string>>, redacted string").withColumnRenamed("id", doc_id)


_TRAINED: dict[str, Tagger] = {}


def trained_tagger(spark: SparkSession, vocabulary: str = VOCABULARY) -> Tagger:
    """The tagger, trained once from the labelled table: later calls take it from this process, or its weights from the shared folder.
    It depends on the code, the labelled table and the vocabulary only, whose digest names the saved weights."""
    common = common_words(vocabulary)
    code = "".join(inspect.getsource(x) for x in (labelled, features, train))
    name = hashlib.sha256((code + json.dumps(sorted(common.items()))).encode()).hexdigest()[:24]
    if name in _TRAINED:
        return _TRAINED[name]
    kept = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or shared_folder(spark)  # the former outlives the session
    home = f"{kept}/tidemark-tagger-{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(home).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(f"{home}/_SUCCESS")):
        tagger = Tagger.unpacked(bytes(spark.read.parquet(home).first()[0]), common)
    else:
        tagger = train(labelled_table(slot_words(common)), common)
        draft = f"{home}.{uuid.uuid4().hex}"
        spark.createDataFrame([(tagger.packed(),)], "weights binary").coalesce(1).write.parquet(draft)
        if fs.exists(hadoop(home)) or not fs.rename(hadoop(draft), hadoop(home)):  # another session was first
            fs.delete(hadoop(draft), True)
    _TRAINED[name] = tagger
    return tagger


def slot_words(common: dict[str, int]) -> list[str]:
    """Common words for the labelled table's slots, in order of rank."""
    return [w for w, rank in sorted(common.items(), key=lambda x: x[1]) if rank < 20_000 and len(w) > 2 and w.isascii() and w.islower()]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(table(spark, folder, "documents"), "doc_id", "text", trained_tagger(spark), known_words(table(spark, folder, "roster")))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal information replaced by typed placeholders."""
    return _documents(spark, folder).select("doc_id", F.size("spans").alias("found"), F.col("redacted").alias("text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.span").distinct()


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
SQL: dict[str, str] = {}
