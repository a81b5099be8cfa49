"""Sentence boundaries across languages and scripts: a linear-chain model over characters, decoded with Viterbi.

Every character is tagged as boundary (a unit starts here) or inside. Characters that no stop, gap or label precedes cannot start a
unit, so the chain is decoded over the candidate places alone, with the same result. Its states are boundary and inside in prose,
and, once the claims have begun, claim: there only the label of the next claim starts a unit.

Nothing is labelled by hand. Paragraphs end where a sentence ends, so a paragraph's last words and the next one's first words, put
together without the break, are examples of boundaries in running text; all candidate places of running text are the mixture that
holds boundaries and others. A log-linear model of features of the place (see `_look`) tells the examples from the mixture; divided
by the share that sure boundaries reach, its odds are the chance of a boundary (learning from positive and unlabelled examples).
For Thai, which has no stops, the same is done on text stripped of its signs, over the gaps. Transition weights are counted over
the taggings that these chances give. Features rest on counts over all documents: how often a word ends with a stop and then goes
on, which words begin paragraphs, which lines stand alone as headings.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellforge.session import stored

#: Brackets and quotation marks that enclose, by their opening mark.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "‹": "›"}
CLOSE = frozenset(PAIRS.values()) | {'"'}
QUOTES = frozenset("「『«“„‹\"")
#: Quotation marks damaged by a wrong decoding, and marks of the same length that are read for them.
DAMAGED = (("â€œ", "“¨¨"), ("â€ž", "„¨¨"), ("â€\x9d", "”””"))
#: Marks that end a sentence; the wide ones need no space after them.
WIDE = "。！？．｡"
STOPS = ".!?…।॥|؟" + WIDE
_CJK = re.compile("[぀-ヿ㐀-鿿]")
#: Scripts with the first and last letters of their ranges; every character's class is 0 (Latin, general signs), 1 (other) or a script's place from 2 on.
_SCRIPTS = (("th", "฀๿"), ("hi", "ऀॿ"), ("ko", "가힯ᄀᇿ"), ("ru", "аяАЯёёЁЁ"), ("ja", "぀ヿ"), ("zh", "㐀鿿"))
_CLASSES = np.ones(1 << 16, np.uint8)
_CLASSES[:0x250] = _CLASSES[0x2000:0x2070] = 0
for _k, (_, _ends) in enumerate(_SCRIPTS, 2):
    for _a, _b in zip(_ends[::2], _ends[1::2]):
        _CLASSES[ord(_a) : ord(_b) + 1] = _k
_CAPITAL = re.compile(r"[A-ZÀ-ÞА-ЯЁ][^\W\d_]*")
_SIGNS = ".!?,;:()[]“”„«»\"'"
_DEVANAGARI = re.compile("[ऀ-ॣ]+$")
_MARK = re.compile(r"[\[\](){}（）［］【】〔〕「」『』《》〈〉«»“”„‹›\"]")
_PAIRED = re.compile(_MARK.pattern + "(?:" + "|".join(rf"(?<=\{a})[^{_MARK.pattern[1:-1]}\n]*\{b}" for a, b in ("()", "[]", "（）", "「」")) + ")?")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_END = re.compile(r"[" + re.escape(STOPS) + r"](?!(?<=\d\.)\d|(?<=\.)[a-z]\.)[" + re.escape(STOPS) + r"]*(?:\s?[»]|[\"”“»」』）)\]】］›])*")
_LABEL = re.compile(r"(?<![^\s。．.!?|।」）)])(?:\[\s*(\w+)\s+(\d{1,4})\s*\]|【([^\d\s】]{1,6})(\d{1,4})】|(\d{1,4})\s?(\.\s?[-–]|\.|\)|、|．))(?=\s|[^\W\d])")
_FIRST_LABEL = re.compile(r"[^\S\n]*(\[\s*\w+\s+0*1\s*\]|【[^\d\s】]{1,6}0*1】|0*1\s?(?:\.|\)|、|．))")
_FIRST_LABEL_LINE = re.compile(r"\n" + _FIRST_LABEL.pattern)
_GOES_ON = re.compile(r"\.(?=[^\S\n]?(?:[a-zà-ÿа-яё,ऀ-ॿ฀-๿]|\d++(?!\s?(?:\.[\s-]|\)))))")
_NUMBER = re.compile(r"\d[\d.,  ]*$")
_PLACE = re.compile(f"({_END.pattern})\\s*([^\\W\\d_]*)")
_WORD_AFTER = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile(r"[぀-ヿ㐀-鿿]{1,3}(?=\s|$)")
_GAP = re.compile(r"\s+")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+")
_NUMBERED = re.compile(r"\[\d+\]\s*$|^\[\d+\]")
_NUMBERED_LINE = re.compile(r"\n(?=[^\S\n]*\[\d+\]\s)")
_LABELLED = re.compile(r"(?:^|\n)[^\S\n]*\d+\s?$")
_ACRONYM = re.compile(r"[A-ZА-Я]\.[A-ZА-Я]$")

MOST_FORM = 200  # a longer line is no heading
MOST_KEPT = 30_000  # words of a language whose kinds a worker remembers
MOST_COUNTED, MOST_READ = 300_000, 20_000_000  # different tokens, and characters read, after which a worker hands on its counts


def script(text: str) -> str | None:
    """The script of most letters; None for Latin ones and for text without letters."""
    # every other character has a byte more than Latin letters without accents, so few of these tell without a look at each
    if not text.isascii() and len(text.encode("utf-8", "surrogatepass")) - len(text) > 0.08 * len(text):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        common, _, *letters = np.bincount(_CLASSES[np.minimum(codes, 0xFFFF)], minlength=2 + len(_SCRIPTS)).tolist()
        if len(text) - common > 0.08 * len(text):
            for (name, _), n in zip(_SCRIPTS, letters):
                if n > (0.08 if name == "ja" else 0.15) * len(text):
                    return name
    return None


@dataclass(frozen=True)
class Model:
    """What has been learned of all documents: words, headings, and the weights of the chain."""

    abbreviation: dict[tuple[str, str], float]
    starter: dict[tuple[str, str], float]
    stopped: dict[tuple[str, str], float]
    headings: frozenset[str]
    first: frozenset[str]
    languages: dict[str, dict[str, float]]
    weights: dict[str, float]
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    memo: dict[tuple[str, ...], float] = field(default_factory=dict, init=False, repr=False, compare=False)
    tails: dict[tuple[str, bool], dict[str, tuple[str, str, str]]] = field(default_factory=lambda: defaultdict(dict), init=False, repr=False, compare=False)
    nexts: dict[str, dict[str, tuple[str, str]]] = field(default_factory=lambda: defaultdict(dict), init=False, repr=False, compare=False)
    usual: set[str] = field(default_factory=set, init=False, repr=False, compare=False)

    def last_word(self, lang: str, word: str) -> tuple[str, str]:
        """How often the word before a stop is an abbreviation, and how often it has a stop at all."""
        key = (lang, word)
        either = (self.abbreviation.get(key, self.abbreviation.get(("", word))), self.stopped.get(key, self.stopped.get(("", word))))
        return _bucket(either[0], (-3.0, -1.5, -0.5, 0.5, 2.0)), _bucket(either[1], (0.1, 0.3, 0.7, 0.95))

    def tail(self, lang: str, dot: bool, token: str) -> tuple[str, str, str]:
        """The form of the last word of a token before a stop, and, before a dot, what `last_word` says of it; kept for the next time."""
        known = self.tails[lang, dot]
        if len(known) > MOST_KEPT:
            known.clear()
        return known.setdefault(token, _tail(token, lang, dot, self))

    def next_word(self, lang: str, word: str) -> tuple[str, str]:
        """How often the word after a stop begins paragraphs, and its form; kept for the next time."""
        key, known = (lang, word), self.nexts[lang]
        if len(known) > MOST_KEPT:
            known.clear()
        shape = "1" if len(word) == 1 else "X" if word.isupper() else "Xx" if word[0].isupper() else "x"
        return known.setdefault(word, (_bucket(self.starter.get(key, self.starter.get(("", word))), (-1.5, 0.0, 1.5)), shape))

    def weight(self, look: tuple[str, ...]) -> float:
        """The log odds of a boundary at a place of this look, within LIMIT."""
        if (known := self.memo.get(look)) is None:
            odds = sum(self.weights.get(f, 0.0) for f in _features(look)) + self.weights.get("gap" if look[0] == "gap" else "stop", 0.0)
            known = self.memo[look] = max(-LIMIT, min(LIMIT, odds))
        return known

    def language(self, text: str, words: list[str] | None = None) -> str:
        """The script, or for Latin letters the language whose usual words the text holds; with none of them, the most frequent one."""
        if name := script(text):
            return name
        if not self.languages:
            return "latin"
        if not self.usual:
            self.usual.update(*self.languages.values())
        holds = self.usual.intersection(text.split() if words is None else words).__contains__
        score, name = max((sum(compress(usual.values(), map(holds, usual))), k) for k, usual in self.languages.items())
        return name if score else next(iter(self.languages))


def fit_languages(sample: pd.DataFrame, words: int = 30) -> dict[str, dict[str, float]]:
    """For each label of texts in Latin letters, the most frequent first, the words that its texts hold more often than others; labels may be wrong at times."""
    held: dict[str, Counter] = {}
    texts: Counter = Counter()
    for text, label in zip(sample["text"], sample["lang"]):
        if text and label and not script(text):
            texts[label.lower()] += 1
            held.setdefault(label.lower(), Counter()).update({w for w in text.split() if w.isalpha() and w.islower()})
    usual = [k for k, n in texts.most_common() if n >= max(5, 0.01 * sum(texts.values()))]
    out = {}
    for k in usual:
        apart = {w: n / texts[k] - max((held[o][w] / texts[o] for o in usual if o != k), default=0.0) for w, n in held[k].items()}
        out[k] = {w: v for w, v in sorted(apart.items(), key=lambda x: (-x[1], x[0]))[:words] if v > 0}
    return out


def _line(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[at : end if end >= 0 else len(text)]


def _heading_form(line: str) -> str:
    return _DIGITS.sub("9", " ".join(line.split()))


def _char_class(c: str) -> str:
    if not c:
        return "edge"
    if c.isdigit():
        return "digit"
    if c.isascii() and c.isalpha():
        return "latin"
    if c.isalpha() or "ะ" <= c <= "๎":
        return "letter"
    return "sign"


def _last_word(before: str) -> str:
    """The letters at the end of a piece of text, composed; vowel signs and accents are no letters to Python."""
    k = len(before)
    while k and (before[k - 1].isalpha() or "ऀ" <= before[k - 1] <= "ॣ" or "\u0300" <= before[k - 1] <= "\u036f"):
        k -= 1
    word = before[k:]
    return word if word.isascii() else unicodedata.normalize("NFC", word)


def _gather(text: str, languages: Model, held: defaultdict[tuple[str, str], Counter]) -> None:
    """Adds one document to the counts of tokens, words before a dot, words, lines and capitals that begin paragraphs, by (what, language)."""
    words = text.split()
    lang = languages.language(text, words)
    held["token", lang].update(words)
    held["dot", lang].update([text[max(0, m.start() - 8) : m.start()].rpartition(" ")[2] for m in _GOES_ON.finditer(text)])
    alone, begins, starts = held["alone", ""], held["begins", ""], held["start", lang]
    for s in (0, *(m.end() for m in _PARAGRAPH.finditer(text))):
        line = _line(text, s)
        tip = line.rstrip()[-1:] if len(line) <= MOST_FORM else ""
        if tip and tip not in STOPS + ",;":
            alone[_heading_form(line)] += 1
        if (word := _TOKEN.match(text, s, s + 25)) and word.end() < s + 25:
            begins[word.group()] += 1
        skip = s + len(line) + 1  # the word after a heading begins a sentence as well
        for at in (s, skip) if tip and skip < len(text) else (s,):
            if first := _CAPITAL.match(text, at):
                starts[first.group()] += 1


def _counts(held: dict[tuple[str, str], Counter]) -> dict[tuple[str, str, str], int]:
    """(kind, language, what) -> how often, of what `_gather` has counted: each different token is looked at once."""
    seen: defaultdict[tuple[str, str, str], int] = defaultdict(int)
    for (what, lang), counted in held.items():
        for token, n in counted.items():
            if what == "dot":
                if 0 < len(last := _last_word(token)) <= 6:
                    seen["dot", lang, last.lower()] += n
            elif what != "token":
                seen[what, lang, _DIGITS.sub("9", token) if what == "begins" else token] += n
            else:
                bare = token
                if not token.isalpha():
                    bare = token.strip(_SIGNS)  # stripped of its signs
                    if not bare.isascii():
                        bare = unicodedata.normalize("NFC", bare)
                    if not bare.isalpha() and not (lang == "hi" and _DEVANAGARI.match(bare)):
                        continue
                if len(bare) <= 6:
                    small = bare.lower()
                    seen["word", lang, small] += n
                    if token[-1] == ".":
                        seen["ends", lang, small] += n
                if bare[0].isupper() and len(bare) <= 32:
                    seen["inside", lang, bare] += n
    return seen


def learn(documents: DataFrame, min_count: int = 3, min_share: float = 5e-5, fit_documents: int = 6000) -> Model:
    """The model of a table (text, and lang if there is such a column). Null and empty texts are passed over.

    Words, stops and headings are counted over all documents, added up in the tasks first; what comes to the driver is bounded: a
    form counts if it is seen at least `min_count` times and once in 1 / `min_share` documents. The weights of the chain are fitted
    on the places of at most `fit_documents` documents, those with the smallest hashes; which words tell languages apart is learned
    from the same documents. Equal feature sets are counted together, so the fit itself is as small whatever the texts.
    """
    sc = documents.sparkSession.sparkContext
    label = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.filter("text IS NOT NULL AND text != ''").select("text", label.alias("lang"))
    share = min(1.0, 1.2 * fit_documents / max(texts.count(), 1))
    few = texts.filter(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)) < F.lit(int(share * (1 << 31))))
    sample = stored(few.orderBy(F.xxhash64("text"), "text").limit(fit_documents).repartition(16, "text"), "sentence_sample")
    languages = fit_languages(sample.toPandas())
    known = sc.broadcast(Model({}, {}, {}, frozenset(), frozenset(), languages, {}))

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame() -> pd.DataFrame:
            seen = {("documents", "", ""): count} | _counts(held)
            return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "a", "b", "n"])

        held: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        count = read = 0
        for b in batches:
            count += len(b)
            for text in b["text"]:
                _gather(text, known.value, held)
                read += len(text)
            if read > MOST_READ or sum(map(len, held.values())) > MOST_COUNTED:
                yield frame()
                held, count, read = defaultdict(Counter), 0, 0
        yield frame()

    rows = texts.select("text").mapInPandas(observe, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    rows = stored(rows, "sentence_counts")
    total = rows.filter("kind = 'documents'").agg(F.sum("n")).first()[0] or 0
    often = rows.filter(F.col("n") >= max(min_count, int(min_share * total)))
    few = often.filter(F.col("kind").isin("dot", "word", "ends", "start", "alone"))
    same = {"inside": few.filter("kind = 'start'").select("a", "b"), "begins": few.filter("kind = 'alone'").select("a", F.split("b", " ")[0].alias("b")).distinct()}
    for kind, wanted in same.items():
        few = few.unionByName(rows.filter(F.col("kind") == kind).join(wanted, ["a", "b"], "left_semi"))
    table: dict[str, dict[tuple[str, str], int]] = {}
    for r in few.collect():
        table.setdefault(r["kind"], {})[r["a"], r["b"]] = r["n"]

    def odds(p: float, q: float, prior: float = 0.5) -> float:
        return math.log((p + prior) / (q + prior))

    dots, plain, ends, inside = (table.get(k, {}) for k in ("dot", "word", "ends", "inside"))
    abbreviation = {k: odds(n, max(0, plain.get(k, 0) - n)) for k, n in dots.items()}
    both: Counter = Counter()
    for (_, w), n in plain.items():
        both[w] += n
    tips: Counter = Counter()
    for (_, w), n in ends.items():
        tips[w] += n
    stopped = {k: ends.get(k, 0) / n for k, n in plain.items()} | {("", w): tips[w] / n for w, n in both.items()}
    starter = {k: odds(n, 0.02 * max(0, inside.get(k, n) - n)) for k, n in table.get("start", {}).items() if k[1][0].isupper()}
    for learned in (abbreviation, starter):  # passages in another language than their document's
        for (_, word), v in list(learned.items()):
            learned["", word] = max(v, learned.get(("", word), v))
    begins = table.get("begins", {})
    headings = {f for (_, f), n in table.get("alone", {}).items() if n >= 0.3 * begins.get(("", f.split(" ")[0]), n)}
    first = {h[0] for h in headings} | (set("0123456789") if any(h[0] == "9" for h in headings) else set())
    model = Model(abbreviation, starter, stopped, frozenset(headings), frozenset(first), languages, {})

    sent = sc.broadcast(model)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                for joined, look in _examples(text, sent.value):
                    seen["\t".join(look), joined] += 1
        yield pd.DataFrame([(k, j, n) for (k, j), n in seen.items()], columns=["look", "joined", "n"])

    shown = sample.select("text").mapInPandas(examples, "look string, joined boolean, n long").groupBy("look").agg(F.sum(F.when(F.col("joined"), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("joined"), 0).otherwise(F.col("n"))).alias("all"))
    fitted = replace(model, weights=fit_weights(shown.toPandas()))
    again = sc.broadcast(fitted)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [0.0] * 4
        for b in batches:
            for text in b["text"]:
                tags = [w > 0 for _, w, _ in candidates(text, again.value) if UNLIKELY < w < SURE]
                for x, y in zip(tags, tags[1:]):
                    seen[2 * x + y] += 1
        yield pd.DataFrame({"move": range(4), "n": seen})

    counts = {r["move"]: r["n"] for r in sample.select("text").mapInPandas(steps, "move int, n double").groupBy("move").agg(F.sum("n").alias("n")).collect()}
    return replace(fitted, moves=fit_moves([counts.get(k, 0.0) for k in range(4)]))


def fit_moves(counts: list[float]) -> tuple[float, float, float, float]:
    """The log of how much oftener each of the four moves comes than neighbouring tags would meet by chance."""
    total = sum(counts) + 4
    first = [(counts[2 * x] + counts[2 * x + 1] + 2) / total for x in (0, 1)]
    second = [(counts[y] + counts[2 + y] + 2) / total for y in (0, 1)]
    return tuple(math.log((counts[2 * x + y] + 1) / total / (first[x] * second[y])) for x in (0, 1) for y in (0, 1))


def _features(look: tuple[str, ...]) -> list[str]:
    """Names of the features of a place, see `_look`: its parts, and pairs and triples of parts that say more together."""
    if look[0] == "gap":
        return [f"gap {look[1]}|{look[2]}"]
    lang, mark, closed, gap, after, last, abbr, stopped, start, shape, stray = look
    parts = {"k": mark, "c": closed, "g": gap, "a": after, "l": last, "b": abbr, "r": stopped, "s": start, "n": shape, "L": lang, "m": stray}
    sets = ["k", "c", "g", "a", "l", "b", "r", "s", "n", "kc", "kg", "ka", "kcg", "kca", "cga", "gal", "gab", "gar", "al", "ab", "ar", "as", "lb", "lr", "ls", "br", "bs", "rs", "rsn", "lrs", "brs", "sn", "an", "Lk", "Lkc", "Lkca", "La", "Lka", "Lkga", "Lal", "Lar", "Lg", "Ln", "m", "ma"]
    unknown = {i for i in "rs" if parts[i] == "-"}  # what has not been seen says nothing
    return [f"{x}:" + "|".join(parts[i] for i in x) for x in sets if unknown.isdisjoint(x)]


def fit_weights(shown: pd.DataFrame, ridge: float = 1.0, rounds: int = 3, least: float = 0.1) -> dict[str, float]:
    """Weights of features from (look, ends, all): how often a look was seen where paragraphs were put together, and in running text.

    First a log-linear model tells the one from the other; its odds are in proportion to the chance of a boundary, and what all but
    the share `least` of the examples reach stands for certainty. Then the chances of running text are fitted themselves, examples being certain, and
    once more with the chances so found. Places with and without a gap are put in proportion apart, as missing spaces are rare.
    """
    if not len(shown):
        return {}
    looks = [tuple(x.split("\t")) for x in shown["look"]]
    names = [_features(x) for x in looks]
    index = {f: i for i, f in enumerate(sorted({f for x in names for f in x}))}
    x = np.zeros((len(looks), len(index) + 1))
    for row, x_names in zip(x, names):
        row[[index[f] for f in x_names]] = 1.0
    x[:, -1] = 1.0
    group = np.array(["gap" if k[0] == "gap" else k[0] + k[3] for k in looks])
    ends, every = shown["ends"].to_numpy(float), shown["all"].to_numpy(float)
    chance = np.zeros(len(looks))
    for g in np.unique(group):
        own = group == g
        e, a = ends[own], every[own]
        part = x[own][:, x[own].any(0)]
        odds = np.exp(np.clip(part @ _logistic(part, e / max(e.sum(), 1.0), a / max(a.sum(), 1.0), len(e), ridge), -30, 30))
        order = np.argsort(odds)
        low = order[min(len(order) - 1, int(np.searchsorted(np.cumsum(e[order]), least * e.sum())))]
        chance[own] = np.clip(odds / odds[low], 0.0, 1.0) if e.sum() else 0.0
    out = {}
    for own, kind in ((group == "gap", "gap"), (group != "gap", "stop")):
        columns = np.flatnonzero(x[own].any(0))
        part, e, a, now, w = x[own][:, columns], ends[own], every[own], chance[own], np.zeros(len(columns))
        for _ in range(rounds if len(e) else 0):
            sharp = np.where(e > 0.5 * a, np.maximum(now, 0.5), now)
            w = _logistic(part, a * sharp + e, a * (1 - sharp), a.sum(), ridge, w)
            now = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
        known = dict(zip(columns, w))
        out |= {f: float(known[i]) for f, i in index.items() if i in known} | {kind: float(known.get(x.shape[1] - 1, 0.0))}
    return out


def _logistic(x: np.ndarray, yes: np.ndarray, no: np.ndarray, scale: float, ridge: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic model of rows seen `yes` and `no` times, by Newton steps."""
    n = (yes + no) * scale / max((yes + no).sum(), 1e-12)
    y = yes / np.maximum(yes + no, 1e-12)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 0.01:
            break
    return w


def _spans(text: str, edges: list[int]) -> list[tuple[int, int]]:
    """Outermost (start, end) of paired marks, paired within a paragraph only; unpaired marks are ignored."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    edge = iter([*edges, len(text) + 1])
    limit = next(edge)
    for m in _PAIRED.finditer(text):
        c, p = m.group(), m.start()
        if len(c) > 1:  # a pair with no mark inside
            out.append(m.span())
            continue
        while p >= limit:
            stack, limit = [], next(edge)
        if c not in CLOSE:
            stack.append((c, p))
            continue
        if c == '"':
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
        elif c == "“" and not any(s[0] == "„" for s in stack):
            found = None
        elif stack and PAIRS.get(stack[-1][0]) == c:
            found = len(stack) - 1
        else:
            found = next((k for k in range(len(stack) - 1, -1, -1) if PAIRS.get(stack[k][0]) == c or (c == "”" and stack[k][0] == "„")), None)
            if found is None:
                continue
        if found is None:
            stack.append((c, p))
            continue
        out.append((stack[found][1], p + 1))
        del stack[found:]
    out.sort(key=lambda s: (s[0], -s[1]))
    outer: list[tuple[int, int]] = []
    for s in out:
        if not outer or s[0] >= outer[-1][1]:
            outer.append(s)
    return outer


def _claims(text: str, sure: set[int]) -> dict[int, int]:
    """Start -> number of the claims: the last run of labels 1, 2, 3 ... whose first begins a paragraph or line."""
    if not (first := _FIRST_LABEL.match(text) or _FIRST_LABEL_LINE.search(text)):
        return {}
    labels = [(m.start(), int(m.group(2) or m.group(4) or m.group(5)), m.group(1) or m.group(3) or m.group(6)) for m in _LABEL.finditer(text, first.start(1))]
    for k in range(len(labels) - 1, -1, -1):
        at, n, style = labels[k]
        if n != 1:
            continue
        head = _trimmed(text, at)
        if not (at == 0 or at in sure or _PARAGRAPH.search(text, head, at) is not None):
            continue
        if not (at == 0 or text[_trimmed(text, at, " \t　") - 1 : at].startswith("\n")):
            continue
        run, want = {at: 1}, 2
        for p, v, own in labels[k + 1 :]:
            if v == want and own == style and _opens_claim(text, p):
                run[p] = v
                want += 1
        return run
    return {}


def _trimmed(text: str, end: int, blank: str | None = None) -> int:
    """Where text[:end] ends without the white space, or the characters of `blank`, at its end; nothing is copied."""
    while end and (text[end - 1].isspace() if blank is None else text[end - 1] in blank):
        end -= 1
    return end


def _opens_claim(text: str, p: int) -> bool:
    head = _trimmed(text, p)
    last = text[max(0, head - 1) : head]
    if "ก" <= last <= "๎":  # Thai sentences end without a sign
        return True
    return text[p - 1 : p] == "\n" or last in STOPS or last in CLOSE or text[p] in "[【" or "\n" in text[head:p]


UNLIKELY, SURE, LIMIT = -1e9, 20.0, 6.0  # log odds beyond LIMIT say no more


def _stops(text: str, lang: str, spans: list[tuple[int, int]], model: Model) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(place, where the text goes on, look) of every place behind a stop, with its closing marks and stray words, outside of paired marks."""
    k, size, latin = 0, len(text), lang in model.languages or lang == "latin"
    inner, outer = spans[0] if spans else (size, size)
    for m in _PLACE.finditer(text):
        s, p = m.span(1)
        while outer <= s < size:
            k += 1
            inner, outer = spans[k] if k < len(spans) else (size, size + 1)
        if inner < p < outer:
            continue
        mark, word = m.group(1, 2)
        if lang == "th" and "." in mark and not re.search("[A-Za-z]{4}$", text[max(0, s - 4) : s]):
            continue
        q, stray = m.start(2), False
        first = max(0, s - 24)
        token = text[max(first, text.rfind(" ", first, s) + 1) : s]
        if latin and p < q < size and (first == s - len(token) or "぀" <= text[q] <= "鿿" or text.startswith(token, q) or "\n" in token):
            end = _stray(text, s, p, q)
            if stray := end != p:
                p = q = end
                while q < size and text[q].isspace():
                    q += 1
                word = m.group() if (m := _WORD_AFTER.match(text, q)) else ""
        yield p, q, _look(text, mark, s, p, q, token, word, stray, (inner, outer) if outer <= p and k < len(spans) else None, lang, model)


def _gaps(text: str) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(place, look) of every gap, for text without stops: the kinds of characters on both sides."""
    for m in _GAP.finditer(text):
        yield m.end(), ("gap", _char_class(text[m.start() - 1 : m.start()]), _char_class(text[m.end() : m.end() + 1]))


def _bucket(v: float | None, ends: tuple[float, ...]) -> str:
    return "-" if v is None else "012345"[bisect_left(ends, v)]


@cache
def _mark_kind(mark: str) -> str:
    if any(c in WIDE for c in mark):
        return "w"
    if any(c in "।॥" for c in mark):
        return "d"
    return "|" if "|" in mark else "e" if mark[:2] == ".." or mark[0] == "…" else "!" if mark[0] in "!?" else "."


@cache
def _after_kind(c: str) -> str:
    """The kind of the character after a place; '(' for brackets, which need a closer look."""
    if not c:
        return "$"
    if c.isupper():
        return "U"
    if c.islower():
        return "l"
    if c.isdigit():
        return "d"
    if _CJK.match(c):
        return "c"
    if c.isalpha() or _char_class(c) == "letter":
        return "o"
    return "," if c in ",;:%)]" else "q" if c in "“„«" else "i" if c in "¿¡" else "(" if c in "([（" else "-"


@cache
def _is_cjk(c: str) -> bool:
    return _CJK.match(c) is not None


def _tail(before: str, lang: str, dot: bool, model: Model) -> tuple[str, str, str]:
    """The form of the last word or number of a piece of text, how often the word is an abbreviation, and how often it has a stop."""
    end = before[-1:]
    last = _last_word(before)
    if last and _is_cjk(end):
        return "c", "-", "-"
    if last:
        size = ("I" if last.isupper() and len(last) == 1 else "W" if last.isupper() else "") + str(min(len(last), 5))
        if len(last) == 1 and _ACRONYM.search(before):
            size = "A"
    elif end.isdecimal():
        digits = _NUMBER.search(before).group().strip()
        size = "N" if not digits.isdigit() or len(digits) > 2 else "#" if _LABELLED.search(before) else "n"
    else:
        size = " " if not end or end.isspace() else ")" if end in CLOSE or end in ")]%" else "-"
    return size, *(model.last_word(lang, last.lower()) if dot and 0 < len(last) <= 6 else ("-", "-"))


def _look(text: str, mark: str, s: int, p: int, q: int, token: str, word: str, stray: bool, group: tuple[int, int] | None, lang: str, model: Model) -> tuple[str, ...]:
    """The kinds of everything around a place: language, stop, closing mark, gap, what follows, the last word, how often it is an
    abbreviation and has a stop, how often the next word begins paragraphs, the next word's form, and whether words are astray.

    The mark is at `s`, behind `token`, the place at `p`, and the text goes on with `word`, or another sign, at `q`."""
    kind = _mark_kind(mark)
    dot = kind == "."
    after = text[q : q + 1]
    closed = ""
    if len(mark) > 1 and mark[-1] in CLOSE:
        closed = "x"
        if group is not None:
            before = text[max(0, group[0] - 40) : group[0]]
            head = before.rstrip()[-1:]
            opens = not head or head in STOPS or head in CLOSE or head == ":" and "\n" in before[len(before.rstrip()) :] or bool(_NUMBERED.search(before))
            closed = ("q" if text[group[0]] in QUOTES else "b") + str(int(opens))
    kind_after = _after_kind(after)
    if kind_after == "(":
        if _NUMBERED.match(text[q : q + 12]):
            kind_after = "#"
        else:  # a bracket that ends with a stop holds sentences
            close = text.find(PAIRS[after], q)
            kind_after = "S" if close > 0 and text[close - 1] in STOPS else "("
    end = token[-1:]
    if not end or end.isdecimal() or end.isspace():  # numbers and gaps need more than the token
        before = text[max(0, s - 24) : s]
        size, abbr, stopped = _tail(before.rstrip() if mark[0] in "!?" else before, lang, dot, model)
    elif end >= "぀" and _is_cjk(end) and end.isalpha():
        size, abbr, stopped = "c", "-", "-"
    else:
        size, abbr, stopped = model.tails[lang, dot].get(token) or model.tail(lang, dot, token)
    start, shape = (model.nexts[lang].get(word) or model.next_word(lang, word)) if word else ("-", "")
    if kind_after in "co":
        shape = ""
    return lang, kind, closed, "s" if q > p else "0", kind_after, size, abbr, stopped, start, shape, "1" if stray else "0"


def _layout(text: str, model: Model) -> tuple[list[int], list[tuple[int, int]], list[int], list[int]]:
    """Where paragraphs begin, numbered lines among them, the paired marks, and the starts and ends of headings."""
    breaks = [m.span() for m in _PARAGRAPH.finditer(text)]
    edges = [a for a, _ in breaks]
    begins = sorted({0, *(b for _, b in breaks), *(m.end() for m in _NUMBERED_LINE.finditer(text))})
    starts, ends = [], []
    for s in begins:
        if end := _heading_end(text, s, model):
            ends.append(end)
    at = -1
    while (at := text.find("\n", at + 1)) >= 0:  # headings without a blank line before them
        if (head := text[at + 1 : at + 2]) in model.first and head != "\n" and (end := _heading_end(text, at + 1, model)):
            last = _trimmed(text, at)
            if (sign := text[max(0, last - 1) : last]) in STOPS or sign in CLOSE:
                starts.append(at + 1)
                ends.append(end)
    return begins, _spans(text, edges), starts, ends


def _mended(text: str) -> str:
    for damaged, mark in DAMAGED:
        if damaged in text:
            text = text.replace(damaged, mark)
    return text


def candidates(text: str, model: Model) -> list[tuple[int, float, bool]]:
    """(place, weight of a unit starting there, whether the label of the next claim is there), in order."""
    text = _mended(text)
    lang, weights = model.language(text), {}
    begins, spans, starts, ends = _layout(text, model)

    end = len(text)

    def put(p: int, w: float) -> None:
        while p < end and text[p].isspace():
            p += 1
        if p < end and w > weights.get(p, UNLIKELY):
            weights[p] = w

    for p in (*begins, *starts, *ends):
        put(p, SURE)
    sure = {*weights, *ends}
    if lang == "th":
        for p, look in _gaps(text):
            put(p, model.weight(look))
    for _, p, look in _stops(text, lang, spans, model):
        if p < end and (w := model.weight(look)) > weights.get(p, UNLIKELY):
            weights[p] = w
    numbers = _claims(text, sure)
    out, k = [], 0
    for p in sorted({*weights, *numbers}):
        w = weights.get(p, UNLIKELY)
        while k < len(spans) and spans[k][1] <= p:
            k += 1
        if w < SURE and k < len(spans) and spans[k][0] < p:
            w = UNLIKELY
        out.append((p, w, p in numbers))
    return out


def _examples(text: str, model: Model) -> Iterator[tuple[bool, tuple[str, ...]]]:
    """(whether from paragraphs put together, look) of the places of one text, its headings and claims left out.

    A line that begins with a bracketed paragraph number is a paragraph too.
    """
    text = _mended(text)
    lang = model.language(text)
    begins, spans, starts, ends = _layout(text, model)
    claims = _claims(text, {*begins, *ends, *(e + len(text[e:]) - len(text[e:].lstrip()) for e in ends)})
    body = text[: min(claims, default=len(text))]
    cuts = sorted({len(body), *begins, *starts, *ends})
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        if b <= len(body) and not (b in ends and (a in starts or a in begins)) and (part := body[a:b].strip()):
            parts.append((part, a + len(body[a:b]) - len(body[a:b].lstrip())))
    for part, _ in parts:
        if lang == "th":
            yield from ((False, look) for x in (part, _stripped(part)) for _, look in _gaps(x))
        else:
            yield from ((False, look) for p, _, look in _stops(part, lang, _spans(part, []), model) if p < len(part))
    for (left, _), (right, _) in zip(parts, parts[1:]):
        right = right[:300]
        if lang == "th":
            right = _NUMBERED.sub("", right).lstrip()
            for x, y in ((left, right), (_stripped(left).rstrip(), _stripped(right).lstrip())):
                yield from ((True, look) for p, look in _gaps(f"{x} {y}") if p == len(x) + 1)
            continue
        for one in {left + gap + x for gap in (" ", "") for x in (right, _NUMBERED.sub("", right).lstrip())}:
            yield from ((True, look) for p, _, look in _stops(one, lang, _spans(one, []), model) if p == len(left))


def _stripped(text: str) -> str:
    """The text without its signs."""
    return "".join(c for c in text if c.isspace() or _char_class(c) != "sign")


def _heading_end(text: str, s: int, model: Model) -> int:
    """The end of the heading at `s`, 0 if there is none. A heading may be broken over two lines."""
    if text[s : s + 1] not in model.first:
        return 0
    end = text.find("\n", s)
    for _ in range(2):
        if end < 0 or end - s > MOST_FORM:
            return 0
        if (form := _heading_form(text[s:end])) and form in model.headings:
            return end
        end = text.find("\n", end + 1)
    return 0


def _stray(text: str, s: int, p: int, q: int) -> int:
    """The end of what rough translation left behind the stop at `s`: a lone word of another script, or the last word once more.

    Such words were put in after a word of the sentence, so they belong to the sentence before. The gap is from `p` to `q`.
    """
    first = text[q]
    if "぀" <= first <= "鿿" and (foreign := _FOREIGN.match(text, q)):
        return foreign.end()
    k = text.rfind(" ", 0, s) + 1
    k = max(k, text.rfind("\n", k, s) + 1)
    if first == text[k] and text.startswith(text[k:p], q):
        again = q + p - k
        if again == len(text) or text[again].isspace():
            return again
    return p


ENTER, NEXT = 60.0, 20.0  # weights of a first claim's label and of each label that follows in its number


def viterbi(places: list[tuple[int, float, bool]], moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> list[int]:
    """The starts of the best tagging of (place, weight of a boundary, whether the label of the next claim is there).

    `moves` are the weights of (inside, inside), (inside, boundary), (boundary, inside) and (boundary, boundary) at neighbouring
    places. Once in the claims, their labels start units and nothing else does.
    """
    inside, boundary, claims = 0.0, UNLIKELY, UNLIKELY
    stay, open_, shut, again = moves
    back: list[tuple[int, int, int]] = []  # the state before, of inside (0), boundary (1) and claims (2)
    for _, w, label in places:
        to_claims = 2
        if label:
            best, prose = (1, boundary) if boundary > inside else (0, inside)
            if prose + ENTER >= claims + NEXT:
                to_claims = best
            claims = max(prose + ENTER, claims + NEXT) + max(0.0, w)
        kept, shuts, opens, repeats = inside + stay, boundary + shut, inside + open_, boundary + again
        to_inside, inside = (1, shuts) if shuts > kept else (0, kept)
        to_boundary, boundary = (1, repeats + w) if repeats > opens else (0, opens + w)
        back.append((to_inside, to_boundary, to_claims))
    out: list[int] = []
    state = 2 if claims >= max(inside, boundary) else 1 if boundary > inside else 0
    for (p, _, label), before in zip(reversed(places), reversed(back)):
        if state == 1 or state == 2 and label:
            out.append(p)
        state = before[state]
    return out[::-1]


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """Units of one text as (start, end) offsets without surrounding white space; null and blank texts have none."""
    if not text or text.isspace():
        return []
    starts = viterbi(candidates(text, model), model.moves)
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        piece = text[a:b].rstrip()
        if piece:
            out.append((a, a + len(piece)))
    return out


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sent_start, sent_end): every sentence of every document, as code-point offsets.

    Headings on lines of their own and claims with their labels are one unit each. Null, empty and blank texts give no rows;
    repeated documents are split each on their own. Whole texts are read, once to learn the model (unless one is given) and
    once to split.
    """
    fitted = documents.sparkSession.sparkContext.broadcast(model or learn(documents))

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = fitted.value
        for b in batches:
            units = [split(text, known) for text in b["text"]]
            ends = np.fromiter(chain.from_iterable(chain.from_iterable(units)), np.int32).reshape(-1, 2)
            frame = pd.DataFrame({"doc_id": b["doc_id"].to_numpy().repeat(np.fromiter(map(len, units), np.int64)), "sent_start": ends[:, 0], "sent_end": ends[:, 1]})
            yield frame.astype({"doc_id": "Int64"}) if frame["doc_id"].dtype.kind == "f" else frame

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tag, "doc_id long, sent_start int, sent_end int")
