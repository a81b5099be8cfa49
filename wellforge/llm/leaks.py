"""Evaluation texts that leaked into documents: template canonicalisation, a hash join of template windows, slot checks.

A text becomes a stream of words in one spelling, in which every number is a placeholder, a unit after it another one, and every
name a third. A word is a name unless its share of all texts is above `ordinary_share` beyond chance: the words of templates are
ordinary, what fills their slots is not. A window is a slot with the template on one side of it; its key is a hash of the typed
window and of the slot's value. Windows of documents and of items are two tables joined by key. Each pair of texts that share a
window is aligned from there in both directions over exchanged words, and the slots along the alignment are compared: where the
names agree it is a leak, where the template is the same with other names it is the item with other parameters.

The slot's value is part of the key because the template alone pairs every document with every item of its template. Stretches of
an item without any name have windows of their own: every three words, every six letters in Chinese and Japanese.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellforge.session import stored

#: Units of measure, which a template replaces by one placeholder.
UNITS = frozenset("mm cm m km nm um ml l kg g mg s min h hr rpm hz khz mhz c f k v w kw pa kpa mpa bar".split())
#: Letters of other alphabets that look like Latin ones, and letters without a decomposition.
LOOKALIKES = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "н": "h", "в": "b"}
    | {"α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "τ": "t", "ε": "e"}
    | {"ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "a", "œ": "o", "ſ": "s"}
    | dict.fromkeys("­​‌‍⁠﻿", "")
)
#: Spellings that are read alike.
FOLDS = (("rn", "m"), ("vv", "w"), ("ae", "a"), ("oe", "o"), ("ue", "u"))

_LOOKS = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_ACCENT = re.compile("[̀-ͯ]+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n\s*(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+")
_LETTER = re.compile("[" + "".join(c for c in map(chr, (*range(0x3040, 0x3100), *range(0x3400, 0xA000))) if c.isalnum()) + "]")
_LETTER_TOKEN = re.compile(f"{_LETTER.pattern}+|[^\\W_぀-ヿ㐀-鿿]+")
_NUMBER = re.compile("#[^ ]*")
_NUMBERS = re.compile("#[^ ]+(?: #[^ ]+)+")
_LONG = re.compile("[^ ]{2,}")
_BROKEN = re.compile("[Â-ô][\u0080-¿Œ-Ÿˆ˜–-›€™]{1,3}")


def _repair(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


def _latin(m: re.Match) -> str:
    return m.group().translate(LOOKALIKES)


def _plain(text: str) -> str:
    """The text without case, accents, letters of other alphabets and compatibility forms. Each part between white space stands alone."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFKD", text))).casefold()
    return _LOOKS.sub(_latin, text) if _LOOKS.search(text) else text


def _tokens(text: str) -> str:
    """The tokens of a text without case and accents, joined by spaces; numbers one by one."""
    for a, b in FOLDS:
        text = text.replace(a, b)
    if text.isalpha() and (text.isascii() or not _CJK.search(text)):
        return text
    if text.isascii() or not _CJK.search(text):
        return " ".join([w if w.isalpha() else "#" + w for w in _TOKEN.findall(text)])
    return " ".join([" ".join(w) if _LETTER.match(w) else w if w.isalpha() else "#" + w for w in _LETTER_TOKEN.findall(text)])


class _Spellings(dict):
    """The tokens of each part of a text that stands between white space. Short parts come again and again and are kept, at most `most`."""

    def __init__(self, most: int = 200_000, longest: int = 40):
        self.most, self.longest = most, longest

    def __missing__(self, part: str) -> str:
        out = _tokens(_plain(part))
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[part] = out
        return out


_spellings = _Spellings()
#: What may stand at the end of a line whose last word goes on in the next one, and what is nothing or white space in a plain text.
_HYPHENS = frozenset("-\u2010\u2011\ufe63\uff0d")
_BLANKS = "".join(c for c in map(chr, (*range(0x3001), *range(0xFE00, 0x10000))) if not _plain(c).strip())


def _parts(text: str) -> list[str]:
    """The tokens of a text, part by part as they stand between white space; a text with words that go on in the next line as one part."""
    if not text.isascii() and ("Ã" in text or "Â" in text or "â" in text):
        text = _BROKEN.sub(_repair, text)
    if "\n" in text and any(line.rstrip(_BLANKS)[-1:] in _HYPHENS for line in text.split("\n")[:-1]):
        return list(filter(None, [_tokens(_HYPHEN.sub("", _plain(text)))]))
    return list(filter(None, map(_spellings.__getitem__, text.split())))


def _joined(parts: list[str]) -> str:
    """The tokens of all parts, joined by spaces, neighbouring numbers as one."""
    return _NUMBERS.sub(lambda m: m.group().replace(" #", "."), " ".join(parts))


def canonical(text: str | None) -> list[str]:
    """The words of a text in a spelling that ignores case, accents, signs, spacing, line breaks and encoding damage.

    Words that hold a digit are numbers: '#' with their value, neighbouring ones as one. Chinese and Japanese letters are words.
    """
    parts = _parts(text) if text else []
    return _joined(parts).split(" ") if parts else []


def words(tokens: list[str]) -> list[str]:
    """The tokens that are no numbers: what counts in a run."""
    return [w for w in tokens if w[0] != "#"]


def is_letterwise(tokens: list[str]) -> bool:
    return 2 * sum(1 for w in tokens if len(w) == 1 and _CJK.match(w)) > len(tokens)


SIDE, LETTERS = 2, 6  # tokens of the template beside a slot; letters of a window in Chinese and Japanese
PLAIN = 3  # words of a window without a slot: two errors in 16 words leave five in a row
SALTS = 8  # parts of the rows of a window that many documents share


def _hash(b: bytes) -> int:
    return xxhash.xxh64_intdigest(b) - (1 << 63)


def _is_name(w: str, ordinary: frozenset[str]) -> bool:
    return len(w) > 1 and w[0] != "#" and w not in ordinary


def slot_windows(tokens: list[str], ordinary: frozenset[str]) -> Iterator[tuple[int, int]]:
    """(position among the words, key) of the typed windows to the left and right of every slot that holds a name."""
    yield from _windows_of(tokens, ordinary, {w for w in set(tokens) if _is_name(w, ordinary)})


def _name_key(w: str) -> int:
    return _hash(b"|" + w.encode())


def _windows_of(tokens: list[str], ordinary: frozenset[str], slots: set[str]) -> Iterator[tuple[int, int]]:
    """The windows of `slot_windows` beside the names `slots`."""

    def typed(t: str) -> str:
        return "\x03" if t[0] == "#" else "\x02" if t in UNITS else "\x01" if _is_name(t, ordinary) else t

    at, counted = -1, 0
    for p in [p for p, w in enumerate(tokens) if w in slots]:
        at, counted, w = at + sum(t[0] != "#" for t in tokens[counted : p + 1]), p + 1, tokens[p]
        for side, part in (("<", tokens[max(0, p - SIDE) : p]), (">", tokens[p + 1 : p + 1 + SIDE])):
            if len(part) == SIDE:
                yield at, _hash(f"{side}{w} {typed(part[0])} {typed(part[1])}".encode())


def _letters(canon: str) -> str:
    """One sign for each word of a text in tokens: the word itself if it is a single letter."""
    return _LONG.sub("\x02", _NUMBER.sub("", canon)).replace(" ", "")


def letter_windows(own: list[str]) -> Iterator[tuple[int, str]]:
    """(position, letters) of every run of LETTERS single letters among the words."""
    text = _letters(" ".join(own))
    for p in range(len(text) - LETTERS + 1):
        piece = text[p : p + LETTERS]
        if "\x02" not in piece:
            yield p, piece


def letter_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of `letter_windows` of several texts as `_letters` gives them: which text, position, key."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.frombuffer("\x02".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(0, len(codes) - LETTERS + 1)
    keys, apart = np.full(n, 0x9E3779B97F4A7C15, np.uint64), np.zeros(n, bool)
    for i in range(LETTERS):
        keys = (keys ^ codes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
        apart |= codes[i : i + n] == 2
    at = np.flatnonzero(~apart)
    which = np.searchsorted(ends, at, side="right")
    return which, at - np.concatenate([[0], ends])[which], keys[at].view(np.int64)


def _held_letters(texts: list[tuple[int, str]], keys: KeySet, most: int = 100_000) -> Iterator[tuple[int, int, int, str]]:
    """(id, position, key, letters) of the windows of (id, letters) that are in a set, looked up together for about `most` letters."""
    start = size = 0
    for end, (_, letters) in enumerate(texts, 1):
        size += len(letters)
        if size >= most or end == len(texts):
            group = texts[start:end]
            which, at, own = letter_keys([x for _, x in group])
            held = keys.held(own)
            for t, p, k in zip(which[held].tolist(), at[held].tolist(), own[held].tolist()):
                yield group[t][0], p, k, group[t][1][p : p + LETTERS]
            start, size = end, 0


def plain_windows(own: list[str]) -> Iterator[tuple[int, int]]:
    """(position, key) of every PLAIN words in a row."""
    for p in range(len(own) - PLAIN + 1):
        yield p, _hash(("~" + " ".join(own[p : p + PLAIN])).encode())


def _bare(marked: list[bool], least: int) -> list[bool]:
    """Which positions lie in a stretch of at least `least` positions without a mark."""
    out, start = [False] * len(marked), 0
    for i, m in enumerate([*marked, True]):
        if m:
            if i - start >= least:
                out[start:i] = [True] * (i - start)
            start = i + 1
    return out


def _alike(a: str, b: str) -> bool:
    """The same word, or a longer one with a single letter misread."""
    if a == b:
        return True
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _extend(item: list[str], doc: list[str], i: int, j: int, step: int) -> list[tuple[int, int, int]]:
    """Extents from (i, j) in one direction that end in a match: (words of the item, errors, its last position)."""
    out, n, errors, recent = [(0, 0, i - step)], 0, 0, 0

    def at(x: list[str], k: int) -> str | None:
        return x[k] if 0 <= k < len(x) else None

    while 0 <= i < len(item) and 0 <= j < len(doc):
        a, b = item[i], doc[j]
        if _alike(a, b):
            n, recent = n + 1, 0
            out.append((n, errors, i))
            i, j = i + step, j + step
            continue
        a2, b2 = at(item, i + step), at(doc, j + step)
        if a2 is not None and (a + a2 if step > 0 else a2 + a) == b:
            n, i, j = n + 2, i + 2 * step, j + step
            out.append((n, errors, i - step))
            continue
        if b2 is not None and (b + b2 if step > 0 else b2 + b) == a:
            n, i, j = n + 1, i + step, j + 2 * step
            out.append((n, errors, i - step))
            continue
        errors, recent = errors + 1, recent + 1
        if recent > 3 or errors > 2 + (n + 16) / 8:
            break
        if a2 is not None and b2 is not None and a2 == b2:
            n, i, j = n + 1, i + step, j + step
        elif b2 is not None and a == b2:
            j += step
        elif a2 is not None and a2 == b:
            n, i = n + 1, i + step
        else:
            n, i, j = n + 1, i + step, j + step
    return out


def best_run(item: list[str], doc: list[str], i: int, j: int, most: float) -> tuple[int, int, int, int]:
    """The longest run of the item through item[i] = doc[j] with at most `most` of its words exchanged: (words, errors, from, to)."""
    right, left = _extend(item, doc, i, j, 1), _extend(item, doc, i - 1, j - 1, -1)

    def furthest(x: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        by: dict[int, tuple[int, int, int]] = {}
        for e in x:
            by[e[1]] = max(by.get(e[1], e), e)
        return by

    best = (0, 0, i, i)
    for r in furthest(right).values():
        for s in furthest(left).values():
            n, errors = r[0] + s[0], r[1] + s[1]
            if errors <= most * n and n > best[0]:
                best = (n, errors, s[2], r[2])
    return best


def _goes_on(a: list[str], b: list[str], i: int, j: int, step: int, letters: bool) -> bool:
    """Whether the texts, unlike from a[i] and b[j] on, are alike again: three words in a row (four letters) after a few others,
    or three of the next eight words (six of 16 letters) in their places."""
    gap, again, near, few = (6, 4, 16, 6) if letters else (3, 3, 8, 3)
    places = [(i + k * step, j + k * step) for k in range(near)]
    if sum(0 <= x < len(a) and 0 <= y < len(b) and _alike(a[x], b[y]) for x, y in places) >= few:
        return True

    def alike(x: int, y: int) -> bool:
        return all(0 <= x + k * step < len(a) and 0 <= y + k * step < len(b) and _alike(a[x + k * step], b[y + k * step]) for k in range(again))

    return any(alike(i + m * step, j + n * step) for m in range(1, gap + 1) for n in range(1, gap + 1))


def _equal_runs(a: list[str], b: list[str], start: int, end: int, shift: int, least: int) -> Iterator[tuple[int, int]]:
    """(from, past the end) of each run of at least `least` words alike along one alignment, inside a[start:end]."""
    begin = None
    for k in range(start, end + 1):
        if k < end and 0 <= k + shift < len(b) and _alike(a[k], b[k + shift]):
            begin = k if begin is None else begin
        elif begin is not None:
            if k - begin >= least:
                yield begin, k
            begin = None


class KeySet:
    """A set of 64-bit keys as a bitmap of a fixed size: every key of the set is in it, and a few others."""

    def __init__(self, bits: int, body: bytes):
        self.mask, self.body = (1 << bits) - 1, body

    def __contains__(self, key: int) -> bool:
        k = key & self.mask
        return (self.body[k >> 3] >> (k & 7)) & 1 == 1

    def held(self, keys: np.ndarray) -> np.ndarray:
        """The indices of those of many keys that are in it."""
        k = keys & self.mask
        return np.flatnonzero((np.frombuffer(self.body, np.uint8)[k >> 3] >> (k & 7).astype(np.uint8)) & 1)


def key_set(keys: DataFrame, n: int, most_bits: int = 27) -> KeySet:
    """The bitmap of a table (key): 2048 bits a key, at most 2 ** most_bits (16 MB); beyond, more keys pass by chance, none is lost."""
    bits = min(most_bits, max(20, math.ceil(math.log2(2048 * max(n, 1)))))
    at = keys.select((F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("k"))
    parts = at.groupBy(F.bitmap_bucket_number("k").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("m")).collect()
    body = bytearray(1 << (bits - 3))
    for r in parts:
        start = (r["b"] - 1) * 4096
        body[start : start + 4096] = r["m"]
    return KeySet(bits, bytes(body))


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    min_words: int = 16,
    min_letters: int = 30,
    exchanged: float = 1 / 8,
    slot_share: float = 0.6,
    ordinary_share: float = 0.005,
) -> DataFrame:
    """(doc_id, item_id, kind, run, errors, numbers_same): documents that hold a run of at least `min_words` words of an item.

    Numbers are not counted, and in Chinese and Japanese letters count, `min_letters` of them. Up to `exchanged` of the run's words
    may differ. `kind` is 'leak' where at least `slot_share` of the names in the run agree, 'reparameterised' where the texts have a
    template in common but not the names. Where a run holds no name of the item, or `min_words` of it in a row are the same, names
    are not asked for, unless the texts go on alike after a few other words, as beside the slot of a template. `numbers_same` is the
    share of the run's numbers that the document has there too, null if the run holds none.

    A word is ordinary if its share of all texts, documents and the different sentences of items, exceeds `ordinary_share` by two
    standard errors; all other words are names. How many items share a sentence plays no part. If a passage is in so many documents that its own names are
    ordinary, it has no slots and is found by its plain windows.
    Null and empty texts and null ids give no rows; a repeated document is reported under each of its ids, a repeated item too.

    Scale: one pass reduces documents to their words, counts these and writes both to the shared folder, one looks for windows,
    however many items there are. A word between white space is spelled once a worker, as long as it is among the 200,000 kept. What is sent to the tasks is a bitmap of at most 16 MB and the ordinary words, of which
    there are at most (different words of a text) / ordinary_share. Only windows that pass the bitmap are joined, salted by
    document, so that a passage in a third of all documents is spread; only documents with such a window are aligned.
    """
    sc = documents.sparkSession.sparkContext
    ids = stored(_canonical(items, "item_id"), "leak_items")
    classes = ids.select(F.col("h").alias("item"), "canon").dropDuplicates(["item"])

    grams = classes.mapInPandas(_item_grams, "key long").distinct()
    gram_count = grams.count()
    held = sc.broadcast(key_set(grams, gram_count)) if gram_count else None
    read = stored(_rows(documents, "doc_id").mapInArrow(_reader(held), "doc_id long, h long, canon string, w string, n long"), "leak_documents")
    docs = read.filter("doc_id is not null").select("doc_id", "h", "canon")
    parts = F.explode(F.split("text", r"(?<=[.!?])\s+(?=\p{Lu})|(?<=[。！？])"))
    sentences = _canonical(items.select("item_id", parts.alias("text")), "item_id").select("canon").distinct()
    counts = read.filter("w is not null").select("w", "n").unionByName(sentences.mapInArrow(_counter(held), "w string, n long"))
    counted = stored(counts.groupBy("w").agg(F.sum("n").alias("n")), "leak_words")
    total = docs.count() + sentences.count()
    common = counted.filter(F.col("n") - 2 * F.sqrt("n") > F.lit(ordinary_share * total))
    ordinary = sc.broadcast(frozenset(r["w"] for r in common.collect()))

    windows = stored(classes.mapInPandas(_item_windows(ordinary, min_words, min_letters), "key long, item long, pos int, kind string"), "leak_windows")
    kinds = {r["kind"]: r["n"] for r in windows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    wanted = sc.broadcast(key_set(windows.select("key"), sum(kinds.values())))
    hit_docs = stored(docs.mapInPandas(_seeker(ordinary, wanted, set(kinds)), "doc_id long, h long, canon string, hits array<struct<p:int,key:long>>"), "leak_hits")

    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    sides = windows.filter("kind != 'name'").withColumn("salt", salt)
    hits = hit_docs.select("doc_id", "h", F.explode("hits").alias("x")).select("doc_id", "h", "x.p", "x.key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    met = hits.join(sides, ["key", "salt"]).groupBy("doc_id", "h", "item").agg(F.collect_set(F.struct((F.col("kind") != "slot").alias("bare"), "pos", "p")).alias("at"))
    both = met.join(hit_docs.select("doc_id", "h", "canon"), ["doc_id", "h"]).join(classes.select("item", F.col("canon").alias("item_canon")), "item")
    columns = ["doc_id", "item", "canon", "item_canon", "at"]
    found = both.select(*columns).mapInPandas(_aligner(ordinary, min_words, min_letters, exchanged, slot_share), "doc_id long, item long, kind string, run int, errors int, numbers_same double")
    best = found.join(ids.select(F.col("h").alias("item"), F.col("id").alias("item_id")), "item").groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("kind") == "leak").alias("leak"), "run", "errors", "numbers_same", "kind")).alias("z"))
    return best.select("doc_id", "item_id", "z.kind", "z.run", "z.errors", "z.numbers_same")


def _rows(texts: DataFrame, id_col: str) -> DataFrame:
    return texts.filter(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "text")


def _canonical(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, h, canon): the tokens of every text with an id, joined by spaces, and their hash."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            canon = [_joined(_parts(t)) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "h": [_hash(c.encode()) for c in canon], "canon": canon})

    return _rows(texts, id_col).mapInPandas(read, "id long, h long, canon string").filter("canon != ''")


class _Counts:
    """How many texts hold each word and, after '=', each letter window of the items."""

    def __init__(self, grams):
        self.grams, self.seen = grams, Counter()

    def add(self, texts: list[tuple[list[str], str]]) -> None:
        """Texts as their parts and as a whole."""
        letters = []
        for i, (parts, canon) in enumerate(texts):
            own = set(parts)
            mixed = [x for x in own if not x.isalpha()]  # several tokens, or a number
            own.difference_update(mixed)
            own.update(_NUMBER.sub("", " ".join(mixed)).split())
            self.seen.update(own)
            if self.grams is not None and not canon.isascii() and _CJK.search(canon):
                letters.append((i, _letters(canon)))
        if letters:
            self.seen.update(["=" + x for _, x in {(i, x) for i, _, _, x in _held_letters(letters, self.grams.value)}])

    def taken(self) -> tuple[list[str], list[int]]:
        seen, self.seen = self.seen, Counter()
        return list(seen), list(seen.values())


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], names=list(columns))


def _reader(grams):
    """(doc_id, h, canon, null, null) of every text with a token, and (null, null, null, w, n) of the words of many texts together."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, long, string = _Counts(grams), pa.int64(), pa.string()

        def taken() -> pa.RecordBatch:
            w, n = counts.taken()
            none = [None] * len(w)
            return _batch({"doc_id": (none, long), "h": (none, long), "canon": (none, string), "w": (w, string), "n": (n, long)})

        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                parts = [_parts(t) for t in part.column("text").to_pylist()]
                rows = [(i, p, _joined(p)) for i, p in zip(part.column("id").to_pylist(), parts) if p]
                counts.add([x[1:] for x in rows])
                none = [None] * len(rows)
                yield _batch({"doc_id": ([i for i, _, _ in rows], long), "h": ([_hash(c.encode()) for _, _, c in rows], long), "canon": ([c for _, _, c in rows], string), "w": (none, string), "n": (none, long)})
                if len(counts.seen) > 300_000:
                    yield taken()
        yield taken()

    return read


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of the letter windows of items in Chinese or Japanese."""
    for b in batches:
        own = [_letters(c) for c in b["canon"] if is_letterwise(words(c.split(" ")))]
        yield pd.DataFrame({"key": np.unique(letter_keys(own)[2])}).astype("int64")


def _counter(grams):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(grams)
        for b in batches:
            counts.add([([c], c) for c in b.column("canon").to_pylist()])
        w, n = counts.taken()
        yield _batch({"w": (w, pa.string()), "n": (n, pa.int64())})

    return count


def _item_windows(ordinary, min_words: int, min_letters: int):
    """(key, item, pos, kind) of the items' windows: 'slot' with a name, 'plain' in stretches without, 'name' for a name alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = ordinary.value
        for b in batches:
            out = []
            for item, canon in zip(b["item"], b["canon"]):
                tokens = canon.split(" ")
                own = words(tokens)
                if is_letterwise(own):
                    pieces = list(letter_windows(own))
                    rare = {p for p, x in pieces if "=" + x not in common}
                    bare = _bare([p in rare for p in range(len(own))], min_letters - LETTERS + 1)
                    out += [(k, item, p, "slot" if p in rare else "letters") for (p, _), k in zip(pieces, letter_keys([_letters(canon)])[2].tolist()) if p in rare or bare[p]]
                else:
                    out += [(k, item, p, "slot") for p, k in slot_windows(tokens, common)]
                    out += [(_name_key(w), item, -1, "name") for w in set(own) if _is_name(w, common)]
                    bare = _bare([_is_name(w, common) for w in own], min_words)
                    out += [(k, item, p, "plain") for p, k in plain_windows(own) if all(bare[p : p + PLAIN])]
            yield pd.DataFrame(out, columns=["key", "item", "pos", "kind"]).astype({"key": "int64", "item": "int64"})

    return cut


class _Needed:
    """The words beside which windows of items may stand. Those that are not needed come again and again and are kept, at most `most`."""

    def __init__(self, ordinary: frozenset[str], keys: KeySet, most: int = 200_000):
        self.ordinary, self.keys, self.most = ordinary, keys, most
        self.idle: set[str] = set()

    def among(self, own: set[str]) -> set[str]:
        new = own - self.idle
        out = {w for w in new if _is_name(w, self.ordinary) and _name_key(w) in self.keys}
        if len(self.idle) >= self.most:
            self.idle.clear()
        self.idle |= new - out
        return out


def _seeker(ordinary, wanted, kinds: set[str]):
    """The documents with a window that some item may have, and where."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, keys = ordinary.value, wanted.value
        needed = _Needed(common, keys)
        for b in batches:
            rows = []
            letters = [(i, _letters(c)) for i, c in enumerate(b["canon"]) if not c.isascii() and _CJK.search(c)]
            by_text: dict[int, list[tuple[int, int]]] = {}
            for i, p, k, _ in _held_letters(letters, keys):
                by_text.setdefault(i, []).append((p, k))
            for i, (doc, h, canon) in enumerate(zip(b["doc_id"], b["h"], b["canon"])):
                own = _NUMBER.sub("", canon).split()
                slots = needed.among(set(own)) if "slot" in kinds else ()
                hits = [(p, k) for p, k in _windows_of(canon.split(" "), common, slots) if k in keys] if slots else []
                if "plain" in kinds:
                    hits += [(p, k) for p, k in plain_windows(own) if k in keys]
                hits += by_text.get(i, ())
                if hits:
                    rows.append((doc, h, canon, [{"p": p, "key": k} for p, k in hits]))
            yield pd.DataFrame(rows, columns=["doc_id", "h", "canon", "hits"])

    return seek


def _numbers(tokens: list[str], start: int, end: int) -> Counter[str]:
    """The numbers between the words `start` and `end`."""
    out, at = Counter(), -1
    for t in tokens:
        if t[0] != "#":
            at += 1
        elif start <= at < end:
            out[t] += 1
    return out


def _aligner(ordinary, min_words: int, min_letters: int, exchanged: float, slot_share: float):
    def marked_item(canon: str) -> tuple:
        """Tokens and words of an item, whether letters count, how many must run, which words or windows are names, and the names."""
        tokens, common = canon.split(" "), ordinary.value
        own = words(tokens)
        letters = is_letterwise(own)
        marked = [not letters and _is_name(w, common) for w in own]
        for p, x in letter_windows(own) if letters else ():
            marked[p] = "=" + x not in common
        return tokens, own, letters, min_letters if letters else min_words, marked, frozenset(w for w, m in zip(own, marked) if m)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[int, tuple] = {}
        for b in batches:
            out, last = [], (None, None)
            doc_tokens, theirs = [], []
            for doc, item, canon, item_canon, at in zip(b["doc_id"], b["item"], b["canon"], b["item_canon"], b["at"]):
                if item not in texts:
                    if len(texts) > 10_000:
                        texts.clear()
                    texts[item] = marked_item(item_canon)
                item_tokens, mine, letters, least, marked, names = texts[item]
                if doc != last[0] or canon != last[1]:
                    doc_tokens = canon.split(" ")
                    last, theirs = (doc, canon), words(doc_tokens)
                best: dict[str, tuple] = {}
                covered: dict[int, int] = {}
                for bare, pos, p in sorted((x["bare"], x["pos"], x["p"]) for x in at):
                    if covered.get(p - pos, -1) >= pos:  # inside a run that has been found on this alignment
                        continue
                    run, errors, start, end = best_run(mine, theirs, pos, p, exchanged)
                    covered[p - pos] = end
                    if run < least:
                        continue
                    if letters:
                        agree = not bare
                    else:
                        near = set(theirs[max(0, p - (pos - start) - 8) : p + (end - pos) + 9])
                        agree = _slots_agree(mine[start : end + 1], near, names, slot_share)
                    if not agree and not any(marked[start : end - LETTERS + 2] if letters else marked[start : end + 1]):
                        agree = not _beside_slot(mine, theirs, start, end + 1, p - pos, letters)
                    if not agree:
                        agree = any(not _beside_slot(mine, theirs, x, y, p - pos, letters) for x, y in _equal_runs(mine, theirs, start, end + 1, p - pos, least))
                    kind = "leak" if agree else "reparameterised"
                    if run > best.get(kind, (0,))[0]:
                        asked = _numbers(item_tokens, start, end)
                        same = sum((asked & _numbers(doc_tokens, p - (pos - start), p + (end - pos))).values())
                        best[kind] = (run, errors, same / sum(asked.values()) if asked else None)
                for kind in ("leak", "reparameterised"):
                    if kind in best:
                        out.append((doc, item, kind, *best[kind]))
                        break
            yield pd.DataFrame(out, columns=["doc_id", "item", "kind", "run", "errors", "numbers_same"]).astype({"numbers_same": "float64"})

    return align


def _beside_slot(item: list[str], doc: list[str], start: int, end: int, shift: int, letters: bool) -> bool:
    """Whether the texts go on alike after other words on either side of item[start:end]."""
    return _goes_on(item, doc, start - 1, start - 1 + shift, -1, letters) or _goes_on(item, doc, end, end + shift, 1, letters)


def _slots_agree(run: list[str], around: set[str], slots: frozenset[str], share: float) -> bool:
    names = [w for w in run if w in slots]
    same = sum(w in around for w in names)
    return same >= share * len(names) and same > 0
