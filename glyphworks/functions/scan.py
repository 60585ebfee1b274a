"""Batches of texts as arrays of code points: places, details and hits without a loop over characters.

Operators that list what they find run one of these kernels in one pass (mapInArrow), so
a text is read once, whatever the number of its hits.  Work goes by slices of
about a megabyte, which bounds the memory of a worker; a longer text is a slice of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.functions.unicode_data import cluster_class, is_significant_letter, script_of

LIMIT = 500
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 8192
LOCATION = ["byte_start", "byte_end", "utf16_start", "utf16_end", "scalar_start", "scalar_end", "line", "column", "line_end", "column_end"]
FACTS = ["escaped", "code_point", "utf8_hex", "name", "category", "script"]
_LONGS = [(k, pa.int64()) for k in LOCATION]
_FACT_FIELDS = [(k, pa.string()) for k in FACTS]
#: Character details, alone and with their place.
DETAIL = pa.struct(_FACT_FIELDS)
DETAIL_AT = pa.struct([*_FACT_FIELDS, ("location", pa.struct(_LONGS))])
DETAIL_SCHEMA = "struct<" + ",".join(f"{k}:string" for k in FACTS) + ">"
DETAIL_AT_SCHEMA = "struct<" + ",".join(f"{k}:string" for k in FACTS) + ",location:struct<" + ",".join(f"{k}:bigint" for k in LOCATION) + ">>"


def review_escape(char: str) -> str:
    """Backslash spelling of the reviews: four digits, or a capital U and eight; no letters for tab and line ends."""
    return f"\\u{ord(char):04X}" if ord(char) <= 0xFFFF else f"\\U{ord(char):08X}"


def char_facts(char: str) -> tuple[str, str, str, str, str, str]:
    """The fields of FACTS."""
    return review_escape(char), f"U+{ord(char):04X}", char.encode().hex(" ").upper(), unicodedata.name(char, "UNNAMED"), unicodedata.category(char), script_of(char)


class Lazy:
    """A table over all code points that learns an entry when it is first asked for; 0 is for entries not known yet."""

    def __init__(self, fact: Callable[[str], int]):
        self.fact, self.table = fact, np.zeros(0x110000, np.int32)

    def of(self, cp: np.ndarray) -> np.ndarray:
        """fact(chr(c)) of each."""
        found = self.table[cp]
        if not found.all():
            new = np.unique(cp[found == 0])
            self.table[new] = [self.fact(chr(c)) + 1 for c in new.tolist()]
            found = self.table[cp]
        return found - 1


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Texts:
    """text: all texts in one; cp: its code points; start: where each text starts in it, and the end of all."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        n = len(column)
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
        try:
            self.text = str(raw, "utf-8")
        except UnicodeDecodeError:  # bad bytes count as U+FFFD
            each = [bytes(raw[a:b]).decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
            raw, offsets = b"".join(each), np.cumsum([0, *map(len, each)])
            self.text = str(raw, "utf-8")
        self.cp = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        self.start = begun[offsets - offsets[0]]
        self.n = n
        self._places: tuple | None = None
        self._owner: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        return cls(pa.array(texts, pa.string()))

    def strings(self) -> list[str]:
        ends = self.start.tolist()
        return [self.text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    @property
    def owner(self) -> np.ndarray:
        """The text of each code point."""
        if self._owner is None:
            self._owner = np.repeat(np.arange(self.n), np.diff(self.start))
        return self._owner

    def _prefixes(self) -> tuple:
        """Bytes, UTF-16 units and line ends before each place, and the place after the last line end character."""
        if self._places is None:
            cp = self.cp
            total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            wide = (cp > 0xFFFF).astype(np.int8)
            end = (cp == 10) | (cp == 13)
            breaks = end.copy()
            if len(cp):
                second = (cp[1:] == 10) & (cp[:-1] == 13) & (self.owner[1:] == self.owner[:-1])
                breaks[1:] &= ~second
            last = np.concatenate([[0], np.maximum.accumulate(np.where(end, np.arange(1, len(cp) + 1), 0))])
            self._places = total((cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + wide + 1), total(wide + 1), total(breaks), last
        return self._places

    def metrics(self) -> dict[str, np.ndarray]:
        """bytes, utf16_code_units, unicode_scalars and lines of each text."""
        b, u, lines, _ = self._prefixes()
        return {"bytes": np.diff(b[self.start]), "utf16_code_units": np.diff(u[self.start]), "unicode_scalars": np.diff(self.start), "lines": np.diff(lines[self.start]) + 1}

    def _at(self, text: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        b, u, lines, last = self._prefixes()
        head = self.start[text]
        return [b[place] - b[head], u[place] - u[head], place - head, lines[place] - lines[head] + 1, place - np.maximum(last[place], head) + 1]

    def locations(self, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of LOCATION of ranges of code points."""
        (b, u, s, line, column), (be, ue, se, line_end, column_end) = self._at(text, first), self._at(text, end)
        return dict(zip(LOCATION, [b, be, u, ue, s, se, line, column, line_end, column_end], strict=True))

    def details(self, text: np.ndarray, at: np.ndarray) -> pa.StructArray:
        """Details and places of single characters."""
        where = pa.StructArray.from_arrays([pa.array(v) for v in self.locations(text, at, at + 1).values()], names=LOCATION)
        return pa.StructArray.from_arrays([*facts_of(self.cp[at]), where], names=[*FACTS, "location"])

    def listed(self, text: np.ndarray, first: np.ndarray, end: np.ndarray, limit: int = LIMIT) -> pa.ListArray:
        """For each range the details of its characters, the first ``limit`` of them."""
        size = np.minimum(end - first, limit)
        flat = self.details(np.repeat(text, size), spans(first, size))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)


def facts_of(chars: np.ndarray) -> list[pa.Array]:
    distinct, index = np.unique(chars, return_inverse=True)
    known = [char_facts(chr(c)) for c in distinct.tolist()]
    index = pa.array(index.astype(np.int64))
    return [pa.array([f[k] for f in known], pa.string()).take(index) for k in range(len(FACTS))]


def bare_details(chars: np.ndarray, known: np.ndarray) -> pa.StructArray:
    """Details without a place; null where not known."""
    return pa.StructArray.from_arrays(facts_of(np.where(known, chars, 0)), names=FACTS, mask=pa.array(~known))


def ranks(text: np.ndarray) -> np.ndarray:
    """From 1 within each text, for hits in order."""
    if not len(text):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return np.arange(len(text)) - np.repeat(heads, np.diff(np.append(heads, len(text)))) + 1


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Texts]]:
    """Keys and texts of a batch of (key, text), some texts at a time."""
    keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
    ends = np.cumsum(np.fromiter((len(t.as_buffer()) for t in texts), np.int64, len(texts)))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        n = max(1, min(SLICE_TEXTS, int(np.searchsorted(ends, done + SLICE_BYTES, "right")) - at))
        yield keys.slice(at, n), Texts(texts.slice(at, n))
        at += n


def scanned(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[Texts], tuple[np.ndarray, dict]]], columns: str) -> DataFrame:
    """Rows of kernel(texts) -> (the text of each row, columns by name), with the key of the text in front; null texts give no rows.

    make gives a kernel; each task makes its own.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).cast("string").alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for keys, texts in slices(batch):
                owner, found = kernel(texts)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *(v if isinstance(v, pa.Array) else pa.array(v) for v in found.values())], names=["key", *found])

    out = rows.mapInArrow(run, f"key {kind}, {columns}")
    return out.select(F.col("key").alias(key), *[F.col(n) for n in names])


# --- grapheme clusters

_KINDS = ["Other", "CR", "LF", "Control", "L", "V", "T", "LV", "LVT", "RI", "Prepend", "ZWJ", "Extend", "SpacingMark"]


def _packed_class(char: str) -> int:
    """Class in 4 bits, then consonant, linker, pictographic, then the Indic block from 1."""
    kind, block, consonant, linker, picture = cluster_class(char)
    return _KINDS.index(kind) | consonant << 4 | linker << 5 | picture << 6 | (block + 1) << 7


def _joins() -> np.ndarray:
    """Whether two neighbours are never parted, by their classes alone."""
    k = {name: i for i, name in enumerate(_KINDS)}
    out = np.zeros((len(_KINDS), len(_KINDS)), bool)
    for a, after in (("L", ("L", "V", "LV", "LVT")), ("LV", ("V", "T")), ("V", ("V", "T")), ("LVT", ("T",)), ("T", ("T",))):
        out[k[a], [k[b] for b in after]] = True
    out[:, [k["Extend"], k["ZWJ"], k["SpacingMark"]]] = True
    out[k["Prepend"]] = True
    hard = [k["CR"], k["LF"], k["Control"]]
    out[hard] = False
    out[:, hard] = False
    out[k["CR"], k["LF"]] = True
    return out


def clusters(t: Texts, classes: Lazy) -> np.ndarray:
    """Extended grapheme clusters of each text."""
    n = len(t.cp)
    if not n:
        return np.zeros(t.n, np.int64)
    packed = classes.of(t.cp)
    kind, consonant, linker, picture, block = packed & 15, packed >> 4 & 1 == 1, packed >> 5 & 1 == 1, packed >> 6 & 1 == 1, packed >> 7
    place = np.arange(n)
    head = t.start[t.owner]
    join = np.zeros(n, bool)
    join[1:] = _joins()[kind[:-1], kind[1:]]
    extend, zwj, regional = (kind == _KINDS.index(k) for k in ("Extend", "ZWJ", "RI"))
    hard = np.isin(kind, [_KINDS.index(k) for k in ("CR", "LF", "Control")])
    before = lambda where: np.concatenate([[-1], np.maximum.accumulate(np.where(where, place, -1))[:-1]])  # noqa: E731  the last such place
    # regional indicators stand in pairs
    run = place - before(~regional) - 1
    join |= regional & (np.minimum(run, place - head) % 2 == 1)
    # a pictograph after a joiner that follows a pictograph and extenders
    base = before(~(extend & ~picture))
    joined = np.concatenate([[False], zwj[:-1]])
    at = base[np.maximum(place - 1, 0)]
    join |= picture & joined & (at >= head) & picture[at] & ~hard
    # a consonant after one of its script and marks, a linker among them
    mark = extend | zwj
    at = before(~mark)
    own = np.maximum(at, 0)
    strange = mark & (block > 0) & (block != block[own])
    odd, links = (np.concatenate([[0], np.cumsum(x)]) for x in (strange, mark & linker))
    join |= consonant & ~mark & (at >= head) & consonant[own] & (block[own] == block) & (odd[place] == odd[own + 1]) & (links[place] > links[own + 1])
    join[t.start[:-1][t.start[:-1] < n]] = False
    total = np.concatenate([[0], np.cumsum(~join)])
    return np.diff(total[t.start])


# --- writing systems


class Scripts:
    """Census and findings of texts by script; names[0] is for what has none of its own."""

    def __init__(self, expected: list[set[str]], confusables: dict[int, str]):
        self.names = [""]
        self.number = {"": 0}
        self.letters = Lazy(lambda c: self._numbered(script_of(c)) if is_significant_letter(c) else 0)
        self.expected, self.confusables = expected, confusables
        self.alike = np.zeros(0x110000, np.uint32)
        for cp, letter in confusables.items():
            self.alike[cp] = ord(letter)

    def _numbered(self, name: str) -> int:
        if name not in self.number:
            self.number[name] = len(self.names)
            self.names.append(name)
        return self.number[name]

    def review(self, t: Texts) -> dict:
        script = self.letters.of(t.cp)
        latin = self._numbered("Latin")
        width = len(self.names)
        at = np.flatnonzero(script)
        cell = t.owner[at] * width + script[at]
        count = np.bincount(cell, minlength=t.n * width).reshape(t.n, width)
        first = np.full(t.n * width, np.iinfo(np.int64).max)
        first[cell[::-1]] = at[::-1]  # of several, the last that is written stays
        first = first.reshape(t.n, width)
        present = count > 0
        many = present.sum(1)
        most = present & (count == count.max(1, keepdims=True))
        dominant = np.where(many > 0, np.where(most, first, np.iinfo(np.int64).max).argmin(1), 0)
        usual = np.zeros(t.n, bool)
        for combination in self.expected:
            usual |= ~present[:, [k for k in range(1, width) if self.names[k] not in combination]].any(1)
        usual &= many > 1
        # letters only: whatever looks like an ASCII letter here is one
        owner = t.owner[at]
        alike = (self.alike[t.cp[at]] > 0) & (script[at] != latin) & present[:, latin][owner]
        other = ((many > 1) & ~usual)[owner] & (script[at] != dominant[owner])
        hit = alike | other
        return {"count": count, "first": first, "present": present, "many": many, "dominant": dominant, "usual": usual, "script": script, "hits": at[hit], "alike": alike[hit], "total": np.bincount(owner[hit], minlength=t.n)}

    def named(self, numbers: np.ndarray) -> pa.Array:
        return pa.array([x or None for x in self.names], pa.string()).take(pa.array(numbers.astype(np.int64)))


# --- legacy bytes


def legacy_table(cp1252: dict[int, int]) -> np.ndarray:
    """The legacy byte of each code point, -1 for none; the last entry stands for all that follow."""
    table = np.full(max(cp1252) + 2, -1, np.int16)
    table[:256] = np.arange(256)
    table[list(cp1252)] = list(cp1252.values())
    return table


def legacy_sequences(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where well-formed UTF-8 is spelled in legacy characters, or U+FFFD stands: place, length, bytes packed into an integer, code point meant.

    A lead byte is no continuation byte, so sequences never overlap.
    """
    byte = table[np.minimum(t.cp, len(table) - 1)]
    padded = np.concatenate([byte, np.full(3, -1, np.int16)])
    at = np.flatnonzero((byte >= 0xC2) & (byte <= 0xF4) | (t.cp == 0xFFFD))
    lost = t.cp[at] == 0xFFFD
    lead = byte[at].astype(np.int64)
    size = np.where(lost, 1, 2 + (lead >= 0xE0) + (lead >= 0xF0))
    low = np.select([lead == 0xE0, lead == 0xF0], [0xA0, 0x90], 0x80)
    high = np.select([lead == 0xED, lead == 0xF4], [0x9F, 0x8F], 0xBF)
    follow = np.stack([padded[at + k].astype(np.int64) for k in (1, 2, 3)])
    fine = lost | ((follow[0] >= low) & (follow[0] <= high))
    for k in (1, 2):
        fine &= (size <= k + 1) | ((follow[k] >= 0x80) & (follow[k] <= 0xBF))
    fine &= at + size <= t.start[1:][t.owner[at]]
    packed, meant = lead.copy(), lead & np.select([size == 2, size == 3], [0x1F, 0x0F], 0x07)
    for k in range(3):
        on = size > k + 1
        packed, meant = np.where(on, packed << 8 | follow[k], packed), np.where(on, meant << 6 | follow[k] & 0x3F, meant)
    return at[fine], size[fine], packed[fine], meant[fine]


# --- normal forms


def changed_range(a: str, b: str) -> tuple[int, int, int]:
    """Start, and the two ends, of what is left after a common prefix and then a common suffix."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    rest = n - start
    differ = np.flatnonzero(x[len(x) - rest :][::-1] != y[len(y) - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    return start, len(x) - tail, len(y) - tail
