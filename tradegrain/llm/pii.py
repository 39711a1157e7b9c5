"""Personal data by fixed patterns, and terms that reveal it by how they occur beside it in the corpus.

Emails, ip addresses, card and phone numbers are found by pattern; each different value is a protected entity. A
term is a run of letters, lower-cased in ASCII. Texts are read as units, runs of at most ``UNIT`` terms of one line,
and an entity is held by the units around it: its own, the one before and the one after. A term discloses an
entity by the share of the entity's information that the term gives away,

    PMI(term; entity) / IC(entity) = 1 - log p(entity | term) / log p(entity),

which is 1 if the entity is near wherever the term stands. All probabilities are counts of units over the whole
corpus. Terms from ``GENERALISE`` on are generalised, from ``REMOVE`` on removed, if at least ``EVIDENCE`` different
units tell so: copies of one passage are one piece of evidence. A document is protected for the entities it holds, so
such terms are marked in it, near the entity or not; with ``everywhere`` they are marked in all documents.

Three passes over the texts: patterns and the units near entities; how often candidate terms stand anywhere; where
revealing terms stand. Candidates reach the tasks as a bitmap of fixed size, an exact join decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import as_long, columns_of, hash_bitmap, hashed_words, mix, slices, store

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
UNIT = 64
EVIDENCE = 3
GENERALISE, REMOVE = 0.9, 0.97
CHUNK_CHARS = 1 << 21
SHOWN = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
# What stands for each byte where terms are read: letters lower-cased, line ends kept, other ASCII a space.
_LETTERS = bytes(b if b == 10 or b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does, so no run is tried from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(rb"[^ \n]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every run of local characters before an ``@`` that a domain follows, each character looked at once."""
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns in order of kind and start, leftmost without overlap in each kind."""
    spans = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _entity(kind: str, value: str) -> int:
    name = _NO_DIGIT.sub("", value) if kind in {"card", "phone"} else value.lower()
    return xxhash.xxh64_intdigest(f"{kind}:{name}") >> 1


def _masked(text: str | None) -> bytes:
    """The text as letters, spaces and line ends, byte for byte; emails are no terms."""
    text = text or ""
    parts, at = [], 0
    for start, end in _emails(text) if "@" in text else ():
        parts += [text[at:start], " " * (end - start)]
        at = end
    return "".join([*parts, text[at:]]).encode().translate(_LETTERS)


class _Units:
    """Terms and units of many texts at once; ``first`` and ``stop`` bound the terms of each text."""

    def __init__(self, texts: list[str | None]):
        parts = [_masked(t) for t in texts]
        self.data = b"\n".join(parts)
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes
        hashes, self.starts = hashed_words(self.data)
        self.terms = hashes >> np.uint64(1)
        self.stop = np.searchsorted(self.starts, self.begin + sizes)
        line = np.searchsorted(np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == 10), self.starts)
        place = np.arange(len(line))
        new = np.append(True, line[1:] != line[:-1])[: len(line)]
        within = place - np.maximum.accumulate(np.where(new, place, 0))
        opens = within % UNIT == 0
        self.unit = np.cumsum(opens) - 1
        self.heads = np.flatnonzero(opens)
        mixed = mix(self.terms + (within % UNIT).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.names = mix(np.add.reduceat(mixed, self.heads)) if len(self.heads) else mixed

    def holding(self, text: int) -> tuple[int, int]:
        """The first and the last term of a text, the last excluded."""
        return int(np.searchsorted(self.starts, self.begin[text])), int(self.stop[text])

    def terms_of(self, unit: int) -> np.ndarray:
        end = self.heads[unit + 1] if unit + 1 < len(self.heads) else len(self.terms)
        return np.unique(self.terms[self.heads[unit] : end])


def _chunks(parts: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Columns of runs of rows with at most ``CHUNK_CHARS`` of text, or one row; ``text`` comes last."""
    for part in slices(parts):
        columns = columns_of(part, *names)
        at, held = 0, 0
        for end, text in enumerate(columns[-1]):
            if held and held + len(text or "") > CHUNK_CHARS:
                yield [c[at:end] for c in columns]
                at, held = end, 0
            held += len(text or "")
        yield [c[at:] for c in columns]


_CONTEXT = pa.list_(pa.struct([("entity", pa.int64()), ("unit", pa.int64()), ("terms", pa.list_(pa.int64()))]))
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64())]
    + [(f"n_{kind}", pa.int64()) for kind in KINDS[:4]]
    + [("base_sha256", pa.string()), ("base", pa.string()), ("units", pa.int64()), ("contexts", _CONTEXT)]
)
_FOUND_TYPES = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "units long, contexts array<struct<entity: long, unit: long, terms: array<long>>>"
)


def _contexts(units: _Units, at: int, text: str, spans: list[Span]) -> list[dict]:
    """Entities of one text with the units that hold them."""
    first, stop = units.holding(at)
    if first == stop:
        return []
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    places = np.flatnonzero((raw & 0xC0) != 0x80) + units.begin[at]  # of each code point
    low, high = units.unit[first], units.unit[stop - 1]
    held = set()
    for kind, start, end in spans:
        after = int(np.searchsorted(units.starts, places[start]))
        near = units.unit[max(after - 1, first)], units.unit[min(after, stop - 1)]
        entity = _entity(kind, text[start:end])
        held.update((entity, u) for u in range(max(near[0] - 1, low), min(near[1] + 1, high) + 1))
    return [{"entity": e, "unit": int(as_long(units.names[u : u + 1])[0]), "terms": as_long(units.terms_of(u))} for e, u in sorted(held)]


def _base(docs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _chunks(parts, "doc_id", "text_key", "text"):
            spans = [base_spans(t or "") for t in texts]
            having = [i for i, found in enumerate(spans) if found]
            units = _Units([texts[i] for i in having])
            contexts: list[list[dict]] = [[] for _ in texts]
            for at, i in enumerate(having):
                contexts[i] = _contexts(units, at, texts[i], spans[i])
            counts = [[sum(s[0] == kind for s in found) for found in spans] for kind in KINDS[:4]]
            named = [joined(found) for found in spans]
            digests = [hashlib.sha256(n.encode()).hexdigest() for n in named]
            size = [(t.count("\n") + 1 + t.count(" ") // UNIT) if t else 0 for t in texts]
            columns = [ids, keys, *counts, digests, named, size, contexts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return docs.mapInArrow(run, _FOUND_TYPES)


def _counted(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(term, n): in how many units each marked term stands, partly summed."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(sent.value).astype(bool)
        for (texts,) in _chunks(parts, "text"):
            units = _Units(texts)
            hit = np.flatnonzero(marked[(units.terms & np.uint64(len(marked) - 1)).astype(np.int64)])
            order = np.lexsort((units.unit[hit], units.terms[hit]))
            terms, unit = units.terms[hit][order], units.unit[hit][order]
            new = np.append(True, (terms[1:] != terms[:-1]) | (unit[1:] != unit[:-1]))[: len(terms)]
            found, n = np.unique(terms[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(found)), pa.array(n, pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def revealing_terms(found: DataFrame, docs: DataFrame, evidence: int, generalise: float, remove: float) -> DataFrame:
    """(term, entity, kind): hashes of the terms whose disclosure of an entity reaches a threshold."""
    total = found.agg(F.sum("units")).first()[0] or 1
    rows = found.select(F.explode("contexts").alias("c")).select("c.entity", "c.unit", "c.terms")
    # Each different unit once, with how often it stands beside the entity.
    held = store(rows.groupBy("entity", "unit").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms")), "contexts")
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    together = held.select("entity", "n", F.explode("terms").alias("term")).groupBy("term", "entity")
    pairs = together.agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("told")).filter(F.col("told") >= evidence)
    # A term stands at least in the units near any entity, so what it can disclose has a bound before texts are read.
    once = held.groupBy("unit").agg(F.max("n").alias("n"), F.first("terms").alias("terms"))
    least = once.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n_least"))
    pairs = pairs.join(entities.filter(F.col("n_entity") < total), "entity").join(least, "term")
    whole = F.log(F.col("n_entity") / F.lit(total))

    def share(n_term: str) -> Column:
        return 1 - F.log(F.col("n_both") / F.col(n_term)) / whole

    pairs = store(pairs.filter(share("n_least") >= generalise), "pairs")
    bitmap = hash_bitmap(pairs.select(F.col("term").alias("hash")))
    if not bitmap.any():
        return pairs.select("term", "entity", F.lit("").alias("kind")).limit(0)
    told = pairs.join(_counted(docs, bitmap), "term").withColumn("share", share("n_term"))
    shares = told.filter(F.col("share") >= generalise)
    kind = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    return store(shares.select("term", "entity", kind.alias("kind")), "revealing")


def _placed(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, text_key, term, start, end) of marked terms, in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))
    names = ["doc_id", "text_key", "term", "start", "end"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(sent.value).astype(bool)
        for ids, keys, texts in _chunks(parts, "doc_id", "text_key", "text"):
            units = _Units(texts)
            hit = marked[(units.terms & np.uint64(len(marked) - 1)).astype(np.int64)]
            rows = []
            for at, text in enumerate(texts):
                first, stop = units.holding(at)
                inside = np.flatnonzero(hit[first:stop]) + first
                if not len(inside):
                    continue
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                points = np.cumsum((raw & 0xC0) != 0x80)
                for i in inside.tolist():
                    begin = int(units.starts[i])
                    end = _TERM.match(units.data, begin).end()
                    start = int(points[begin - units.begin[at]]) - 1
                    rows.append((ids[at], keys[at], int(units.terms[i]), start, int(points[end - units.begin[at] - 1])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def find(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    evidence: int = EVIDENCE,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    everywhere: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text_key.

    ``spans`` lists ``kind:start:end`` in order of kind (emails, ips, cards, phones, terms to generalise, terms to
    remove) and start, in code points, end excluded; ``base_sha256`` is the digest of the first four kinds. Terms inside
    emails are not looked at, and digits are in no term. A null or empty text has no spans. Rows are judged each for
    itself, so repeated rows, rows of one id with different texts and rows without id all come back; their copies count
    as often as they stand. Other columns are not read, an empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found = store(_base(chosen), "found")
    terms = revealing_terms(found, chosen, evidence, generalise, remove)
    base = found.select("doc_id", *[f"n_{kind}" for kind in KINDS[:4]], "base_sha256", "base", "text_key")
    bitmap = hash_bitmap(terms.select(F.col("term").alias("hash")))
    if not bitmap.any():
        return base.withColumnRenamed("base", "spans")
    placed = _placed(chosen, bitmap).join(terms, "term")
    if not everywhere:
        own = found.select("doc_id", "text_key", F.explode("contexts.entity").alias("held")).distinct()
        own = own.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
        placed = placed.join(own, F.expr("doc_id <=> d AND text_key = k AND entity = held"), "left_semi")
    # Equal rows give the same spans; removal is the stronger of the two.
    spans = placed.groupBy("doc_id", "text_key", "start", "end").agg(F.max("kind").alias("kind"))
    each = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    shown = F.transform("more", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    each = each.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.array_join(shown, ",").alias("shown"))
    whole = base.join(each, F.expr("doc_id <=> d AND text_key = k"), "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "shown")
    return whole.select("doc_id", *[f"n_{kind}" for kind in KINDS[:4]], "base_sha256", spans.alias("spans"), "text_key")


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shown: dict[str, str] | None = None, **settings) -> DataFrame:
    """(doc_id, text) with every span replaced by what ``shown`` has for its kind; of overlapping spans the first counts.

    Rows, nulls and copies as in ``find``; rows that repeat an id and a text come back as often as they stand.
    """
    marks = shown or SHOWN
    spans = find(docs, id_col=id_col, text_col=text_col, **settings).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    both = keyed.join(spans.distinct(), F.expr("doc_id <=> d AND text_key = k"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            ids, texts, named = columns_of(part, "doc_id", "text", "spans")
            clean = [None if t is None else _replaced(t, n, marks) for t, n in zip(texts, named, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def _replaced(text: str, named: str, marks: dict[str, str]) -> str:
    spans = sorted((int(s), -int(e), kind) for kind, s, e in (one.split(":") for one in named.split(",") if one))
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], marks[kind]]
            at = -end
    return "".join([*parts, text[at:]])
