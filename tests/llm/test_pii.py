"""Personal data against the patterns read literally, and revealing terms against a plain count."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from tests.conftest import SMALL
from tradegrain.llm import pii
from tradegrain.llm.queries import QUERIES

# Fixed patterns of the base kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id long, text string, key string, entity string, term string"


def literal(text: str) -> list[tuple[str, int, int]]:
    def passes(kind: str, value: str) -> bool:
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def plain_terms(texts: list[str], evidence: int, generalise: float, remove: float) -> dict[tuple, str]:
    """Revealing terms by dictionaries over units as tuples of words."""
    near, standing, entities, total = Counter(), Counter(), Counter(), 0
    told = defaultdict(set)
    for text in texts:
        if not text:
            continue
        total += text.count("\n") + 1 + text.count(" ") // pii.UNIT
        masked = re.sub(PATTERNS["email"], lambda m: " " * len(m.group()), text)
        units, ends, at = [], [], 0
        for line in masked.split("\n"):
            words = [(m.start() + at, m.group()) for m in re.finditer(r"[a-zA-Z\u0080-\U0010ffff]+", line)]
            words = [(s, "".join(c.lower() if c.isascii() else c for c in w)) for s, w in words]
            for i in range(0, len(words), pii.UNIT):
                units.append(tuple(w for _, w in words[i : i + pii.UNIT]))
                ends += [(s, len(units) - 1) for s, _ in words[i : i + pii.UNIT]]
            at += len(line) + 1
        for unit in units:
            standing.update(set(unit))
        held = set()
        for kind, start, end in literal(text):
            if not ends:
                continue
            after = next((i for i, (s, _) in enumerate(ends) if s >= start), len(ends))
            low, high = ends[max(after - 1, 0)][1], ends[min(after, len(ends) - 1)][1]
            held |= {(value_of(kind, text[start:end]), u) for u in range(max(low - 1, 0), min(high + 1, len(units) - 1) + 1)}
        for entity, u in held:
            entities[entity] += 1
            for word in set(units[u]):
                near[word, entity] += 1
                told[word, entity].add(units[u])
    found = {}
    for (word, entity), n in near.items():
        if len(told[word, entity]) < evidence or entities[entity] >= total:
            continue
        share = 1 - math.log(n / standing[word]) / math.log(entities[entity] / total)
        if share >= generalise - 1e-12:
            found[word, entity] = "remove" if share >= remove - 1e-12 else "generalise"
    return found


def value_of(kind: str, value: str) -> tuple[str, str]:
    return kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()


def whole(texts: list[str | None], everywhere: bool = False, **settings) -> list[tuple]:
    wanted = {"evidence": pii.EVIDENCE, "generalise": pii.GENERALISE, "remove": pii.REMOVE} | settings
    terms = plain_terms([t for t in texts if t], **wanted)
    rows = []
    for text in texts:
        base = literal(text or "")
        masked = re.sub(PATTERNS["email"], lambda m: " " * len(m.group()), text or "")
        held = {value_of(k, text[s:e]) for k, s, e in base}
        more = []
        for m in re.finditer(r"[a-zA-Z\u0080-\U0010ffff]+", masked):
            word = "".join(c.lower() if c.isascii() else c for c in m.group())
            kinds = {kind for (term, entity), kind in terms.items() if term == word and (everywhere or entity in held)}
            if kinds:
                more.append((max(kinds), m.start(), m.end()))
        counts = [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        said = pii.joined(base)
        rows.append((*counts, hashlib.sha256(said.encode()).hexdigest(), pii.joined(base + sorted(more))))
    return rows


@pytest.mark.parametrize("alphabet", ["0123456789. -", "ab@.-_ 1", "+1 ()-.2", "0123456789- .+@a\n"])
def test_spans_equal_the_literal_patterns(alphabet):
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == literal(text), text


def test_cards_with_right_check_digits():
    text = "4111 1111 1111 1111, 4111111111111112 and 378282246310005 or 6011-0009-9013-9424 é +44 (20) 7946-0958"
    assert [k for k, _, _ in pii.base_spans(text)] == ["card", "card", "card", "phone"]
    assert pii.base_spans(text) == literal(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "a@b", "+1", "1 ", "@", "+1("])
def test_hostile_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.time()
    pii.base_spans(text)
    assert time.time() - start < 10


def planted() -> list[str | None]:
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("lo", "ma", "né", "tu", "ri") for b in ("sa", "ke", "di", "fo")]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    texts: list[str | None] = [prose(30) + "\n" + prose(90) for _ in range(60)]
    texts += [f"{prose(12)} Quillon {prose(3)} mail quill@site.example.org {prose(9)}\n{prose(20)}" for _ in range(6)]
    # The name alone, a line away from the number, and a name that stands elsewhere half of the time.
    texts += [f"{prose(8)} quillon {prose(8)}" for _ in range(1)]
    texts += [f"Zoë Vreeland {prose(6)}\n{prose(5)} +1 (555) 010-4477 {prose(4)}" for _ in range(5)]
    texts += [f"{prose(3)} Marlow {prose(3)} 10.20.30.40 {prose(2)}" for _ in range(4)] + [f"{prose(5)} marlow {prose(5)}" for _ in range(4)]
    # One passage in many copies is one piece of evidence.
    texts += [f"Copied Orrin has 192.0.2.{9} here"] * 20
    return [*texts, None, "", "   \n\n", "+1 555 123 4567", LONG]


LONG = "word " * 20_000 + "lone@mail.example.com " + "other words " * 10_000


def run(spark, texts, **settings) -> list[tuple]:
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS).repartition(5)
    return [tuple(r)[1:7] for r in sorted(pii.find(docs, **settings).collect(), key=lambda r: r["doc_id"])]


def test_planted_terms_equal_the_plain_count(spark):
    texts = planted()
    found = run(spark, texts)
    assert found == whole(texts)
    text = texts[60]
    at = text.index("Quillon")
    assert f"generalise:{at}:{at + 7}" in found[60][-1]
    assert "remove:0:3,remove:4:12" in found[67][-1] and "Zoë Vreeland" in texts[67]
    # Nothing in documents without personal data, for a name that stands elsewhere as often, or told by copies only.
    assert all(f[-1] == "" for f in found[:60]) and found[66][-1] == ""
    assert all("," not in f[-1] for f in found[72:100])


def test_terms_in_all_documents(spark):
    texts = planted()
    found = run(spark, texts, everywhere=True)
    assert found == whole(texts, everywhere=True)
    at = texts[66].index("quillon")
    assert found[66][-1] == f"generalise:{at}:{at + 7}"


def test_other_thresholds_equal_the_plain_count(spark):
    texts = planted()
    settings = {"evidence": 1, "generalise": 0.5, "remove": 0.8}
    assert run(spark, texts, **settings) == whole(texts, **settings)


def test_query_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    wanted = whole([d["text"] for d in docs])
    found = sorted(map(tuple, QUERIES["op11_personal_data"](spark, SMALL).collect()))
    assert found == sorted((d["doc_id"], *w) for d, w in zip(docs, wanted, strict=True))


def test_sanitised_texts_and_repeated_rows(spark):
    rows = [(1, f"{a} call Quillon at +1 555 123 4567 today") for a in ("one", "two", "three")] + [(None, "a quillon b")] * 2
    rows += [(2, "prose without data " * 3)] * 40 + [(3, None), (4, "mail me@site.example.com or 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sanitise(docs, evidence=3).collect()
    assert len(found) == len(rows)
    said = Counter((r["doc_id"], r["text"]) for r in found)
    assert said[(None, "a quillon b")] == 2
    assert said[(4, "mail [EMAIL] or [IP]")] == 1 and said[(3, None)] == 1
    assert all("555" not in (r["text"] or "") for r in found)


def test_empty_table(spark):
    assert run(spark, []) == []
