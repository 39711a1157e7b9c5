"""Text operators against brute force and on edge cases: nulls, empty and repeated rows, empty tables, extra columns."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences
from tests.conftest import SMALL
from tradegrain.llm import chat, common, decontaminate, html_text, lines, packing, quality, sharding, simhash, toxicity, url_rules
from tradegrain.llm.queries import QUERIES
from tradegrain.llm.statements import STATEMENTS

DOCS = "doc_id long, text string, lang string, source string, key string, fp string, rows int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PROSE = "one two three four five six seven eight nine ten"
ROWS = [
    (1, PROSE + "\nshort", "en", "a", "x", "y", 1),
    (2, PROSE.upper() + "\nother words stand in this line", "en", None, None, None, None),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", "x", "y", 1),
    (5, LONG, "de", "b", "x", "y", 1),
    (None, PROSE, "en", "a", "x", "y", 1),
    (7, PROSE, "en", "a", "x", "y", 1),
    (7, PROSE, "en", "a", "x", "y", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_statement(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert differences(QUERIES[name](spark, SMALL), con, STATEMENTS[name]) == []


def test_chat_runs_no_python(spark):
    df = QUERIES["op9_perspectives"](spark, SMALL)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_chat_edge_cases(spark):
    rows = [(1, 0, "ann", "hi <|im_end|>"), (1, 1, None, None), (1, 1, "system", "be kind"), (None, None, "bob", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.rotate_perspectives(turns).collect()
    assert {(r["conv_id"], r["participant"]) for r in found} == {(1, "ann"), (1, "unknown"), (None, "bob")}
    for key in {(r["conv_id"], r["participant"]) for r in found}:
        segments = sorted((r for r in found if (r["conv_id"], r["participant"]) == key), key=lambda r: r["position"])
        whole = "".join(r["segment"] for r in segments)
        for r in segments:
            assert whole[r["start"] : r["start"] + r["n_chars"]] == r["segment"]
            if r["loss_start"] is not None:
                learned = whole[r["loss_start"] : r["loss_start"] + r["loss_chars"]]
                assert learned.endswith("<|im_end|>") and learned.count("<|") == 1


def brute_removed(texts: dict) -> dict:
    earlier, gone = [], defaultdict(set)
    for key in sorted(texts):
        for n, line in enumerate((texts[key] or "").split("\n")):
            words = set(line.lower().encode().split())
            if len(words) >= 5:
                if any(len(words & e) >= 0.8 * len(words | e) for e in earlier):
                    gone[key].add(n)
                earlier.append(words)
    return gone


def test_lines_equal_brute_force(spark, small):
    part = {k: t for k, t in small.items() if k < 120}
    frame = spark.createDataFrame(list(part.items()), "doc_id long, text string")
    gone = brute_removed(part)
    for row in lines.line_report(frame, min_words=5).collect():
        assert set(row["removed_lines"]) == gone[row["doc_id"]]
        kept = [x for i, x in enumerate(part[row["doc_id"]].split("\n")) if i not in gone[row["doc_id"]]]
        assert row["text"] == "\n".join(kept)


def brute_places(frame, floor: int) -> set:
    """(doc, text_key, line) of every line that matches one of an earlier place."""
    rows = frame.select("doc_id", F.xxhash64("text").alias("key"), "text").distinct().collect()
    earlier, gone = [], set()
    for doc, key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        for n, line in enumerate((text or "").split("\n")):
            words = set(line.lower().encode().split())
            if len(words) >= floor:
                if any(len(words & e) >= 0.8 * len(words | e) for e in earlier):
                    gone.add((doc, key, n))
                earlier.append(words)
    return gone


def test_lines_of_one_document_in_their_order(spark):
    """Chains of similar lines inside one document, and in rows of one id, meet in the order in which lines go."""
    rng = np.random.default_rng(7)

    def chains() -> str:
        held = []
        for chain in range(12):
            words = [f"c{chain}w{i}" for i in range(9)]
            for step in range(40):
                words[int(rng.integers(9))] = f"c{chain}v{int(rng.integers(12))}"
                held.append(" ".join(words))
        return "\n".join(held)

    rows = [(1, chains()), (1, chains()), (None, chains()), (None, chains()), (2, chains())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.removed_lines(frame, min_words=5).collect()
    assert {(r["doc"], r["text_key"], r["line"]) for r in found} == brute_places(frame, 5)


def test_short_lines_take_part(spark, tmp_path):
    """Repeats of lines below five words go from the query's result: menus, one word, text without spaces."""
    held = ["Home", "share this", "share THIS", "home home", "世界你好", "a b c d e", "d c b a", "a b c", "世界你好", " ", "", "b c"]
    held += ["a c b d", "a b c d f", "c b a", "x y z", "x y", "This share", "世界 你好"]
    rows = [(1, "\n".join(held)), (2, "\n".join(reversed(held))), (3, "home\nnew\nz y x w v\nx y z w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()
    gone = brute_places(frame, 1)
    assert {(r["doc_id"], n) for r in found for n in r["removed_lines"]} == {(doc, n) for doc, _, n in gone}
    assert {(1, 3), (1, 8), (1, 6), (3, 0), (3, 3)} <= {(doc, n) for doc, _, n in gone}


def test_lines_edge_cases(docs, none):
    found = lines.line_report(docs).collect()
    assert len(found) == len(ROWS)
    by = defaultdict(list)
    for row in found:
        by[row["doc_id"]].append((row["text"], row["n_lines"], row["n_removed"]))
    assert by[None] == [(PROSE, 1, 0)] and by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)]
    assert by[1] == [("short", 2, 1)] and by[7] == [("", 1, 1)] * 2
    assert lines.line_report(none).count() == 0
    assert lines.dedup_lines(docs).columns == docs.columns


def test_html():
    page = (
        "<head><title>t</title></head><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp;  b</h1><p>one<b>two</b>"
        "<br>three<script>x<y</script><aside>side</aside><p>four</article><footer>f</footer>"
    )
    assert " ".join(t for s, t in html_text.blocks(page) if s == html_text.KEEP) == "A & b onetwo three four"
    assert html_text.blocks(None) == [] and html_text.blocks("<") == [(html_text.OPEN, "<")]


def test_html_repeats_and_edge_cases(spark):
    shared = "this line of nine words stands on every page"
    rows = [(i, "http://h.org/x", f"<p>{shared}</p><p>{i} own words</p>", "k") for i in range(3)]
    rows += [(7, None, None, "k"), (8, "nohost", "", "k"), (9, "http://h.org/a", f"<article><p>{shared}</p></article>", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert found[1] == ("1 own words", 11) and found[7] == ("", 0) and found[8] == ("", 0) and found[9][0] == shared
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_repeats_across_groups_of_a_large_host(spark, monkeypatch):
    """A host dealt into groups gives the texts it gives whole: rare repeats, pages of one id, pages without an id."""
    rows = []
    for i in range(40):
        common = " ".join(f"pair{i // 2}word{k}" for k in range(10))
        own = " ".join(f"page{i}word{k}" for k in range(12))
        tag = "article" if i == 7 else "div"
        rows.append((i, f"http://h.org/{i}", f"<{tag}><p>{common}</p><p>{own}</p></{tag}>"))
    lone = "<p>these nine words stand on rows without any id</p><p>end</p>"
    rows += [(None, "http://h.org/n", lone), (None, "http://h.org/n", lone), (None, "http://h.org/m", "<p>" + " ".join(f"page3word{k}" for k in range(9)) + "</p>")]
    rows += [(50, "http://h.org/a", "<p>one id twice is one page and stays whole here</p>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(str, html_text.extract(pages).collect()))
    monkeypatch.setattr(html_text, "GROUP_CHARS", 100)
    assert sorted(map(str, html_text.extract(pages).collect())) == whole


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["It's <|endoftext|> A. b,c É ÉCOLE İx 12. ß~", None, "", LONG, "Ça\xa0va. don't", "x" * 5000]
    encode = packing.document_encoder(path)()
    for text, (ids, _) in zip(texts, encode([(t,) for t in texts]), strict=True):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids + [2]
    pieces = packing.pack(docs, packing.document_encoder(path), ["text"]).collect()
    bins = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert sum(p["length"] for p in pieces if p["doc_id"] == 5) == len(whole.encode(LONG, add_special_tokens=False).ids) + 1
    assert packing.pack(none, packing.document_encoder(path), ["text"]).count() == 0


def test_packing_keeps_every_limit():
    rng = np.random.default_rng(1)
    limits = packing.Limits(tokens=64, segments=4, loss_tokens=40)
    items = []
    for i, n in enumerate(rng.integers(1, 60, 200)):
        items.append(packing.Item(i, 0, np.arange(n, dtype=np.uint32), rng.random(n) < 0.5, int(n)))
    seen = defaultdict(list)
    for held in packing.fill(items, limits):
        assert sum(len(i.ids) for i in held) <= 64 and len(held) <= 4 and sum(int(i.loss.sum()) for i in held) <= 40
        for i in held:
            seen[i.doc_id] += i.ids.tolist()
    assert all(sorted(seen[i.doc_id]) == i.ids.tolist() for i in items)


def test_toxicity_held_out(spark):
    rows = [(i, f"some plain words {i} " + ("awful insult here" if i % 3 == 0 else "good day here")) for i in range(300)]
    frame = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    found = toxicity.score(frame, labels).collect()
    assert len(found) == 302
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            if r["doc_id"] < 300:
                assert r["predicted"] == int(r["doc_id"] % 3 == 0)
    assert all(r["score"] < 0.01 for r in toxicity.score(frame, labels.limit(0)).collect())


def test_quality_features_and_edge_cases(docs, none, small):
    for text in [r[1] or "" for r in ROWS] + list(small.values())[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        held = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (
            len(words),
            sum(map(len, words)),
            sum(c in "#*$%&|<>" for c in text),
            len(held) - len(set(held)),
            len(repeated),
        )
        assert quality.base_features(text, text.encode().split()) == expected
    found = quality.judge(docs).collect()
    assert len(found) == len(ROWS) and not any(r["kept"] for r in found if r["n_words"] < 50)
    assert quality.judge(none).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_kneser_ney_sums_to_one():
    keys, made = quality.word_ngrams(["abca", "abd", "b"] * 3 + ["abcb"])
    grams, counts = np.unique(keys, return_counts=True)
    model = quality.fit(grams, counts)
    for context in np.unique(grams >> quality.BITS)[:5]:
        every = (context << quality.BITS) | np.arange(1 << quality.BITS)
        assert abs(np.exp(model.score(every)).sum() - 1) < 1e-6


def test_simhash_equals_brute_force(docs, none):
    import xxhash

    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    found = simhash.near_duplicates(docs).collect()
    assert sorted(r["fingerprint"] for r in found) == sorted(f"{fingerprint(r[1]):016x}" for r in ROWS)
    assert {(r["doc_id"], r["component_id"]) for r in found if r["doc_id"] in (3, 4, 7, None)} == {(3, 3), (4, 3), (7, 7), (None, 7)}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_miss_nothing(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    close = [int(v) ^ int(np.bitwise_or.reduce(np.int64(1) << rng.choice(63, 4, replace=False))) for v in base]
    values = np.unique(np.array([*base.tolist(), *close], dtype=np.int64))
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    linked = {frozenset((r["a"], r["b"])) for r in simhash.links(frame, 4).collect()}
    unsigned = values.view(np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(unsigned[i + 1 :] ^ unsigned[i]) <= 4) + i + 1:
            assert frozenset((int(values[i]), int(values[j]))) in linked or len(linked) > 60


def test_decontamination_edge_cases(spark, docs, none):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "not there at all today")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["shared"], r["total"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1, 6, 6), (2, 1, 6, 6), (7, 1, 6, 6)}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5, None}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_url_rules_edge_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.COM/x?y"), (4, "http://b.a.com/p/q"), (4, "http://b.a.com/p/q"), (5, "x://com")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x"))
    rules = spark.createDataFrame(
        [("a.com", "/p", "block"), ("com", "/", "allow"), ("b.a.com", "/p/", "allow"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).fillna("-").collect())
    best = (4, "b.a.com", "/p/q", "b.a.com/p/", "allow")
    assert found == [(1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "a.com", "/x", "com/", "allow"), best, best, (5, "com", "", "-", "allow")]
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0 and url_rules.judge_urls(pages, rules.limit(0)).count() == 6


def test_shards(spark, docs, none, small):
    found = sharding.shard_by_bytes(spark.read.parquet(f"{SMALL}/documents.parquet"), shards=24).collect()
    sizes, home, slots = defaultdict(int), {}, defaultdict(list)
    for r in found:
        text = small[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        assert home.setdefault(text, r["shard"]) == r["shard"]
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) <= 1.02 * max(mean, max(len((t or "").encode()) + 8 for t in small.values()))
    assert sharding.shard_by_bytes(docs).count() == len(ROWS) and sharding.shard_by_bytes(none).count() == 0


def test_hashed_words_cut_like_split():
    """Same words, same hashes, also for words longer than a window and bytes above ASCII."""
    rng = np.random.default_rng(3)
    for size in (0, 1, 50, 70_000, 200_000):
        data = bytes(rng.choice(np.frombuffer(b"abcde \n\t\xc3", np.uint8), size))
        data += b" " + b"x" * size + b" " + data
        hashes, places = common.hashed_words(data)
        words = data.split()
        assert [data[at : at + len(w)] for at, w in zip(places.tolist(), words, strict=True)] == words
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def pipeline_rows(spark, small):
    """Documents with null and repeated ids: copies, near copies, one id with two texts, exact repeats."""
    texts = [t for t in small.values() if t and len(t.split()) > 60][:12]
    rows = [(i, t) for i, t in enumerate(texts[:6])] + [(10 + i, t + " more") for i, t in enumerate(texts[:3])]
    rows += [(None, t) for t in texts[4:10]] + [(3, texts[10]), (3, texts[11]), (3, texts[3]), (None, None), (None, texts[9])]
    rows = [(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_pipeline_near_dedup_keeps_one_document_of_each_group(spark, small):
    frame = pipeline_rows(spark, small)
    rows = frame.withColumn("key", F.xxhash64("text")).collect()
    texts = dict(enumerate({r["text"] for r in rows}))
    named = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    by_text = {texts[r["doc_id"]]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(named).collect()}
    group = {t: i for i, t in enumerate(by_text)}
    for _ in by_text:
        for a in by_text:
            for b in by_text:
                if (by_text[a] ^ by_text[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    expected = {}
    for r in rows:
        place = (r["doc_id"] is None, r["doc_id"] or 0, r["key"], r["source"])
        expected[group[r["text"]]] = min(expected.get(group[r["text"]], (place, r)), (place, r), key=lambda x: x[0])
    found = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert {tuple(f) for f in found} == {tuple(r[c] for c in corpus_pipeline.COLUMNS) for _, r in expected.values()}
    assert len(found) == len(expected)


def test_pipeline_decontamination_judges_each_text(spark, tmp_path):
    rows = [(1, PROSE), (None, PROSE), (None, None), (2, "before " + PROSE), (2, "clean words that no item has at all"), (None, "clean too")]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, PROSE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, frame, str(tmp_path)).collect()}
    assert left == {(None, None), (2, "clean words that no item has at all"), (None, "clean too")}
